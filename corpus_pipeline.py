"""From raw documents to packed token sequences: the stages of :mod:`graphfacts.llm.pipeline`."""

from graphfacts.llm.pipeline import ORACLE_SQL, STAGES, TOKENIZER, run

__all__ = ["ORACLE_SQL", "STAGES", "TOKENIZER", "run"]

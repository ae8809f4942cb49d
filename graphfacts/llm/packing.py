"""Hierarchical packing into sequences of several lengths.

Each document, tokenised and closed by an end token, is routed to a context-size tier. The longest tier is packed
first; what its windows leave open is filled with documents of shorter tiers, largest first, and only then by cutting
one. Shorter tiers follow with what is left. Windows of the shorter tiers are always full, so only the last window of
a pool is padded. Sequences of one tier are dealt to step groups of equal tokens and near-equal attention cost.

A pool is a bounded run of documents of one input partition: packing needs no shuffle, knows no keys that could be
hot, and a lost task repeats its own pools only.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from graphfacts.llm.bpe import KEEP, id_codec
from graphfacts.llm.shared import text_of, working

TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens in a pool, tokens of a step group, and the open tokens up to which a longest window is left uncut.
POOL, STEP, SLACK = 4_000_000, 32_768, 8


class Stock:
    """Unpacked stretches ``(document, start, length)``, found by length."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.lengths: list[int] = []

    def add(self, doc: int, start: int, length: int) -> None:
        held = self.by_length[length]
        if not held:
            insort(self.lengths, length)
        held.append((doc, start))

    def take(self, at: int) -> tuple[int, int, int]:
        length = self.lengths[at]
        held = self.by_length[length]
        doc, start = held.pop()
        if not held:
            del self.lengths[at]
        return doc, start, length

    def largest_within(self, most: int) -> int:
        """Index of the greatest length not above ``most``, or -1."""
        return bisect_right(self.lengths, most) - 1


def pack(sizes: Sequence[int], tiers: Sequence[int] = TIERS, slack: int = SLACK) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences ``(tier, stretches)`` that hold every token of documents of the given sizes exactly once."""
    longest = tiers[-1]
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    stock = Stock()
    for doc, size in enumerate(sizes):
        whole = size // longest * longest
        done += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if size > whole:
            stock.add(doc, whole, size - whole)
    short: list[tuple[int, int, int]] = []  # of windows that the pool could not fill
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0]):
        while stock.lengths and stock.lengths[-1] > below:
            window, gap = [], tier
            while gap and (at := stock.largest_within(gap)) >= 0:
                window.append(stock.take(at))
                gap -= window[-1][2]
            if gap > (slack if tier == longest else 0) and stock.lengths:
                doc, start, length = stock.take(len(stock.lengths) - 1)
                window.append((doc, start, gap))
                stock.add(doc, start + gap, length - gap)
                gap = 0
            if not gap or tier == longest and gap <= slack:
                done.append((tier, window))
            else:
                short += window
    window, gap = [], longest
    for doc, start, length in short:
        while length:
            part = min(gap, length)
            window.append((doc, start, part))
            start, length, gap = start + part, length - part, gap - part
            if not gap:
                done.append((longest, window))
                window, gap = [], longest
    if window:
        done.append((longest, window))
    return done


def steps(packed: Sequence[tuple[int, list[tuple[int, int, int]]]], step: int = STEP) -> list[int]:
    """The step group of each sequence: groups hold one tier and ``step`` tokens, save the last of a tier. Sequences
    are dealt back and forth in order of attention cost, so that groups of a tier cost about the same."""
    group, first = [0] * len(packed), 0
    for tier in sorted({t for t, _ in packed}):
        own = sorted((i for i, (t, _) in enumerate(packed) if t == tier), key=lambda i: -sum(x[2] ** 2 for x in packed[i][1]))
        n = -(-len(own) * tier // step)
        for k, i in enumerate(own):
            lap, at = divmod(k, n)
            group[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return group


FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def _pieces(docs: list, ids: list[bytes], kind: pa.DataType, first_sequence: int, first_step: int) -> tuple[pa.RecordBatch, int, int]:
    tokens = [np.frombuffer(b, "<u2") for b in ids]
    packed = pack([len(t) for t in tokens])
    group = steps(packed)
    rows = [(docs[doc], start, length, crc32(tokens[doc][start:start + length].astype("<u4").tobytes()), len(tokens[doc]),
             first_sequence + s, offset, tier, first_step + group[s])
            for s, (tier, window) in enumerate(packed)
            for offset, (doc, start, length) in zip(np.cumsum([0, *[x[2] for x in window]]).tolist(), window)]
    arrays = [pa.array(c, kind if n == "doc_id" else pa.int64()) for n, c in zip(FIELDS, zip(*rows))]
    return pa.RecordBatch.from_arrays(arrays, list(FIELDS)), len(packed), max(group) + 1


def packed_documents(docs: DataFrame, tokenizer: str, pool: int = POOL, keep: int = KEEP) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id)``.

    ``start`` counts within the document, ``offset`` within the sequence. Null and empty texts are the end token
    alone; texts of any length are cut into full windows first; every input row is packed, repeated rows and null
    identifiers too. ``sequence_id`` and ``step_id`` are unique, not gapless: the partition's number stands in the
    upper bits. ``keep`` bounds the memory of recurring words. Other columns are ignored; an empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("bpe")
        codec, end = id_codec(tokenizer, keep), END.to_bytes(2, "little")
        sequence = step = TaskContext.get().partitionId() << 32
        names, ids, held = [], [], 0
        for batch in batches:
            doc, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            for i in range(batch.num_rows):
                names.append(doc[i].as_py())
                ids.append(b"".join(codec.encode(texts[i].as_py())) + end)
                held += len(ids[-1]) // 2
                if held >= pool:
                    out, n, m = _pieces(names, ids, kind, sequence, step)
                    yield out
                    sequence, step, names, ids, held = sequence + n, step + m, [], [], 0
        if names:
            yield _pieces(names, ids, kind, sequence, step)[0]

    rows = text_of(docs)
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    types = [rows.schema["doc_id"].dataType.simpleString()] + ["long"] * 8
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(FIELDS, types)))

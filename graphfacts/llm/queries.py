"""The operators applied to the given tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfacts.llm import bpe, centroids, exact, licences, neighbours, packing, passages, pii, pipeline, quality, repair, sharding, simhash, warc

TOKENIZER = pipeline.TOKENIZER

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(spark.read.parquet(f"{folder}/{table}.parquet"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


QUERIES: dict[str, Query] = {
    "op1_licences": _over("documents", licences.scan),
    "op2_packing": _over("documents", lambda docs: packing.packed_documents(docs, TOKENIZER)),
    "op3_warc": _over("pages", warc.round_trip),
    "op4_quality": _quality,
    "op5_exact_dedup": _over("documents", exact.exact_duplicates),
    "op6_sharding": _over("documents", sharding.assign),
    "op7_bpe": _over("documents", lambda docs: bpe.round_trip_digests(docs, TOKENIZER)),
    "op8_passages": _over("documents", passages.repeated_passages),
    "op9_simhash": _over("documents", simhash.near_duplicates),
    "op10_neighbours": _over("embeddings", lambda vectors: neighbours.neighbours(vectors, F.col("vec_id") % 20 == 0)),
    "op11_centroids": _over("embeddings", centroids.clusters),
    "op12_pii": _over("documents", pii.personal_data),
    "op13_repair": _over("conversations", repair.structure_repair),
    "pipeline": pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_licences": licences.sql(),
    "op3_warc": warc.SQL,
    "op5_exact_dedup": exact.SQL,
    "op6_sharding": sharding.SQL,
    "op11_centroids": centroids.sql(),
}
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL

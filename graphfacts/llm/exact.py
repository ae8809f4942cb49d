"""Exact duplicates with heavy hitters set apart.

A Misra-Gries sketch over the digests names those that may be frequent; their exact winners are computed from all
rows and broadcast, so the rows of frequent texts are decided where they lie. The other digests, none of which can
hold more than a small share of the rows, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphfacts.llm.shared import FIRST, kept_rows, text_key, text_of
from graphfacts.plans import tables

#: Digests whose winners may be broadcast, and counters of the sketch: both fixed, so the broadcast side is at most
#: HEAVY rows of some 60 bytes whatever the input.
HEAVY, TRACKED = 1000, 8192

# Only what changes is matched: runs of two or more, and single characters other than the plain space.
SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, digest)``: SHA-256 of each whole text, white space normalised; a null text counts as empty.
    ``text_key`` tells texts apart as they are."""
    return text_of(docs).select("doc_id", text_key(F.col("text")).alias("text_key"), F.unhex(F.sha2(F.regexp_replace("text", SPACES, " ").cast("binary"), 256)).alias("digest"))


def frequent(keys: DataFrame, column: str, heavy: int = HEAVY, tracked: int = TRACKED) -> list:
    """At most ``heavy`` values of a long column, among them those that hold more than a share of about 1/``heavy`` of the
    rows (Misra-Gries counters, ``tracked`` of them, merged over partitions; counts are estimates, so callers verify)."""
    top = keys.agg(F.expr(f"approx_top_k({column}, {heavy}, {tracked})").alias("top")).first()["top"]
    return [x["item"] for x in top or [] if x["item"] is not None]


def judged(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``(doc_id, text_key, digest, first, group_size)``, one row per input row: ``first`` names the row of its group that stays."""
    rows = tables.materialize(digests(docs)).withColumn("key", F.xxhash64("digest"))
    hot = frequent(rows, "key", heavy, tracked)
    winners = (rows.filter(F.col("key").isin(hot)).groupBy("digest")
               .agg(F.min(F.expr(FIRST)).alias("first"), F.count(F.lit(1)).alias("group_size"), F.lit(True).alias("verified")))
    # at most one row per frequent digest, computed once; bounded by `heavy`
    marked = rows.join(F.broadcast(tables.materialize(winners)), "digest", "left")
    same = Window.partitionBy("digest")
    names = ["doc_id", "text_key", "digest", "first", "group_size"]
    rest = (marked.filter("verified IS NULL").select("doc_id", "text_key", "digest")
            .select("*", F.min(F.expr(FIRST)).over(same).alias("first"), F.count(F.lit(1)).over(same).alias("group_size")))
    return marked.filter("verified").select(*names).unionByName(rest)


def exact_duplicates(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when they are identical after each run of ASCII white space became one space; null counts as
    empty, and empty texts are equal. The smallest ``doc_id`` of a group stays. Null identifiers never win against
    others; a group of nothing else keeps them (``keep_id`` null, ``kept`` true). Rows repeating a ``doc_id`` with the
    same text are one document: all get the same verdict and all count in ``group_size``. Other columns are ignored;
    an empty table gives an empty result.
    """
    keep = F.col("first.doc_id")
    return judged(docs, heavy, tracked).select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the smallest ``doc_id``, null ones last, and if
    that identifier has several writings of the text, of the smallest ``text_key``. Distinct texts all stay, whether they
    share an identifier or have none."""
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return kept_rows(docs, judged(docs).select("doc_id", "text_key", stays.alias("kept")))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

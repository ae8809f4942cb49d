"""SimHash near-duplicates found by pigeonring filtering.

Two 64-bit fingerprints that differ in at most three bits, cut into a ring of four 16-bit segments, have a segment
from which every chain of consecutive segments keeps within its proportional share of the budget: no difference in
the first, at most one in the first two, at most two in the first three. Links are therefore looked up by the first
two segments, the first exactly and the second up to one bit, then pruned by the third before the full check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.llm.shared import ASCII_LOWER, FIRST, classes, columns, kept_rows, text_key, text_of, unsigned_hex, working
from graphfacts.plans import tables

SEGMENTS, WIDTH, BUDGET, SHINGLE, SEED = 4, 16, 3, 3, 42
WORD = re.compile("[^\x20\x09-\x0D]+")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the text's word shingles as a signed 64-bit number; 0 without words."""
    words = WORD.findall(text.translate(ASCII_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(" ".join(words[i:i + shingle]).encode(), seed) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory however long the text
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """``(doc_id, fp)`` and the columns given: ``fp`` is the fingerprint as a long. One row per input row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for texts, *others in columns(batches, "text", *names):
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, kind) for own, kind in zip(others, kinds)] + [pa.array([fingerprint(t) for t in texts], pa.int64())], [*names, "fp"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = text_of(docs)
    rows = rows.select("doc_id", *more, "text")
    names, kinds = rows.columns[:-1], [to_arrow_type(f.dataType) for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", fp long")


def _turned(fp: Column, segment: int) -> Column:
    """The fingerprint rotated so that the given segment stands in the lowest bits."""
    k = WIDTH * segment
    return fp if not k else F.shiftrightunsigned(fp, k).bitwiseOR(F.shiftleft(fp, 64 - k))


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: every two of the distinct longs ``fp`` that differ in at most three bits.

    Each fingerprint asks under 68 keys (four starts; the second segment as it is and with each of its bits turned)
    and is found under four, so the volume is linear; a key holds two whole segments, 32 bits. Spark takes an exploded
    table for no larger than the one below it, so the join says that neither side is to be broadcast.
    """
    near = F.array(F.lit(0).cast("long"), *[F.lit(1 << (WIDTH + b)).cast("long") for b in range(WIDTH)])
    head = (1 << 2 * WIDTH) - 1
    turned = F.array(*[F.struct(F.lit(s).alias("s"), _turned(F.col("fp"), s).alias("r")) for s in range(SEGMENTS)])
    found = fps.select("fp", F.explode(turned).alias("t")).select(
        F.col("fp").alias("a"), F.col("t.s").alias("s"), F.col("t.r").alias("ra"), F.col("t.r").bitwiseAND(F.lit(head)).alias("key"))
    asked = fps.select("fp", F.explode(turned).alias("t")).select(
        F.col("fp").alias("b"), F.col("t.s").alias("s"), F.explode(near).alias("flip"), F.col("t.r").alias("rb")).select(
        "b", "s", "rb", F.col("rb").bitwiseAND(F.lit(head)).bitwiseXOR(F.col("flip")).alias("key"))
    both = F.col("ra").bitwiseXOR(F.col("rb"))
    chain = F.bit_count(both.bitwiseAND(F.lit((1 << 3 * WIDTH) - 1))) <= 3 * BUDGET // SEGMENTS
    return (found.hint("merge").join(asked, ["key", "s"]).filter((F.col("a") < F.col("b")) & chain & (F.bit_count(both) <= BUDGET))
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the smallest ``doc_id`` that is connected over links of at most three differing bits; texts of
    one fingerprint are one class, so copies are never expanded into pairs. Texts without words have fingerprint zero
    and are linked like any other. Null identifiers are carried along but never name a component unless it has no
    other. Other columns are ignored; an empty table gives an empty result.
    """
    rows, named = grouped(docs)
    return rows.join(named, "fp").select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Written rows ``(doc_id, fp)`` with the columns given, and written ``(fp, component, component_id)`` of every fingerprint."""
    rows = tables.materialize(fingerprints(docs, *more))
    first = tables.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = classes(links(first.select("fp")))
    each = first.join(parts.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = each.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows, tables.materialize(each.join(least, "component").select("fp", "component", "component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of near-equal texts, with all its columns: that of the smallest ``doc_id``, null ones last,
    and of the smallest ``text_key`` if that identifier has several of its texts. Texts far from all others stay,
    whether they share an identifier or have none."""
    rows, named = grouped(docs, text_key(F.col("text")).alias("text_key"))
    best = rows.join(named, "fp").groupBy("component").agg(F.min(F.expr(FIRST)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    verdicts = rows.join(named, "fp").join(tables.materialize(best), "component").select("doc_id", "text_key", stays.alias("kept"))
    return kept_rows(docs, verdicts)

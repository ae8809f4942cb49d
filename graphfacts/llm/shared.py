"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.plans import tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


#: Arrow's default of 10,000 rows a batch suits numbers; of texts it makes tens of megabytes for each task, several times
#: over on their way between the JVM and Python.
BATCH_ROWS = 1000
_ROWS, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def text_of(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the text (null: empty) and the named columns: whatever else a table carries stays out of the
    plan, so that its names cannot clash with ours. Unless the session names another size, batches become smaller."""
    conf = docs.sparkSession.conf
    if conf.get(_ROWS, _DEFAULT) == _DEFAULT:
        conf.set(_ROWS, str(BATCH_ROWS))
    return docs.select("doc_id", *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


SLICE = 250

_forget: dict[str, Callable[[], None]] = {}
_working: list[str] = []


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Registers what empties the memories that ``owner`` keeps in a Python worker from task to task."""
    _forget[owner] = forget


def working(owner: str) -> None:
    """Called where a task of ``owner`` begins: Spark reuses workers, so what other operators left behind goes first."""
    if _working != [owner]:
        for name, forget in _forget.items():
            if name != owner:
                forget()
        _working[:] = [owner]
        gc.collect()
        pa.default_memory_pool().release_unused()


def columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns as Python lists, a few rows at a time: Arrow's batches hold far more than a worker should
    have as Python objects at once."""
    for batch in batches:
        held = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, SLICE):
            yield tuple(c.slice(at, SLICE).to_pylist() for c in held)


def unused(table: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that the table does not use, in whatever case."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def unsigned_hex(name: str) -> Column:
    """A long as 16 lower-case hexadecimal digits, read as unsigned."""
    return F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))


def classes(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``: component = smallest id connected with it.

    Large-star and small-star contraction in turn: the rounds grow with the logarithm of the longest chain,
    each is two aggregations whose partial sums tame hubs, and only row counts and a checksum reach the driver.
    Null ends and self links are ignored; an empty table gives an empty result.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def mark(table: tables.Written) -> tuple:
        return tuple(table.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    pairs = tables.write(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, mark(pairs)
    while now != before:
        wide = pairs.df.unionByName(pairs.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tables.write(
            wide.join(smallest(wide), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = smallest(large.df)
        small = (large.df.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        pairs = tables.write(small)
        before, now = now, mark(pairs)
    stars = pairs.df.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def text_key(text: Column) -> Column:
    """Sixteen bytes that tell the texts of one identifier, or of none, apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


#: Of several rows the first: the smallest ``doc_id``, null ones last, then the smallest ``text_key``.
FIRST = "struct(doc_id IS NULL AS nameless, doc_id, text_key)"


def kept_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by ``verdicts(doc_id, text_key, kept)``, with all their columns. A row is what its identifier
    and its text are together: of equal ones a single one stays, and a row without a verdict stays.

    The rows that are judged duplicates are written first. A bitmap of their keys keeps the documents that are none of
    them where they lie; the rest is compared exactly.
    """
    name, own, mine, stays, both = unused(docs, "_id", "_text", "_key", "_kept", "_both")
    each = verdicts.groupBy(F.col("doc_id").alias(name), F.col("text_key").alias(own)).agg(F.bool_or("kept").alias(stays), F.count(F.lit(1)).alias("n"))
    special = tables.materialize(each.filter(~F.col(stays) | (F.col("n") > 1)).select(name, own, stays))
    keyed = docs.withColumn(mine, text_key(F.col("text"))).withColumn(both, F.xxhash64("doc_id", mine))
    maybe, none = sieved(keyed, both, special.select(F.xxhash64(name, own).alias(both)))
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(mine) == F.col(own))
    return none.unionByName(maybe.join(special, same, "left_anti")).unionByName(
        maybe.join(special.filter(F.col(stays)), same, "left_semi").dropDuplicates(["doc_id", mine])).drop(mine, both)


#: Bits of a sieve: half a megabyte, whatever it was built from.
SIEVE = 1 << 22


def sieved(table: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` whose ``key`` may occur in ``keys`` (one column), and those whose key surely does not.

    The keys' hashes set bits in a bitmap of fixed size, which is broadcast; an exact join of the first part follows.
    It saves shuffling wide rows for few keys. With very many keys it lets all rows pass, which costs but loses nothing.
    """
    part, bits, place = unused(table, "_part", "_bits", "_place")
    position = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)).cast("long")
    each = 4096 * 8  # bits of one bitmap
    bitmaps = tables.materialize(
        keys.select(position(F.col(keys.columns[0])).alias("p")).groupBy(F.floor(F.col("p") / each).alias(part))
        .agg(F.bitmap_construct_agg(F.col("p") % each).alias(bits)))
    marked = (table.withColumn(place, position(F.col(key))).withColumn(part, F.floor(F.col(place) / each))
              .join(F.broadcast(bitmaps), part, "left"))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(place) % each / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col(place) % 8).cast("int")) != 0, F.lit(False))
    return marked.filter(hit).select(*table.columns), marked.filter(~hit).select(*table.columns)

"""Placement by a permutation-filled lookup table.

Every shard ranks the slots of a prime-sized table by a permutation of its own (an offset and a stride, both hashed
from its name). The shards take turns; each claims the first slot of its ranking that is still free, until the table
is full. Shares then differ by one slot at most, and when a shard leaves, nearly all slots of the others stay theirs.
A row's slot is its key's hash modulo the table size, its shard one lookup in the broadcast table.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
SLOTS = 6553  # a prime, about a hundred slots for each shard


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. The size is a parameter, not a function of the data."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and distinct")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    table: list[str | None] = [None] * slots
    place = [_number(f"{s}/offset") % slots for s in shards]
    stride = [_number(f"{s}/stride") % (slots - 1) + 1 for s in shards]
    for turn in range(slots):
        i = turn % len(shards)
        while table[place[i]] is not None:
            place[i] = (place[i] + stride[i]) % slots
        table[place[i]] = shards[i]
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 15 hexadecimal digits of its MD5, modulo the table size; null counts as ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % slots


def assign(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``(doc_id, slot, shard)``, one row per input row.

    Rows with equal keys share a shard, repeated rows too; null keys share the slot of the empty key; the text is not
    read. No shuffle: the table of ``slots`` rows (a parameter, some 20 bytes a row) is broadcast. Other columns are
    ignored; an empty table gives an empty result.
    """
    table = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard string")
    return (docs.select("doc_id", slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(table), "slot")
            .select("doc_id", "slot", "shard"))


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5(name || '/offset'), 1, 15))::BIGINT % {SLOTS} AS start,
         ('0x' || substr(md5(name || '/stride'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS stride
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) r(i))),
prefer AS MATERIALIZED (
  SELECT s.i, list((s.start + k * s.stride) % {SLOTS} ORDER BY k) AS ranking FROM shards s, range({SLOTS}) r(k) GROUP BY s.i),
fill(turn, free, slot, shard) AS (
  SELECT 0::BIGINT, list_transform(range({SLOTS}), lambda x: true), NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT turn + 1, list_transform(free, lambda f, p: f AND p <> s + 1), s, i
  FROM (SELECT turn, free, p.i, list_filter(p.ranking, lambda x: free[x + 1])[1] AS s
        FROM fill JOIN prefer p ON p.i = turn % {len(SHARDS)} WHERE turn < {SLOTS}) t)
SELECT d.doc_id, d.slot, 'shard-' || lpad(f.shard::VARCHAR, 2, '0') AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN fill f USING (slot)
"""

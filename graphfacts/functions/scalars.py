"""Flags, durations and small integer mathematics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lock types and their codes.
LOCK_TYPES = {
    "ACQUIRE_CAUSES_WAKEUP": 0x10000000,
    "FULL_WAKE_LOCK": 0x0000001A,
    "ON_AFTER_RELEASE": 0x20000000,
    "PARTIAL_WAKE_LOCK": 0x00000001,
    "SCREEN_BRIGHT_WAKE_LOCK": 0x0000000A,
    "SCREEN_DIM_WAKE_LOCK": 0x00000006,
    "UNKNOWN": 0xFFFFFFFF,
}


def flag_types(flags: Column) -> Column:
    """Names of the lock types whose whole code is contained in the flags, sorted."""
    flags = flags.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    hits = [F.when(flags.bitwiseAND(F.lit(code)) == code, F.lit(name)) for name, code in LOCK_TYPES.items()]
    return F.array_compact(F.array(*hits))


def elapsed_seconds(text: Column) -> Column:
    """``2m3.5s`` → 123.5; null when the text has another form."""
    minutes = F.nullif(F.regexp_extract(text, r"(\d+)m([^s]*)s", 1), F.lit("")).cast("double")
    seconds = F.nullif(F.regexp_extract(text, r"(\d+)m([^s]*)s", 2), F.lit("")).try_cast("double")
    return minutes * 60 + seconds


def factorial(n: Column) -> Column:
    """Exact up to 20, null beyond."""
    return F.factorial(n.cast("int"))


def floor_log2(n: Column) -> Column:
    """Position of the highest bit; null unless n > 0. Exact for the whole long range."""
    return F.when(n > 0, F.length(F.bin(n.cast("long"))) - 1)


def is_power_of_2(n: Column) -> Column:
    n = n.cast("long")
    return (n > 0) & (n.bitwiseAND(n - F.when(n > 0, 1).otherwise(0)) == 0)


def ceil_log2(n: Column) -> Column:
    return F.when(n > 0, floor_log2(n) + F.when(is_power_of_2(n), 0).otherwise(1))


def pack_ints(high: Column, low: Column) -> Column:
    """Two 32-bit integers in one long."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

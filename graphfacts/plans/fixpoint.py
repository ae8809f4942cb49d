"""The semi-naive loop behind every recursive operator.

``total`` grows by ``delta`` until a round adds nothing. Each round joins only the newest rows, drops
what is already known and writes the rest as a table. The rounds' tables form tiers of eight which are
merged when full, so a loop of hundreds of rounds still scans few files and every row is rewritten only
a logarithmic number of times. Spark sees each table's true size, hence small deltas are broadcast and
large ones go through shuffles that adaptive execution splits when one key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.plans import tables

FAN_IN = 8
# Steps per round of a loop that runs to its end: each round's rows are compared and written once.
HOPS = 3
#: Beyond so many known rows, or edges, a round that begins with few new ones takes a single step. The new rows are broadcast to what they are joined
#: with and the candidates to the known rows, so that neither the known rows nor the edges are shuffled for them.
LARGE, FEW = 2_000_000, 250_000

Step = Callable[[DataFrame, DataFrame], DataFrame]


class Solution(NamedTuple):
    df: DataFrame
    rounds: int
    complete: bool


class LimitExceeded(RuntimeError):
    """A guard against runaway recursion was hit; no partial result is returned."""


def is_few(table: tables.Written) -> bool:
    return table.rows <= FEW and table.light


class Log:
    """Rows known so far, as a list of written tables merged in tiers.

    ``keys`` identify a row, ``pick`` gives the aggregate of every other column, ``better`` names the column
    in which a later row may improve an earlier one (see :func:`solve`).
    """

    def __init__(self, first: tables.Written, keys: Sequence[str] | None = None,
                 pick: dict[str, Callable[[str], Column]] | None = None, better: str | None = None):
        self.spark, self.schema = first.spark, first.schema
        self.names = first.schema.names
        self.keys = list(keys or self.names)
        self.pick = {c: (pick or {}).get(c, F.min) for c in self.names if c not in self.keys}
        self.better = better
        self.runs: list[tuple[int, tables.Written]] = [(0, first)]
        self.rows = first.rows
        self._width = tables.width(first.schema)
        # built once: a loop of many rounds should not assemble the same expressions again
        self._typed = [F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in first.schema.fields]
        self._picked = [f(c).alias(c) for c, f in self.pick.items()]
        self._df: DataFrame | None = None
        self._superseded: list[tables.Written] = []

    def add(self, run: tables.Written) -> None:
        """One more run, the last round's rows. Runs that were merged a round ago, which no open plan reads now, are dropped."""
        self._df = None
        tables.drop(*self._superseded)
        self._superseded = []
        self.runs.append((0, run))
        self.rows += run.rows
        while len(self.runs) >= FAN_IN:
            tail = self.runs[-FAN_IN:]
            tier = tail[0][0]
            if any(t != tier for t, _ in tail):
                return
            merged = tables.write(self._read(tail))
            self.runs[-FAN_IN:] = [(tier + 1, merged)]
            self._superseded += [w for _, w in tail]

    def _read(self, runs: list[tuple[int, tables.Written]]) -> DataFrame:
        return tables.read_all(self.spark, self.schema, [w.path for _, w in runs])

    def squash(self, df: DataFrame) -> DataFrame:
        """One row per key, columns in order and of the right type."""
        df = df.select(*self._typed)
        if not self.pick:
            return df.distinct()
        return df.groupBy(*self.keys).agg(*self._picked).select(*self.names)

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            every = self._read(self.runs)
            self._df = self.squash(every) if self.better else every
        return self._df

    def few(self, new: tables.Written, beside: int = 0) -> bool:
        """Whether the next round had better bring its rows to the known ones, or to ``beside`` rows of edges, than these to its rows."""
        return max(self.rows, beside) >= LARGE and is_few(new)

    def unknown(self, found: DataFrame, few: bool = False) -> DataFrame:
        """The squashed rows of ``found`` that are new or better. ``few``: there are probably few of them, so they are counted first."""
        known = None
        if few:
            counted = tables.write(found)
            self._superseded.append(counted)
            found = counted.df
            if is_few(counted):
                known = self._read(self.runs).join(F.broadcast(found.select(*self.keys)), self.keys, "left_semi")
                known = self.squash(known) if self.better else known
        if known is None:
            known = self.df
            if self.rows * self._width > tables.HEAVY:
                known = known.hint("merge")  # small files of many rows would be broadcast
        if not self.better:
            return found.join(known.select(*self.keys), self.keys, "left_anti")
        b = self.better
        old = known.select(*self.keys, F.col(b).alias("_old"))
        gain = F.col(b) > F.col("_old") if self.pick[b] is F.max else F.col(b) < F.col("_old")
        return found.join(old, self.keys, "left").filter(F.col("_old").isNull() | gain).select(*self.names)


def solve(
    seed: DataFrame,
    step: Step,
    keys: Sequence[str] | None = None,
    pick: dict[str, Callable[[str], Column]] | None = None,
    better: str | None = None,
    distinct: bool = True,
    hops: int = 1,
    rounds: int | None = None,
    max_rounds: int | None = None,
    max_rows: int | None = None,
    beside: int = 0,
) -> Solution:
    """Least fixpoint of ``step`` above ``seed``.

    keys      identify a row; default: all columns.
    pick      aggregate for each other column among candidates of one round (default ``F.min``).
    better    a non-key column in which later rounds may improve a known row; a smaller value wins if
              its ``pick`` is ``F.min``, a larger one if it is ``F.max``. Without it the first
              arrival stays.
    distinct  False when ``step`` can never produce a known row (growing paths).
    hops      apply ``step`` up to that many times per round before the result is compared and written; every
              ``pick`` must be a minimum or maximum that is right across hops. The result is the same for
              any number, so it is not combined with ``rounds``, where a round is one step.
    rounds    stop after that many rounds although more would follow (``complete`` tells).
    beside    how many rows the largest table has that ``step`` joins with: few new rows are brought to many of them.
    max_rounds, max_rows  guards that raise :class:`LimitExceeded`.
    """
    if rounds is not None and hops != 1:
        raise ValueError("a bounded run takes one step per round")
    delta = tables.write(_one_per_key(seed, keys, pick) if distinct else seed)
    log = Log(delta, keys, pick, better)

    def squash(df: DataFrame) -> DataFrame:
        return log.squash(df) if distinct else df.select(*log.names)

    def candidates(new: DataFrame, known: DataFrame, hops: int) -> DataFrame:
        found = squash(step(new, known))
        every = found
        for _ in range(hops - 1):
            found = squash(step(found, known))
            every = every.unionAll(found)
        return squash(every) if hops > 1 else every

    done = 0
    while delta.rows:
        if rounds is not None and done >= rounds:
            return Solution(log.df, done, False)
        if max_rounds is not None and done >= max_rounds:
            raise LimitExceeded(f"no fixpoint after {max_rounds} rounds")
        few = distinct and max_rounds is None and log.few(delta, beside)
        found = candidates(F.broadcast(delta.df), log.df, 1) if few else candidates(delta.df, log.df, hops)
        delta = tables.write(log.unknown(found, few) if distinct else found)
        done += 1
        if delta.rows:
            log.add(delta)
        if max_rows is not None and log.rows > max_rows:
            raise LimitExceeded(f"more than {max_rows} rows")
    return Solution(log.df, done, True)


def _one_per_key(seed: DataFrame, keys: Sequence[str] | None, pick: dict[str, Callable[[str], Column]] | None) -> DataFrame:
    rest = [c for c in seed.columns if keys and c not in keys]
    if not rest:
        return seed.distinct()
    return seed.groupBy(*keys).agg(*[(pick or {}).get(c, F.min)(c).alias(c) for c in rest]).select(*seed.columns)


def fixpoint(seed: DataFrame, step: Step, keys: Sequence[str] | None = None, **options) -> DataFrame:
    """:func:`solve`, result rows only."""
    return solve(seed, step, keys, **options).df

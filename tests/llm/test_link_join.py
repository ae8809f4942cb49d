"""The join that finds links between fingerprints is never broadcast: its sides are four and 68 times the table below."""

from pyspark.sql import functions as F

from graphfacts.llm import simhash
from graphfacts.plans import tables


def test_exploded_fingerprints_are_not_broadcast(spark):
    apart = [0b111, 1 << 40, (1 << 17) | (1 << 33) | (1 << 50)]
    base = [x * 0x9E3779B97F4A7C15 % (1 << 63) for x in range(1, 201)]
    near = [base[i] ^ apart[i % 3] for i in range(30)]
    far = [base[40] ^ 0b1111]
    fps = tables.materialize(spark.createDataFrame([(x,) for x in {*base, *near, *far}], "fp long"))
    found = simhash.links(fps)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    every = sorted({*base, *near, *far})
    expected = {(a, b) for i, a in enumerate(every) for b in every[i + 1:] if bin(a ^ b).count("1") <= 3}
    assert len(expected) >= 30
    assert {tuple(r) for r in found.select(F.col("a"), F.col("b")).collect()} == expected

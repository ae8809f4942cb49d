"""Branches on constants beside many cases."""

from conftest import rows
from pyspark.sql import functions as F

from graphfacts.operators import program
from graphfacts.plans import tables


def test_cases_are_not_broadcast(make):
    branches = make.table([("g", 1, "switch", 2, None), ("g", 2, "switch", 9, None), ("g", 3, "switch", None, None), ("g", 4, "lt", 1, 2)],
                          "graph_id string, block int, op string, left int, right int")
    labels = make.table([("g", b) for b in (1, 2, 3)], "graph_id string, block int").withColumn("label", F.explode(F.array(*map(F.lit, (1, 2, None)))))
    cases = tables.materialize(labels.withColumn("target", F.concat(F.lit("t"), F.coalesce(F.col("label").cast("string"), F.lit("*")))))
    found = program.branch_taken(branches, cases)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.fillna("", ["target"]), "block", "target") == [(1, "t2"), (2, "t*"), (3, ""), (4, "")]

"""Rounds of few new rows over many known ones."""

from conftest import rows
from pyspark.sql import functions as F

from graphfacts.operators import graph, paths, tabulation
from graphfacts.plans import fixpoint, tables

CHAIN = {"g": [(i, i + 1) for i in range(5)] + [(4, 2), (3, 30)], "h": [(1, 2), (2, 1), (2, 3)]}


def answers(make):
    edges = make.edges(CHAIN)
    cost = edges.withColumn("cost", F.col("src") % 3 + 1)
    super_edges = edges.select("graph_id", "src", "dst", F.lit("normal").alias("label"), F.lit(None).cast("long").alias("call")).unionByName(
        make.table([("g", 3, 100, "call", None), ("g", 101, 4, "return", 3), ("g", 100, 101, "normal", None)],
                   "graph_id string, src long, dst long, label string, call long"))
    seeds = make.table([("g", 0, -1, 0, -1)], "graph_id string, entry long, d1 long, node long, d2 long")
    found = [graph.reachable(edges, make.nodes({"g": [0], "h": [1]})), paths.distances(cost),
             tabulation.tabulate(super_edges, seeds, unbalanced=True).df]
    return [rows(df, *df.columns) for df in found]


def test_rounds_of_few_rows_give_the_same(make, monkeypatch):
    expected = answers(make)
    monkeypatch.setattr(fixpoint, "LARGE", 0)
    monkeypatch.setattr(fixpoint, "FEW", 6)
    assert answers(make) == expected


def test_known_rows_are_not_shuffled_for_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "LARGE", 1000)
    log = fixpoint.Log(tables.write(spark.range(5000).select((F.col("id") * 2).alias("id"))))
    found = log.unknown(spark.range(10, 14).select("id"), few=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert rows(found, "id") == [(11,), (13,)]

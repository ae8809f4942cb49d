"""Pairs of types are compared by lists of what is above them."""

from pyspark.sql import functions as F

from graphfacts.operators import hierarchy
from graphfacts.plans import tables


def test_a_pair_stays_one_row(make, monkeypatch):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(12)]
    leaves = [f"x{i}" for i in range(20)]
    up = chain + [(x, "t0") for x in leaves] + [("x1", "i"), ("x2", "i"), ("i", "j"), ("x3", "j"), ("u", None), ("v", None), ("v", "t3"), ("w", "v")]
    closure = tables.materialize(hierarchy.ancestors(make.table([("g", *e) for e in up], "graph_id string, sub string, sup string")))
    asked = [(a, b) for a in leaves for b in leaves if a < b]
    odd = [("x0", "x0"), ("x0", "t3"), ("t3", "x0"), ("x0", "nothing"), (None, "x0"), (None, None), ("u", "v"), ("u", "u"), ("w", "v"), ("u", "x0"), ("x0", "x0")]
    pairs = make.table([("g", *p) for p in asked + odd] + [(None, "x0", "x1"), ("h", "x0", "x1")], "graph_id string, a string, b string")
    sets = pairs.select("graph_id", F.struct("a", "b").alias("set"), F.explode(F.array("a", "b")).alias("member"))
    expected = [tuple(r) for r in hierarchy.common_supertypes(closure, sets).select("graph_id", "set.a", "set.b", "supertype").collect()]
    written, plain = [], tables.write

    def counted(df, *more):
        written.append(plain(df, *more))
        return written[-1]

    monkeypatch.setattr(tables, "write", counted)
    got = [tuple(r) for r in hierarchy.least_common_supertypes(closure, pairs).select("graph_id", "a", "b", "supertype").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert ("g", "x1", "x2", "i") in got and ("g", "x1", "x3", "j") in got and ("g", "x4", "x5", "t0") in got and ("g", "u", "v", None) in got
    assert max(w.rows for w in written) <= len(asked) + len(odd)  # 13 common types each would be 2470

"""Few new rows beside many edges, graphs that are done before others, and many rows in small files."""

from conftest import rows
from pyspark.sql import functions as F

from graphfacts.operators import graph, heap, tabulation
from graphfacts.plans import fixpoint, tables


def facts(spark, n):
    return spark.range(n).select(F.lit("one").alias("graph_id"), "id")


def supergraph(make):
    """Graphs of different depth, each a procedure that calls another; one is without name."""
    edges, seeds = [], []
    for g, n in (("a", 1), ("b", 1), ("c", 6), (None, 1)):
        edges += [(g, i, i + 1, "normal", None) for i in range(n)]
        edges += [(g, n, 100, "call", None), (g, 100, 101, "normal", None), (g, 101, n + 1, "return", n), (g, n + 1, n + 2, "normal", None), (g, 101, 50, "return", 49)]
        seeds.append((g, 0, -1, 0, -1))
    seeds.append(("a", 100, -1, 100, -1))
    return (make.table(edges, "graph_id string, src long, dst long, label string, call long"),
            make.table(seeds, "graph_id string, entry long, d1 long, node long, d2 long"))


def test_graphs_that_are_done_leave_the_loop(make, monkeypatch):
    edges, seeds = supergraph(make)
    paths = lambda solution: sorted((tuple(r) for r in solution.df.select(*tabulation.PATH).collect()), key=repr)
    expected = paths(tabulation.tabulate(edges, seeds, unbalanced=True))
    for module in (fixpoint, tabulation):
        monkeypatch.setattr(module, "LARGE", 1, raising=False)
    monkeypatch.setattr(tabulation, "RETIRE", 3, raising=False)
    written, plain = [], tables.write

    def counted(df, *more):
        written.append(plain(df, *more))
        return written[-1]

    monkeypatch.setattr(tables, "write", counted)
    found = tabulation.tabulate(edges, seeds, unbalanced=True)
    assert found.complete and paths(found) == expected
    assert len({w.rows for w in written if w.schema.names == ["graph_id", "src", "dst", "label", "call"]}) > 1


def test_few_rows_beside_many_edges_are_broadcast(spark, make, monkeypatch):
    monkeypatch.setattr(fixpoint, "LARGE", 1000)
    known, new = tables.write(facts(spark, 10)), tables.write(facts(spark, 3))
    assert fixpoint.Log(known).few(new, 1000) and not fixpoint.Log(known).few(new, 999)
    monkeypatch.setattr(fixpoint, "LARGE", 2)
    chain = make.edges({"g": [(i, i + 1) for i in range(9)], "h": [(1, 2)]})
    assert len(rows(graph.reachable(chain, make.nodes({"g": [0], "h": [1]})), "graph_id", "id")) == 12


def test_many_known_rows_in_small_files_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "HEAVY", 1000, raising=False)
    log = fixpoint.Log(tables.write(facts(spark, 5000)))
    found = log.unknown(facts(spark, 5002))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "id") == [(5000,), (5001,)]
    assert not fixpoint.is_few(tables.write(facts(spark, 200)))


def test_flows_are_not_broadcast_to_points(make, monkeypatch):
    names = {"allocs": "method var obj type", "assigns": "method dst src cast", "loads": "dst base field", "stores": "base field src", "direct_calls": "method site target",
             "virtual_calls": "method site receiver selector", "args": "site pos var", "results": "site var", "params": "method pos var", "returns": "method var",
             "dispatch": "type selector method"}
    one = {k: make.table([("g", *(0 if c == "pos" else c for c in v.split()))], "graph_id string, " + ", ".join(f"{c} {'int' if c == 'pos' else 'string'}" for c in v.split()))
           for k, v in names.items()}
    steps = []
    monkeypatch.setattr(heap, "fixpoint", lambda seed, step: steps.append(step) or seed)
    heap.points_to(one, make.table([("g", "method")], "graph_id string, method string"), make.table([("g", "type", "cast")], "graph_id string, sub string, sup string"))
    row = tables.materialize(make.table([("g", k, "a", "b", "c") for k in ("pts", "flow", "call", "live")], "graph_id string, kind string, a string, b string, c string"))
    plan = steps[0](row, row)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2

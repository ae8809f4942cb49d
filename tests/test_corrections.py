"""Results that must be whole or an error: no cut by length, size or look."""

import pytest
from pyspark.sql import functions as F

from graphfacts.operators import heap, paths, program, resource, tabulation
from graphfacts.plans import fixpoint
from graphfacts.sources import text


def test_long_simple_paths_are_found_or_refused(make):
    edges = make.edges({"g": [(i, i + 1) for i in range(6)]})
    assert [r["path"] for r in paths.simple_paths(edges, make.nodes({"g": [0]}), make.nodes({"g": [6]})).collect()] == [list(range(7))]
    with pytest.raises(fixpoint.LimitExceeded):
        paths.simple_paths(edges, make.nodes({"g": [0]}), make.nodes({"g": [6]}), max_paths=3)


def test_only_the_first_line_is_the_heading(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n\nx y\n1 2\nx y\n  #1 3\n4 5\n")
    found = text.read_table(spark, str(tmp_path / "a.txt"))
    assert sorted(map(tuple, found.collect())) == [("#1", "3"), ("1", "2"), ("4", "5"), ("x", "y")]


def test_bounded_runs_take_one_step_per_round(make):
    edges = make.table([("g", i, i + 1, "normal", None) for i in range(8)], "graph_id string, src long, dst long, label string, call long")
    seeds = make.table([("g", 0, 7, 0, 7)], "graph_id string, entry long, d1 long, node long, d2 long")
    bounded = tabulation.tabulate(edges, seeds, rounds=2)
    assert bounded.df.count() == 3 and not bounded.complete
    assert tabulation.tabulate(edges, seeds).df.count() == 9
    with pytest.raises(ValueError):
        fixpoint.solve(seeds, lambda new, _: new, rounds=2, hops=3)


def states_at(make, cg):
    blocks = make.table([("g", i, i + 1, "normal") for i in range(1, 4)], "graph_id string, src long, dst long, label string")
    calls = make.table([("g", 1, 1)], "graph_id string, site long, block long")
    ends = make.table([("g", 9, 90)], "graph_id string, method long, id long")
    graph = program.supergraph(blocks, calls, cg, ends, ends)
    ops = make.table([("g", 1, "L", "acquire", ["C"])], "graph_id string, block long, lock string, op string, contexts array<string>")
    entries = make.table([("g", 1, 1)], "graph_id string, node long, entry long")
    return sorted(r["node"] for r in resource.resource_states(graph, ops, entries).collect()), {r["label"] for r in graph.collect()}


def test_a_call_without_callee_passes_the_state_on(make):
    none = make.table([], "graph_id string, site long, dst long")
    nodes, labels = states_at(make, none)
    assert nodes == [1, 2, 3, 4] and labels == {"normal", "call_none_to_return"}
    some = make.table([("g", 1, 9)], "graph_id string, site long, dst long")
    nodes, labels = states_at(make, some)
    assert nodes == [1, 2, 3, 4, 90] and "call_to_return" in labels  # through the callee, whose entry is its exit


def test_service_rules_need_their_callback(spark, make):
    callbacks = make.table([("g", "A", "Service", "onCreate"), ("g", "B", "Service", "onCreate"), ("g", "B", "Service", "onStartCommand"), ("g", "B", "Service", "onBind"),
                            ("g", "U", "UnresolvedComponent", "onSomething")], "graph_id string, component string, kind string, selector string")
    held = make.table([("g", c, s, "L", True, [c]) for c, s in [("A", "onCreate"), ("B", "onStartCommand"), ("B", "onBind"), ("U", "onSomething")]],
                      "graph_id string, component string, selector string, lock string, acquired boolean, contexts array<string>")
    before = resource.neighbour_callbacks(callbacks, resource.lifecycle_rules(spark), forward=False)
    found = resource.violations(held, callbacks, resource.policy_rules(spark), before)
    assert sorted((r["component"], r["violation"], r["selector"]) for r in found.collect()) == [
        ("B", "SERVICE_ONSTART", "onStartCommand"), ("B", "SERVICE_ONUNBIND", "onUnbind"), ("U", "UNRESOLVED_CALLBACK_LOCKED", "onSomething")]


def test_budget_is_told_for_each_pointer(make):
    t = lambda rows, names: make.table(rows, ", ".join(f"{n} string" for n in ["graph_id", *names]))
    facts = {"assigns": t([("g", "b", "a"), ("g", "c", "b"), ("g", "d", "c"), ("g", "y", "x")], ["dst", "src"]),
             "loads": t([], ["dst", "base", "field"]), "stores": t([], ["base", "field", "src"]), "allocs": t([("g", "a", "o"), ("g", "x", "p")], ["var", "obj"])}
    asked = t([("g", "d"), ("g", "y"), ("g", "q")], ["pk"])
    found = {(r["pk"], r["obj"], r["status"]) for r in heap.demand_points_to(facts, asked, rounds=1).collect()}
    assert found == {("d", None, "BUDGETEXCEEDED"), ("y", "p", "SUCCESS"), ("q", None, "NOMOREREFINE")}


def test_the_last_word_counts(make):
    flags = make.table([("g", "L", 1)], "graph_id string, lock string, flags long")
    counted = make.table([("g", "L", 1, True), ("g", "L", 2, False)], "graph_id string, lock string, at long, value boolean")
    assert resource.metadata(flags, counted).select("ref_counted").first()[0] == "FALSE"


def test_scan_counts(make):
    rows = [("g", "m", "getfield", "a"), ("g", "m", "getfield", "a"), ("g", "m", "getfield", "b"), ("g", "m", "invoke", "x"), ("g", "m", "invoke", "x"), ("g", "m", "catch", None)]
    found = program.method_scan(make.table(rows, "graph_id string, method string, kind string, operand string")).first()
    assert (found["fields_read"], found["call_sites"], found["caught_types"], found["allocations"]) == (2, 2, 0, 0)

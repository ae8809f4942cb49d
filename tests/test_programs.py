"""Points-to, slices, tabulation and resource states on small programs."""

from conftest import rows

from graphfacts.operators import dominance, heap, resource, slicing, tabulation

G = "graph_id string"
EDGE = f"{G}, src long, dst long, label string, call long"
# procedure A = 1..6 (calls C at 2 and 4, return sites 3 and 5), C = 10..11
TWO_CALLS = [
    ("p", 1, 2, "normal", None), ("p", 2, 10, "call", None), ("p", 11, 3, "return", 2), ("p", 3, 4, "normal", None),
    ("p", 4, 10, "call", None), ("p", 11, 5, "return", 4), ("p", 5, 6, "normal", None), ("p", 10, 11, "normal", None),
    ("p", 2, 3, "call_to_return", None), ("p", 4, 5, "call_to_return", None)]


def test_definitions_follow_matching_returns(make):
    edges = make.table(TWO_CALLS, EDGE)
    # 1 defines x, 4 is preceded by a definition at 3, the callee redefines nothing
    defs = make.table([("p", 1, 7, 100), ("p", 3, 7, 300)], f"{G}, node long, target long, definition long")
    rich, flow = tabulation.redefine(edges, defs)
    zero = tabulation.nothing()
    seeds = make.table([("p", 1, 1)], f"{G}, entry long, node long").select("graph_id", "entry", zero.alias("d1"), "node", zero.alias("d2"))
    found = tabulation.tabulate(rich, seeds, flow=flow)
    at = found.df.selectExpr("entry", "d1.definition d1", "node", "d2.definition d2")
    assert found.complete
    assert rows(at.filter("node = 6 and d2 <> -1"), "entry", "d2") == [(1, 300)]
    assert rows(at.filter("node = 3 and d2 <> -1"), "entry", "d2") == [(1, 100)]
    assert rows(at.filter("entry = 10 and node = 11"), "d1", "d2") == [(-1, -1), (100, 100), (300, 300)]
    assert not tabulation.tabulate(rich, seeds, flow=flow, rounds=2).complete


def test_slices_ignore_unmatched_calls(make):
    parts = {
        "data": make.table([("s", 1, 2), ("s", 10, 11), ("s", 4, 5), ("s", 7, 8)], f"{G}, src long, dst long"),
        "param": make.table([("s", 2, 10, 90), ("s", 5, 10, 91)], f"{G}, src long, dst long, call long"),
        "return": make.table([("s", 11, 7, 90), ("s", 11, 9, 91)], f"{G}, src long, dst long, call long")}
    dep = slicing.dependence_graph(parts)
    one = lambda n: make.nodes({"s": [n]})
    assert rows(slicing.forward_slice(dep, one(1)), "id") == [(1,), (2,), (7,), (8,), (10,), (11,)]
    assert rows(slicing.backward_slice(dep, one(9)), "id") == [(4,), (5,), (9,), (10,), (11,)]
    assert rows(slicing.forward_slice(dep, one(10)), "id") == [(7,), (8,), (9,), (10,), (11,)]


def test_points_to_builds_the_call_graph(make):
    t = lambda rows_, names: make.table([("h", *r) for r in rows_], f"{G}, " + ", ".join(f"{n} string" for n in names.split()))
    facts = {
        "allocs": t([("main", "a", "o1", "A"), ("main", "b", "o2", "B"), ("idle", "z", "o9", "A")], "method var obj type"),
        "assigns": t([("main", "c", "a", None), ("main", "c", "b", None), ("main", "d", "c", "B")], "method dst src cast"),
        "loads": t([("e", "c", "f")], "dst base field"), "stores": t([("a", "f", "b")], "base field src"),
        "direct_calls": t([], "method site target"), "virtual_calls": t([("main", "v", "c", "run")], "method site receiver selector"),
        "args": make.table([("h", "v", 1, "b")], f"{G}, site string, pos int, var string"),
        "results": t([("v", "r")], "site var"),
        "params": make.table([("h", "A.run", 0, "this_a"), ("h", "A.run", 1, "pa"), ("h", "B.run", 0, "this_b"), ("h", "B.run", 1, "pb")], f"{G}, method string, pos int, var string"),
        "returns": t([("A.run", "pa")], "method var"), "dispatch": t([("A", "run", "A.run"), ("B", "run", "B.run")], "type selector method")}
    sub = t([("A", "A"), ("B", "B")], "sub sup")
    got = heap.points_to(facts, t([("main",)], "method"), sub)
    assert rows(got.points_to, "pk", "obj") == [
        ("a", "o1"), ("b", "o2"), ("c", "o1"), ("c", "o2"), ("d", "o2"), ("e", "o2"), ("o1.f", "o2"), ("pa", "o2"), ("pb", "o2"),
        ("r", "o2"), ("this_a", "o1"), ("this_b", "o2")]
    assert rows(got.calls, "site", "dst") == [("v", "A.run"), ("v", "B.run")]
    assert rows(got.methods, "method") == [("A.run",), ("B.run",), ("main",)]
    casts = t([("k", "c", "B")], "cast_site pk target")
    assert rows(heap.unsafe_casts(casts, got.points_to, sub), "obj") == [("o1",)]


def test_resource_states(make):
    # 1 acquire, 2 branch (is-held test: false branch to 4), 3 release by the same component, 5 release by another
    edges = make.table([("r", a, b, l, None) for a, b, l in [
        (1, 2, "normal"), (2, 3, "normal"), (2, 4, "normal"), (3, 6, "normal"), (2, 5, "normal"), (5, 7, "normal"), (7, 8, "normal"), (1, 9, "exceptional")]], EDGE)
    ops = make.table([("r", 1, "L", "acquire", ["c1"]), ("r", 3, "L", "release", ["c1", "c2"]), ("r", 5, "L", "release", ["c2"]), ("r", 7, "L", "release", ["c3"])],
                     f"{G}, block long, lock string, op string, contexts array<string>")
    entries = make.table([("r", n, 1) for n in range(1, 10)], f"{G}, node long, entry long")
    tests = make.table([("r", 2, "L", "is_held", 3, 4)], f"{G}, block long, lock string, op string, when_true long, when_false long")
    got = resource.resource_states(edges, ops, entries, kills=resource.branch_kills(tests))
    assert rows(got, "node", "acquired", "is_async", "contexts") == [
        (1, True, False, ["c1"]), (2, True, False, ["c1"]), (3, True, False, ["c1"]), (5, True, False, ["c1"]), (6, False, False, ["c1"]),
        (7, False, True, ["c1"]), (8, False, True, ["c1", "c3"])]
    merged = resource.merge_states(got.filter("node in (6, 7)"), ["graph_id", "lock"])
    assert rows(merged, "acquired", "timed", "is_async", "state") == [(False, False, True, "ASYNC_RELEASED")]


def test_unbalanced_states_reach_all_callers(make):
    ops = make.table([("p", 10, "L", "acquire", ["c"])], f"{G}, block long, lock string, op string, contexts array<string>")
    entries = make.table([("p", 10, 10)], f"{G}, node long, entry long")
    got = resource.resource_states(make.table(TWO_CALLS, EDGE), ops, entries)
    assert rows(got, "node") == [(3,), (4,), (5,), (6,), (10,), (11,)]


def test_violations_use_preceding_callback(spark, make):
    cb = make.table([("a", "C", "Activity", s) for s in ("onCreate", "onResume", "onStop")], f"{G}, component string, kind string, selector string")
    rules, policy = resource.lifecycle_rules(spark), resource.policy_rules(spark)
    assert rows(resource.lifecycle_graph(cb, rules), "src", "dst") == [
        ("onCreate", "onResume"), ("onResume", "onResume"), ("onResume", "onStop"), ("onStop", "onCreate"), ("onStop", "onResume")]
    before = resource.neighbour_callbacks(cb, rules, forward=False)
    state = make.table([("a", "C", "onResume", "L", True, ["C"]), ("a", "C", "onStop", "L", True, ["D"])],
                       f"{G}, component string, selector string, lock string, acquired boolean, contexts array<string>")
    assert rows(resource.violations(state, cb, policy, before), "violation", "selector") == [("ACTIVITY_ONPAUSE", "onPause")]


def test_post_domination_over_all_exits(make):
    e = make.edges({"m": [(1, 2), (2, 3), (3, 4), (3, 5), (2, 6), (6, 3)]})
    got = dominance.post_dominated(e, make.nodes({"m": [4, 5]}), make.table([("m", 1, 3), ("m", 1, 6), ("m", 3, 4)], f"{G}, id long, by long"))
    assert rows(got, "id", "by", "holds") == [(1, 3, True), (1, 6, False), (3, 4, False)]


def test_acquire_without_release_is_reported(make):
    e = make.edges({"m": [(1, 2), (2, 3), (2, 4), (3, 5), (4, 5)]})
    ops = make.table([("m", 1, "A", "acquire"), ("m", 1, "B", "acquire"), ("m", 5, "A", "release"), ("m", 3, "B", "release")], f"{G}, block long, lock string, op string")
    assert rows(resource.released_after(e, make.nodes({"m": [5]}), ops), "lock", "released") == [("A", True), ("B", False)]


def test_dependence_is_derived_from_what_statements_do(make):
    """1 writes x and the heap; 2 branches to 3 or 4; 3 writes x anew; 5 reads both; 4 surely overwrites the heap; 6 is the exit."""
    edge, at = f"{G}, src long, dst long", f"{G}, node long, target string"
    flow = make.table([("p", *e) for e in ((1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6))], edge)
    touched = make.table([("p", 1, "write", "h"), ("p", 4, "write", "h"), ("p", 5, "read", "h"), ("p", 3, "read", "h")], f"{G}, stmt long, kind string, loc string")
    parts = slicing.from_facts(
        flow, make.nodes({"p": [6]}), make.table([("p", 1, "x"), ("p", 3, "x")], at), make.table([("p", 5, "x"), ("p", 4, "x")], at), touched,
        make.table([("p", 4, "h")], f"{G}, stmt long, loc string"), crossing=make.table(TWO_CALLS, EDGE))
    assert rows(parts["data"], "src", "dst") == [(1, 4), (1, 5), (3, 5)]
    assert rows(parts["heap"], "src", "dst") == [(1, 3), (1, 5), (4, 5)]
    assert rows(parts["control"], "src", "dst") == [(2, 3), (2, 4)]
    assert rows(parts["param"], "src", "dst", "call") == [(2, 10, 2), (4, 10, 4)] and rows(parts["return"], "src", "dst", "call") == [(11, 3, 2), (11, 5, 4)]
    dep = slicing.dependence_graph({k: v for k, v in parts.items() if k in ("data", "heap", "control")})
    assert rows(slicing.backward_slice(dep, make.nodes({"p": [5]})), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(slicing.thin_slice(dep, parts["heap"], make.nodes({"p": [4]})), "id") == [(1,), (4,)]


def test_backward_problem_mirrors_the_forward_one(make):
    """What reaches 6 from 1 going forward is what 1 is reached by from 6 going backward, calls matched on both ways."""
    edges = make.table(TWO_CALLS, EDGE)
    seed = lambda n: make.table([("p", n, 0, n, 0)], f"{G}, entry long, d1 long, node long, d2 long")
    ahead = tabulation.tabulate(edges, seed(1)).df
    back = tabulation.tabulate(tabulation.reverse(edges), seed(6)).df
    assert rows(ahead.filter("entry = 1"), "node") == [(n,) for n in (1, 2, 3, 4, 5, 6)] == rows(back.filter("entry = 6"), "node")
    # a read at 6 demands variable 7 wherever no write intervenes; 4 writes it
    at = f"{G}, src long, fact long"
    flow = tabulation.gen_kill(0, make.table([("p", 6, 7)], at), make.table([("p", 4, 7)], at))
    found = tabulation.tabulate(tabulation.reverse(edges), seed(6), flow=flow).df
    assert rows(found.filter("d2 = 7 and entry = 6"), "node") == [(4,), (5,)]
    asked = make.table([("p", 6, 0, 4), ("p", 6, 0, 1)], f"{G}, entry long, d1 long, node long")
    assert rows(tabulation.facts_given(found, asked), "node", "d2") == [(1, 0), (4, 0), (4, 7)]


def test_flow_function_as_a_table(make):
    """A relation maps facts edge by edge; what it does not name ends."""
    edges = make.table(TWO_CALLS, EDGE)
    seed = make.table([("p", 1, 0, 1, 0)], f"{G}, entry long, d1 long, node long, d2 long")
    flow = make.table([("p", 1, 2, 0, 5), ("p", 2, 3, 5, 5), ("p", 3, 4, 5, 6)], f"{G}, src long, dst long, d_in long, d_out long")
    found = tabulation.tabulate(edges, seed, flow=tabulation.relation(flow)).df
    assert rows(found.filter("entry = 1"), "node", "d2") == [(1, 0), (2, 5), (3, 5), (4, 6)]

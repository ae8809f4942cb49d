"""What flows along cycles is kept once for each cycle; budgets are told without the next step."""

import pytest

from graphfacts.operators import dataflow, heap, resource

RING = [(f"v{i}", f"v{(i + 1) % 12}") for i in range(12)] + [(f"v{i}", f"v{(i + 5) % 12}") for i in range(12)]


@pytest.fixture
def kept(monkeypatch):
    found, plain = [], dataflow.accumulate

    def counted(*given):
        reach = plain(*given)
        found.append(reach.count())
        return reach

    monkeypatch.setattr(dataflow, "accumulate", counted)
    return found


def table(make, cols, rows):
    return make.table([("g", *r) for r in rows], ", ".join(f"{c} string" for c in ("graph_id", *cols)))


def test_pointers_on_a_cycle_share_their_objects(make, kept):
    facts = {"assigns": table(make, ["dst", "src"], [(b, a) for a, b in RING] + [("end", "v3"), ("v4", "start"), (None, "v1"), ("v2", None)]),
             "loads": table(make, ["dst", "base", "field"], [("read", "v1", "f")]), "stores": table(make, ["base", "field", "src"], [("v1", "f", "start")]),
             "allocs": table(make, ["var", "obj"], [(f"v{i}", f"o{i}") for i in range(12)] + [("start", "s")])}
    asked = table(make, ["pk"], [(f"v{i}",) for i in range(12)] + [("end",), ("read",), ("start",), ("lost",), ("lost",), (None,)])
    got = [tuple(r) for r in heap.demand_points_to(facts, asked).select("pk", "obj", "status").collect()]
    ring = [f"o{i}" for i in range(12)] + ["s"]
    expected = [(p, o, "SUCCESS") for p in [f"v{i}" for i in range(12)] + ["end"] for o in ring]
    expected += [("read", "s", "SUCCESS"), ("start", "s", "SUCCESS"), ("lost", None, "NOMOREREFINE"), (None, None, "NOMOREREFINE")]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert max(kept) < 60  # 12 variables with 13 objects would be 156


def test_starts_of_variables_on_a_cycle(make, kept):
    flows = table(make, ["dst", "src"], [(b, a) for a, b in RING] + [("w", "x")])
    constants = table(make, ["var", "cls"], [(f"v{i}", f"C{i}") for i in range(12)] + [("x", "C0"), ("x", "D"), ("x", "Unknown"), ("u", "Unknown")])
    starts = table(make, ["op", "caller", "var"], [("a", "m", "v1"), ("a", "m", "w"), ("a", "n", "v2"), ("b", "m", "v3"), ("b", "m", "v3"),
                                                   ("c", "m", "none"), ("d", "m", "u"), ("e", "m", "v5"), ("e", "m", "none"), (None, "m", "v1"), ("f", None, "x")])
    components = table(make, ["cls"], [(f"C{i}",) for i in range(12)] + [("D",)])
    ring = [f"C{i}" for i in range(12)]
    expected = [("a", c, k) for c in "mn" for k in [*ring, "D", None]] + [("b", "m", k) for k in ring] + [("c", "m", None), ("d", "m", None)]
    expected += [("e", "m", k) for k in [*ring, None]] + [(None, "m", None)] + [("f", None, k) for k in ("C0", "D", None)]
    got = resource.resolve_starts(flows, starts, constants, components).select("op", "caller", "component", "resolved").collect()
    assert sorted(((*r,) for r in got), key=repr) == sorted(((*r, r[2] is not None) for r in expected), key=repr)
    assert max(kept) < 60


def test_the_next_step_is_taken_only_where_it_must_be(make):
    hub = [("f", f"s{i}") for i in range(50)]
    back = table(make, ["at", "to"], [("a", "f"), ("b", "f"), ("c", "d"), ("d", "c"), ("e", "c"), *hub]).select("graph_id", "at", "to")
    near = [("a", "a"), ("a", "f"), ("b", "b"), ("b", "f"), ("c", "c"), ("c", "d"), ("e", "e"), ("e", "c"), ("q", "q")]
    taken = []

    def step(new, _):
        taken.append(new.count())
        return new.join(back, ["graph_id", "at"]).selectExpr("graph_id", "pk", "to as at")

    found = heap._unfinished(table(make, ["pk", "at"], near), back, step)
    assert {r["pk"] for r in found.collect()} == {"a", "b", "e"}
    assert taken == [3]  # those of c and q, none of the hub

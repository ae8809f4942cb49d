"""Programs whose points-to sets are found in one task give what rounds give."""

import random

from graphfacts.operators import contexts, heap

COLUMNS = {"allocs": "method var obj type", "assigns": "method dst src cast", "loads": "dst base field", "stores": "base field src", "direct_calls": "method site target",
           "virtual_calls": "method site receiver selector", "args": "site pos var", "results": "site var", "params": "method pos var", "returns": "method var",
           "dispatch": "type selector method"}


def program(make):
    """One program, and a small one with a null that is no key, which is left to the rounds."""
    draw = random.Random(3)
    v, m, t = (lambda: f"v{draw.randrange(12)}"), (lambda: f"m{draw.randrange(3)}"), (lambda: f"T{draw.randrange(3)}")
    rows = {
        "allocs": [(m(), v(), f"site:{i}", t()) for i in range(6)], "assigns": [(m(), v(), v(), draw.choice([None, None, "T0"])) for _ in range(10)],
        "loads": [(v(), v(), "f") for _ in range(4)], "stores": [(v(), "f", v()) for _ in range(4)], "direct_calls": [("m0", "d0", "m1"), ("m1", "d1", "m1")],
        "virtual_calls": [(m(), f"c{i}", v(), "run") for i in range(3)], "args": [(s, 1, v()) for s in ("d0", "d1", "c0", "c1")], "results": [(s, v()) for s in ("d0", "c0")],
        "params": [(f"m{i}", p, v()) for i in range(3) for p in (0, 1)], "returns": [(f"m{i}", v()) for i in range(3)], "dispatch": [(f"T{i}", "run", f"m{i}") for i in range(3)]}
    facts = {k: [("g", *r) for r in found] for k, found in rows.items()}
    facts["allocs"] += [("h", "m0", "v1", "site:a", "T0"), ("h", "m0", "v2", None, "T0"), ("h", None, "v2", "site:b", "T0")]
    schema = lambda names: "graph_id string, " + ", ".join(f"{c} {'int' if c == 'pos' else 'string'}" for c in names.split())
    tables = {k: make.table(facts[k], schema(names)) for k, names in COLUMNS.items()}
    text = lambda found, names: make.table(found, schema(names))
    return (tables, text([("g", "m0"), ("h", "m0"), (None, "m0")], "method"), text([("g", a, b) for a, b in (("T0", "T0"), ("T1", "T0"), ("T2", "T2"))], "sub sup"),
            text([("g", f"m{i}", f"v{j}") for i in range(3) for j in range(i, 12, 3)], "method var"), text([("g", "m2")], "method"))


def both(monkeypatch, run):
    alike = lambda: [sorted((tuple(r) for r in df.collect()), key=repr) for df in run()]
    found = alike()
    with monkeypatch.context() as patch:
        patch.setattr(heap, "ALONE", 0)
        assert alike() == found
    return found


def test_points_to(make, monkeypatch):
    facts, entries, subtypes, _, _ = program(make)
    seeds = []
    plain = heap.fixpoint
    monkeypatch.setattr(heap, "fixpoint", lambda seed, step: seeds.append(seed.count()) or plain(seed, step))
    found = both(monkeypatch, lambda: heap.points_to(facts, entries, subtypes))
    assert len(found[0]) > 15 and seeds == [2, 3]


def test_contexts(make, monkeypatch):
    facts, entries, subtypes, own, boxes = program(make)
    policy = contexts.receivers(contexts.call_string(2))
    assert len(both(monkeypatch, lambda: contexts.points_to({**facts, "locals": own}, entries, subtypes, policy, boxes, clone=True))[0]) > 15

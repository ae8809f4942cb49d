"""Random graphs, many per job, against plain Python."""

import random

import pytest
from conftest import rows

from graphfacts.operators import dataflow, dominance, graph


@pytest.fixture(scope="module")
def fleet():
    rng = random.Random(7)
    out = {}
    for k in range(12):
        n = rng.randint(2, 9)
        out[f"g{k}"] = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))})
    # one hub with most of the edges
    out["hub"] = sorted({(0, i) for i in range(1, 40)} | {(i, 0) for i in range(1, 20)} | {(i, i + 1) for i in range(1, 39)})
    return out


def reach(edges, start, avoid=None):
    seen, todo = set(), [start] if start != avoid else []
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        todo += [b for a, b in edges if a == n and b != avoid]
    return seen


def ids(edges):
    return sorted({x for e in edges for x in e})


def test_strong_components_and_levels(make, fleet):
    e = make.edges(fleet)
    nodes = graph.endpoints(e)
    want = []
    for g, es in fleet.items():
        r = {n: reach(es, n) for n in ids(es)}
        want += [(g, n, min(m for m in r[n] if n in r[m])) for n in ids(es)]
    assert rows(graph.strong_components(nodes, e), "graph_id", "id", "component") == sorted(want)
    level = {(r.graph_id, r.id): (r.component, r.level) for r in graph.topological_levels(nodes, e).collect()}
    for g, es in fleet.items():
        for a, b in es:
            (ca, la), (cb, lb) = level[g, a], level[g, b]
            assert ca == cb or la < lb


def test_weak_components(make, fleet):
    e = make.edges(fleet)
    want = []
    for g, es in fleet.items():
        both = es + [(b, a) for a, b in es]
        want += [(g, n, min(reach(both, n))) for n in ids(es)]
    assert rows(graph.weak_components(graph.endpoints(e), e), "graph_id", "id", "component") == sorted(want)


def test_dominators(make, fleet):
    e = make.edges(fleet)
    want = []
    for g, es in fleet.items():
        live = reach(es, 0) if any(0 in x for x in es) else set()
        want += [(g, n, d) for n in live for d in live if d == n or n not in reach(es, 0, avoid=d)]
    roots = make.nodes({g: [0] for g, es in fleet.items() if any(0 in x for x in es)})
    dom = dominance.dominators(e, roots)
    assert rows(dom, "graph_id", "id", "dominator") == sorted(want)


def test_colour_equals_greedy(make, fleet):
    e = make.edges(fleet)
    want = []
    for g, es in fleet.items():
        near = {n: {b for a, b in es if a == n} | {a for a, b in es if b == n} for n in ids(es)}
        near = {n: s - {n} for n, s in near.items()}
        got = {}
        for n in sorted(near, key=lambda n: (len(near[n]), n)):
            got[n] = next(c for c in range(len(near)) if c not in {got.get(m) for m in near[n]})
        want += [(g, n, c) for n, c in got.items()]
    assert rows(graph.colour(graph.endpoints(e), e), "graph_id", "id", "colour") == sorted(want)


def test_must_is_the_greatest_solution(make, fleet):
    rng = random.Random(3)
    gen = sorted({(g, rng.choice(ids(es)), rng.randrange(3)) for g, es in fleet.items() for _ in range(4)})
    kill = sorted({(g, rng.choice(ids(es)), rng.randrange(3)) for g, es in fleet.items() for _ in range(2)})
    want_in, want_out = [], []
    for g, es in fleet.items():
        root = ids(es)[0]
        live = reach(es, root)
        facts = {0, 1, 2}
        inn, out = {n: set(facts) for n in live}, {n: set(facts) for n in live}
        for _ in range(50):
            for n in live:
                preds = [a for a, b in es if b == n and a in live]
                inn[n] = set() if n == root else set.intersection(*[out[p] for p in preds])
                out[n] = (inn[n] - {f for h, m, f in kill if (h, m) == (g, n)}) | {f for h, m, f in gen if (h, m) == (g, n)}
        want_in += [(g, n, f) for n in live for f in inn[n]]
        want_out += [(g, n, f) for n in live for f in out[n]]
    s = "graph_id string, node long, fact int"
    flow = dataflow.must(make.edges(fleet), make.table(gen, s), make.nodes({g: ids(es)[:1] for g, es in fleet.items()}), make.table(kill, s))
    assert rows(flow.out, "graph_id", "node", "fact") == sorted(want_out)
    assert rows(flow.into, "graph_id", "node", "fact") == sorted(want_in)


def test_projection(make, fleet):
    members = {g: [n for n in ids(es) if n % 2 == 0] for g, es in fleet.items()}
    want = set()
    for g, es in fleet.items():
        for a in members[g]:
            seen, todo = set(), [b for x, b in es if x == a]
            while todo:
                n = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                if n in members[g]:
                    want.add((g, a, n))
                else:
                    todo += [b for x, b in es if x == n]
    assert rows(graph.project(make.edges(fleet), make.nodes(members)), "graph_id", "src", "dst") == sorted(want)

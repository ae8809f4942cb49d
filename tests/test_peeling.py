"""Peeling by counters: trimming, components and levels against a plain computation, and what a long chain costs."""

import random

import pytest

from conftest import rows
from graphfacts.operators import graph
from graphfacts.plans import tables
from graphfacts.plans.fixpoint import LimitExceeded


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.append(b)
                break
        else:
            todo.pop()
    return seen


def components(nodes, edges):
    r = {n: reach(edges, n) | {n} for n in nodes}
    return {n: min(m for m in nodes if m in r[n] and n in r[m]) for n in nodes}


def test_components_and_what_trimming_leaves(spark, make):
    rng = random.Random(5)
    graphs = {f"g{k}": sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(6 + 3 * k)}) for k in range(5)}
    nodes = {g: list(range(15)) for g in graphs}
    found = rows(graph.strong_components(make.nodes(nodes), make.edges(graphs)), "graph_id", "id", "component")
    assert found == sorted((g, n, c) for g, es in graphs.items() for n, c in components(nodes[g], es).items())
    plain = {g: [e for e in es if e[0] != e[1]] for g, es in graphs.items()}
    left = rows(graph._trim(tables.write(make.edges(plain))).df, "graph_id", "src", "dst")
    expected = []
    for g, es in plain.items():
        looped = {n for n in range(14) if n in reach(es, n)}
        behind = {n for n in range(14) if n in looped or any(n in reach(es, c) for c in looped)}
        before = {n for n in range(14) if n in looped or reach(es, n) & looped}
        expected += [(g, a, b) for a, b in es if {a, b} <= behind & before]
    assert left == sorted(expected)


def test_levels_and_a_cycle(make):
    edges = {"g": [(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)], "h": [(7, 8)]}
    nodes = make.nodes({"g": [1, 2, 3, 4, 5], "h": [7, 8]})
    assert rows(graph.dag_levels(nodes, make.edges(edges)), "graph_id", "id", "level") == [
        ("g", 1, 0), ("g", 2, 1), ("g", 3, 2), ("g", 4, 3), ("g", 5, 0), ("h", 7, 0), ("h", 8, 1)]
    with pytest.raises(LimitExceeded):
        graph.dag_levels(nodes, make.edges({**edges, "h": [(7, 8), (8, 7)]}))


def test_a_long_chain_is_written_once(make, monkeypatch):
    length, written = 40, []
    write = tables.write

    def counted(*given):
        done = write(*given)
        written.append(done.rows)
        return done

    monkeypatch.setattr(tables, "write", counted)
    chain = [(n, n + 1) for n in range(length)]
    assert graph._trim(write(make.edges({"g": chain}))).rows == 0
    assert sum(written) <= 8 * length  # a rewrite of what is left in every round would be length ** 2

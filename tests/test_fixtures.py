"""Literal graphs with known answers."""

from conftest import rows

from graphfacts.operators import dataflow, dominance, graph, paths, relational

FW = {"fw": [(1, 2), (2, 3), (3, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 8), (6, 4), (6, 2)]}
MATRIX = """
- - - - - - - - -
- - 1 2 3 3 4 4 5
- - 4 1 2 2 3 3 4
- - 3 4 1 1 2 2 3
- - 2 3 2 4 1 5 2
- - - - - - - 1 2
- - 1 2 1 3 2 4 1
- - - - - - - - 1
- - - - - - - - -"""


def letters(text):
    return [(text[i], text[i + 1]) for i in range(0, len(text), 2)]


def test_all_pairs_distances_and_paths(make):
    edges = make.edges(FW)
    dist = paths.distances(edges)
    want = sorted((i, j, int(d)) for i, line in enumerate(MATRIX.strip().splitlines()) for j, d in enumerate(line.split()) if d != "-")
    assert rows(dist, "src", "dst", "distance") == want
    pairs = make.edges({"fw": [(1, 3), (5, 8), (1, 7), (1, 6), (1, 8)]})
    found = paths.all_shortest_paths(edges, dist, pairs)
    assert rows(found, "src", "dst", "path") == [
        (1, 3, [2]), (1, 6, [2, 3, 4]), (1, 7, [2, 3, 5]), (1, 8, [2, 3, 4, 6]), (1, 8, [2, 3, 5, 7]), (5, 8, [7])]
    assert len(rows(paths.one_shortest_path(found), "src", "dst")) == 5


def test_weighted_distances_improve(make):
    e = make.edges({"w": [(1, 2, 10), (1, 3, 1), (3, 4, 1), (4, 2, 1), (2, 5, 1)]}, more=", cost int")
    assert rows(paths.distances(e, make.nodes({"w": [1]})), "dst", "distance") == [(2, 3), (3, 1), (4, 2), (5, 4)]


def test_breadth_first(make):
    e = make.edges({"b": [(i, j) for i in range(10) for j in (i - 1, i + 1, i + 2) if 0 <= j < 10]})
    one, eight = make.nodes({"b": [0]}), make.nodes({"b": [8]})
    assert [r.id for r in paths.shortest_path(e, one, eight).orderBy("position").collect()] == [8, 6, 4, 2, 0]
    assert [graph.within_hops(e, one, k).count() for k in (0, 1, 2, 3, 4, 5, 500)] == [1, 3, 5, 7, 9, 10, 10]


def test_dominators(make):
    e = make.edges({"d": [(10, 0), (10, 1), (0, 2), (1, 3), (2, 5), (3, 5), (4, 2), (5, 8), (6, 3), (7, 4), (8, 7), (8, 9), (9, 6)]})
    dom = dominance.dominators(e, make.nodes({"d": [10]}))
    assert rows(dom.filter("id = 4"), "dominator") == [(4,), (5,), (7,), (8,), (10,)]
    idom = dominance.immediate_dominators(dom)
    assert rows(idom.filter("idom = 5"), "id") == [(8,)]
    assert idom.filter("idom = 10").count() == 5


def test_simple_paths(make):
    cases = {
        "p1": ("ABBCBDCECFDGDHEIFIGJHJJKIKKL", "L", 4), "p2": ("ABBCBDCECFDGDHEIFIGJHJJKIKKCKL", "L", 4),
        "p3": ("ABBHBCBDCECFDGDHEIFIGJHJJKIKKCKL", "L", 5), "p4": ("ABACADAEBABCBDBECACBCDCEDADBDCDEEAEBECED", "E", 16)}
    e = make.edges({k: letters(t) for k, (t, _, _) in cases.items()}, kind="string")
    found = paths.simple_paths(e, make.nodes({k: ["A"] for k in cases}, "string"), make.nodes({k: [z] for k, (_, z, _) in cases.items()}, "string"), 10_000)
    assert rows(found.groupBy("graph_id").count(), "graph_id", "count") == [(k, n) for k, (_, _, n) in sorted(cases.items())]


def test_colouring(make):
    w8 = [(a, b) for a, bs in {1: (6, 7, 8), 2: (5, 7, 8), 3: (5, 6, 8), 4: (7, 6, 5)}.items() for b in bs]
    poly = [(f"poly{i}", f"poly{i % 5 + 1}") for i in range(1, 6)]
    w10 = poly + [(f"poly{i}", f"star{i}") for i in range(1, 6)] + [("star1", "star3"), ("star1", "star4"), ("star2", "star4"), ("star2", "star5"), ("star3", "star1"), ("star3", "star5")]
    both = {"w8": [(str(a), str(b)) for a, b in w8], "w10": w10}
    e = make.edges(both, kind="string")
    got = {(r.graph_id, r.id): r.colour for r in graph.colour(graph.endpoints(e), e).collect()}
    for g, es in both.items():
        assert all(got[g, a] != got[g, b] for a, b in es)
    assert len({c for (g, _), c in got.items() if g == "w8"}) <= 4
    assert len({c for (g, _), c in got.items() if g == "w10"}) == 3


def test_generate_along_edges(make):
    e = make.edges({"f": letters("ABBCBDCEDEEF")}, kind="string")
    gen = make.table([("f", c, i) for i, c in enumerate("ABCDEFGH")], "graph_id string, node string, fact int")

    def sets(flow):
        out = {}
        for n, f in rows(flow.out, "node", "fact"):
            out[n] = out.get(n, "") + str(f)
        return out

    assert sets(dataflow.may(e, gen)) == {"A": "0", "B": "01", "C": "012", "D": "013", "E": "01234", "F": "012345", "G": "6", "H": "7"}
    kill = make.table([("f", "B", "D", 0), ("f", "B", "C", 1)], "graph_id string, src string, dst string, fact int")
    got = sets(dataflow.may(e, gen, kill_edge=kill))
    assert (got["C"], got["D"], got["E"], got["F"]) == ("02", "13", "01234", "012345")


def test_relation(make):
    r = make.table([(3, 5), (3, 7), (3, 9), (3, 11), (5, 1)], "x int, y int")
    assert rows(relational.related_count(r), "x", "n") == [(3, 4), (5, 1)]
    less = relational.unrelate(r, make.table([(5, 1)], "x int, y int"))
    assert less.count() == 4 and relational.related(less, make.table([(5,)], "x int")).count() == 0


def test_union_find_of_a_long_chain(spark, make):
    n = 10_000
    pair = spark.range(n - 2).selectExpr("'u' as graph_id", "id as src", "id + 2 as dst")
    classes = graph.union_find(pair)
    assert rows(classes.groupBy("component").count(), "component", "count") == [(0, n // 2), (1, n // 2)]

"""Graph algebra: reachability, views, roots, integrity, components, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphfacts.plans import segments, tables
from graphfacts.plans.fixpoint import FEW, HOPS, LimitExceeded, fixpoint

G = "graph_id"


def _ends(edges: DataFrame) -> tables.Written:
    """The columns that traversal needs, computed once as a table."""
    return tables.write(edges.select(G, "src", "dst").distinct())


def invert(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(
        G, F.explode(F.array("src", "dst")).alias("id")
    ).distinct()


# --- reachability --------------------------------------------------------------------------------
def reachable(edges: DataFrame, sources: DataFrame, accept: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from any source, sources included: ``(graph_id, id)``.

    ``accept(graph_id, id)`` limits the nodes that may be entered (never the sources themselves).
    """
    if accept is not None:
        edges = edges.join(accept.select(G, F.col("id").alias("dst")), [G, "dst"], "left_semi")
    arcs = _ends(edges)
    onward = arcs.df.withColumnRenamed("src", "id")

    def step(new, _):
        return new.join(onward, [G, "id"]).select(G, F.col("dst").alias("id"))

    return fixpoint(sources.select(G, "id"), step, hops=HOPS, beside=arcs.rows)


def reachable_from_each(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(graph_id, source, id)`` for every source separately, the source included."""
    arcs = _ends(edges)
    onward = arcs.df.withColumnRenamed("src", "id")

    def step(new, _):
        return new.join(onward, [G, "id"]).select(G, "source", F.col("dst").alias("id"))

    return fixpoint(sources.select(G, F.col("id").alias("source"), "id"), step, hops=HOPS, beside=arcs.rows)


def backward_closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes from which a target is reachable, targets included."""
    return reachable(invert(edges), targets)


def reaches(edges: DataFrame, interesting: DataFrame) -> DataFrame:
    """``(graph_id, id, target)``: which interesting nodes each node can reach (itself included)."""
    return reachable_from_each(invert(edges), interesting).select(
        G, "id", F.col("source").alias("target")
    )


def within_hops(edges: DataFrame, sources: DataFrame, hops: int | None) -> DataFrame:
    """Breadth-first search from all sources at once: ``(graph_id, id, hop, parent)``.

    ``parent`` is the smallest predecessor one hop nearer, null at the sources; ``hops`` bounds the
    search (None: to the end).
    """
    arcs = _ends(edges)
    onward = arcs.df.withColumnRenamed("src", "id")
    start = F.struct(F.lit(0).alias("hop"), F.lit(None).cast(arcs.schema["src"].dataType).alias("parent"))

    def step(new, _):
        return new.join(onward, [G, "id"]).select(
            G, F.col("dst").alias("id"), F.struct((F.col("via.hop") + 1).alias("hop"), F.col("id").alias("parent")).alias("via"))

    found = fixpoint(sources.select(G, "id", start.alias("via")), step, [G, "id"], rounds=hops,
                     hops=1 if hops is not None else HOPS)
    return found.select(G, "id", "via.hop", "via.parent")


# --- views ---------------------------------------------------------------------------------------
def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node, 0 where it has no edge."""
    sides = edges.select(G, F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
        edges.select(G, F.col("dst").alias("id"), F.lit(0), F.lit(1))
    )
    counted = sides.groupBy(G, "id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select(G, "id").join(counted, [G, "id"], "left").fillna(0, ["out_degree", "in_degree"])


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(G, "id").join(edges.select(G, F.col("dst").alias("id")), [G, "id"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(G, "id").join(edges.select(G, F.col("src").alias("id")), [G, "id"], "left_anti")


def keep_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(G, F.col("id").alias(end)), [G, end], "left_semi")
    return edges.select(G, "src", "dst", *[c for c in edges.columns if c not in (G, "src", "dst")])


def prune(nodes: DataFrame, edges: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Subgraph induced by the nodes that satisfy ``predicate``."""
    kept = nodes.filter(predicate)
    return kept, keep_edges(edges, kept)


def project(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges a→b between members joined by a path whose inner nodes are all non-members."""
    arcs = _ends(edges)
    members = tables.materialize(members.select(G, "id").distinct())
    outside = arcs.df.join(members.select(G, F.col("id").alias("src")), [G, "src"], "left_anti")
    onward = tables.materialize(outside.select(G, F.col("src").alias("dst"), F.col("dst").alias("to")))
    seed = arcs.df.join(members.select(G, F.col("id").alias("src")), [G, "src"], "left_semi").select(G, "src", "dst")

    def step(new, _):
        return new.join(onward, [G, "dst"]).select(G, "src", F.col("to").alias("dst"))

    return fixpoint(seed, step, hops=HOPS).join(
        members.select(G, F.col("id").alias("dst")), [G, "dst"], "left_semi").select(G, "src", "dst")


def contract(nodes: DataFrame, edges: DataFrame, missing: DataFrame) -> DataFrame:
    """Remove nodes, linking each removed node's predecessors with its successors."""
    return project(edges, nodes.select(G, "id").join(missing.select(G, "id"), [G, "id"], "left_anti"))


def union_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return a[0].unionByName(b[0]).distinct(), a[1].unionByName(b[1]).distinct()


def not_subgraph(small: tuple[DataFrame, DataFrame], large: tuple[DataFrame, DataFrame]) -> DataFrame:
    """What the smaller graph has and the larger lacks; empty when it is a subgraph."""
    lost_nodes = small[0].select(G, "id").subtract(large[0].select(G, "id"))
    lost_edges = small[1].select(G, "src", "dst").subtract(large[1].select(G, "src", "dst"))
    return lost_nodes.select(G, F.lit("node").alias("kind"), F.col("id").alias("src"), F.col("id").alias("dst")).unionByName(
        lost_edges.select(G, F.lit("edge").alias("kind"), "src", "dst")
    )


def integrity(nodes: DataFrame, edges: DataFrame, inverse: DataFrame | None = None) -> DataFrame:
    """Violations: dangling ends, repeated edges and nodes, and edges missing from a stored inverse."""
    found = []
    for end in ("src", "dst"):
        lost = edges.select(G, F.col(end).alias("id")).join(nodes.select(G, "id"), [G, "id"], "left_anti")
        found.append(lost.groupBy(G, "id").agg(F.count(F.lit(1)).alias("n")).select(
            G, F.lit(f"dangling {end}").alias("problem"), F.col("id").alias("src"), F.col("id").alias("dst"), "n"))
    twice = edges.groupBy(G, "src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found.append(twice.select(G, F.lit("repeated edge").alias("problem"), "src", "dst", "n"))
    again = nodes.groupBy(G, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found.append(again.select(G, F.lit("repeated node").alias("problem"), F.col("id").alias("src"), F.col("id").alias("dst"), "n"))
    if inverse is not None:
        back = inverse.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
        for problem, a, b in (("no predecessor entry", edges, back), ("no successor entry", back, edges)):
            odd = a.select(G, "src", "dst").subtract(b.select(G, "src", "dst"))
            found.append(odd.select(G, F.lit(problem).alias("problem"), "src", "dst", F.lit(1).cast("long").alias("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def labelled_degrees(edges: DataFrame, end: str = "src") -> DataFrame:
    """Per node and label: number of distinct neighbours."""
    other = "dst" if end == "src" else "src"
    return edges.groupBy(G, F.col(end).alias("id"), "label").agg(F.count_distinct(other).alias("n"))


def successors_by_label(edges: DataFrame, label) -> DataFrame:
    return edges.filter(F.col("label") == F.lit(label)).select(G, "src", "dst").distinct()


def predecessors_by_label(edges: DataFrame, label) -> DataFrame:
    return invert(successors_by_label(edges, label))


def edge_labels(edges: DataFrame) -> DataFrame:
    return edges.groupBy(G, "src", "dst").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def normal_flow(edges: DataFrame, entries: DataFrame, normal: str = "normal") -> DataFrame:
    """Drop edges of other labels and the nodes that no entry reaches any more."""
    kept = successors_by_label(edges, normal)
    return keep_edges(kept, reachable(kept, entries))


def drop_caught_exits(edges: DataFrame, exits: DataFrame, caught: DataFrame) -> DataFrame:
    """Drop exceptional edges into an exit for every (src, exception) that is caught.

    ``edges(graph_id, src, dst, label, exception)``; ``caught(graph_id, src, exception)``.
    """
    into_exit = exits.select(G, F.col("id").alias("dst"), F.lit(True).alias("_exit"))
    handled = caught.select(G, "src", "exception", F.lit(True).alias("_caught")).distinct()
    return (
        edges.join(into_exit, [G, "dst"], "left")
        .join(handled, [G, "src", "exception"], "left")
        .filter(~(F.coalesce("_exit", F.lit(False)) & (F.col("label") == "exceptional") & F.coalesce("_caught", F.lit(False))))
        .select(*edges.columns)
    )


def quotient(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges between ``keys(graph_id, id, key)`` classes, one per pair of classes."""
    a = keys.select(G, F.col("id").alias("src"), F.col("key").alias("a"))
    b = keys.select(G, F.col("id").alias("dst"), F.col("key").alias("b"))
    return edges.join(a, [G, "src"]).join(b, [G, "dst"]).select(G, F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def explode_blocks(instructions: DataFrame, block_edges: DataFrame) -> DataFrame:
    """One node per instruction: ``instructions(graph_id, block, idx, id)`` chained inside a block, block
    edges drawn from the last instruction to the first of the next block."""
    w = Window.partitionBy(G, "block").orderBy("idx")
    inner = instructions.select(G, F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).filter("dst is not null")
    ends = instructions.groupBy(G, "block").agg(F.min_by("id", "idx").alias("first"), F.max_by("id", "idx").alias("last"))
    outer = block_edges.join(ends.select(G, F.col("block").alias("src"), F.col("last").alias("a")), [G, "src"]).join(
        ends.select(G, F.col("block").alias("dst"), F.col("first").alias("b")), [G, "dst"])
    return inner.unionByName(outer.select(G, F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()


def predecessor_position(edges: DataFrame, order: Sequence[str] = ("src",)) -> DataFrame:
    """Position, from 0, of each predecessor among those of its node; a node may have any number of them."""
    keys = [G, "dst", *[c for c in order if c not in (G, "dst")]]
    return segments.positions(edges.select(*dict.fromkeys([G, "src", "dst", *keys])), [G, "dst"], list(order), "position").select(
        G, "src", "dst", "position")


# --- components ----------------------------------------------------------------------------------
def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, id, component)``, component = smallest id. Alternating large-star and small-star
    contraction: the number of rounds grows with the logarithm of the graph, not with its depth."""

    def minimum(pairs):  # pairs (u, v) both ways → smallest of u and its neighbours
        return pairs.groupBy(G, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def both_ways(pairs):
        return pairs.unionByName(pairs.select(G, F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(t):
        r = t.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(G, "u", "v"))).first()
        return tuple(r)

    pairs = tables.write(
        edges.filter("src <> dst").select(G, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    last, now = None, mark(pairs)
    while now != last:
        wide = both_ways(pairs.df)
        large = wide.join(minimum(wide), [G, "u"]).filter("v > u").select(G, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.materialize(large.filter("u <> v"))
        low = minimum(large)
        small = large.join(low, [G, "u"]).select(
            G, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        pairs = tables.write(small)
        last, now = now, mark(pairs)
    stars = pairs.df.groupBy(G, F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select(G, "id").distinct().join(stars, [G, "id"], "left").withColumn(
        "component", F.coalesce("component", "id"))


def union_find(pairs: DataFrame) -> DataFrame:
    """Classes of the equivalence generated by ``pairs(graph_id, src, dst)``."""
    return weak_components(endpoints(pairs), pairs)


def _peel(edges: DataFrame, seed: DataFrame, by: Sequence[str] = (G,)) -> DataFrame:
    """``(*by, id, level)`` of the nodes that a peeling from ``seed(*by, id)`` takes off: a node is ready in the round after
    its last predecessor, level = that round. A node on a cycle, or behind one, is never ready.

    Predecessors are counted down: an edge of the distinct ``edges(*by, src, dst)`` is followed once, in the round its source is ready,
    and a round writes only the nodes that were met, with how many of their predecessors were."""
    need = edges.groupBy(*by, "dst").agg(F.count(F.lit(1)).alias("need"))
    arcs = tables.materialize(edges.join(need, [*by, "dst"]).select(*by, F.col("src").alias("id"), "dst", "need"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    now = tables.write(seed.select(*by, "id", zero.alias("met"), zero.alias("need"), F.lit(0).alias("level")), "met = need")
    rounds = [now]
    while now.hits:
        ready = now.df.filter("met = need").select(*by, "id")
        followed = (F.broadcast(ready) if now.hits <= FEW else ready).join(arcs, [*by, "id"]).select(
            *by, F.col("dst").alias("id"), one.alias("met"), "need")
        waiting = now.df.filter("met < need").select(*by, "id", "met", "need")
        now = tables.write(
            followed.unionByName(waiting).groupBy(*by, "id").agg(F.sum("met").alias("met"), F.max("need").alias("need"))
            .withColumn("level", F.lit(len(rounds))), "met = need")
        rounds.append(now)
    return _read(rounds).filter("met = need").select(*by, "id", "level")


def _trim(edges: tables.Written) -> tables.Written:
    """The edges whose ends are on or between cycles. Peeled off are, in one loop, the nodes that no cycle reaches (side ``down``)
    and those that reach none (side ``up``); what neither side takes is left."""
    e = edges.df
    by = (G, "side")
    sides = e.select(G, F.lit("down").alias("side"), "src", "dst").unionByName(
        e.select(G, F.lit("up").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    seed = sides.select(*by, F.col("src").alias("id")).distinct().join(
        sides.select(*by, F.col("dst").alias("id")), [*by, "id"], "left_anti")
    gone = tables.write(_peel(sides, seed, by).select(G, "id").distinct())
    if not gone.rows:
        return edges
    for end in ("src", "dst"):
        e = e.join(gone.df.select(G, F.col("id").alias(end)), [G, end], "left_anti")
    return tables.write(e.select(G, "src", "dst"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, id, component)``, component = smallest id of the strongly connected component.

    Trim, colour every remaining node with the smallest id that reaches it, take from each colour's
    namesake the nodes that reach it back inside the colour (a whole component), drop them, repeat.
    """
    left = _trim(tables.write(edges.filter("src <> dst").select(G, "src", "dst").distinct()))
    found: list[tables.Written] = []
    while left.rows:
        e = left.df
        spread = e.withColumnRenamed("src", "id")

        def lower(new, _, spread=spread):
            return new.join(spread, [G, "id"]).select(G, F.col("dst").alias("id"), "colour")

        colours = tables.materialize(
            fixpoint(endpoints(e).withColumn("colour", F.col("id")), lower, [G, "id"], better="colour", hops=HOPS, beside=left.rows))
        same = (
            e.join(colours.select(G, F.col("id").alias("src"), F.col("colour").alias("component")), [G, "src"])
            .join(colours.select(G, F.col("id").alias("dst"), F.col("colour").alias("component")), [G, "dst", "component"])
            .select(G, "component", "src", F.col("dst").alias("id"))
        )
        same = tables.materialize(same)

        def back(new, _, same=same):
            return new.join(same, [G, "id", "component"]).select(G, F.col("src").alias("id"), "component")

        heads = colours.filter("id = colour").select(G, "id", F.col("colour").alias("component"))
        whole = tables.write(fixpoint(heads, back, hops=HOPS, beside=left.rows))
        found.append(whole)
        rest = e
        for end in ("src", "dst"):
            rest = rest.join(whole.df.select(G, F.col("id").alias(end)), [G, end], "left_anti")
        left = _trim(tables.write(rest.select(G, "src", "dst")))
    every = nodes.select(G, "id").distinct()
    if not found:
        return every.withColumn("component", F.col("id"))
    return every.join(_read(found), [G, "id"], "left").withColumn("component", F.coalesce("component", "id"))


def condensation(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different components, one per pair."""
    return quotient(edges, components.withColumnRenamed("component", "key")).filter("src <> dst")


def topological_levels(nodes: DataFrame, edges: DataFrame, bottom_up: bool = False) -> DataFrame:
    """``(graph_id, id, component, level)``: level = longest path from a root in the graph of components.
    Ordering by ``(level, component, id)`` is a topological order; ``bottom_up`` works on the inverse."""
    components = tables.materialize(strong_components(nodes, edges))
    dag = condensation(components, edges)
    levels = dag_levels(components.select(G, F.col("component").alias("id")).distinct(), invert(dag) if bottom_up else dag)
    return components.join(levels.withColumnRenamed("id", "component"), [G, "component"]).select(G, "id", "component", "level")


def dag_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest distance from a root of an acyclic graph, by peeling: a node is ready in the round after
    its last predecessor, so every edge is looked at once. Raises on a cycle."""
    edges, nodes = _ends(edges).df, nodes.select(G, "id").distinct()
    levels = tables.write(_peel(edges, roots(nodes, edges)))
    if levels.rows != nodes.count():
        raise LimitExceeded("the graph has a cycle: take its condensation first")
    return levels.df


def _read(parts: list[tables.Written]) -> DataFrame:
    return tables.read_all(parts[0].spark, parts[0].schema, [w.path for w in parts])


def cycle_edges(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside a strongly connected component, self loops included: the graph is acyclic iff there
    is none, and without them it becomes acyclic."""
    a = components.select(G, F.col("id").alias("src"), F.col("component").alias("a"))
    b = components.select(G, F.col("id").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, [G, "src"]).join(b, [G, "dst"]).filter("a = b").select(*edges.columns)


def acyclic(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(graph_id, cycle_edges, acyclic)`` over the part reachable from ``sources`` (default: all)."""
    if sources is not None:
        nodes = tables.materialize(reachable(edges, sources))
        edges = keep_edges(edges, nodes)
    looped = cycle_edges(strong_components(nodes, edges), edges).groupBy(G).agg(F.count(F.lit(1)).alias("cycle_edges"))
    return nodes.select(G).distinct().join(looped, G, "left").fillna(0, ["cycle_edges"]).withColumn(
        "acyclic", F.col("cycle_edges") == 0)


# --- colouring -----------------------------------------------------------------------------------
def colour(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy vertex colouring in the order (degree, id), as rounds in which every node whose earlier
    neighbours are all coloured takes the smallest colour they leave free."""
    pairs = edges.filter("src <> dst").select(G, "src", "dst")
    pairs = tables.materialize(pairs.unionByName(invert(pairs)).distinct())
    degree = pairs.groupBy(G, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    def rank(end):
        return degree.select(G, F.col("id").alias(end), F.col("degree").alias(f"{end}_degree"))

    later = pairs.join(rank("src"), [G, "src"]).join(rank("dst"), [G, "dst"]).filter(
        F.struct("src_degree", "src") < F.struct("dst_degree", "dst"))
    later = tables.materialize(later.select(G, "src", "dst"))
    seed = roots(nodes.select(G, "id").distinct(), later).withColumn("colour", F.lit(0))

    def step(new, done):
        touched = new.select(G, F.col("id").alias("src")).join(later, [G, "src"]).select(G, "dst").distinct()
        before = later.join(touched, [G, "dst"], "left_semi").join(
            done.select(G, F.col("id").alias("src"), "colour"), [G, "src"], "left")
        # one row per (node, colour) before the collection: its size is the number of colours
        seen = before.groupBy(G, "dst", "colour").agg(F.count(F.lit(1)).alias("n"))
        free = seen.groupBy(G, "dst").agg(
            F.collect_list("colour").alias("used"), F.bool_and(F.col("colour").isNotNull()).alias("ready"))
        return free.filter("ready").select(
            G, F.col("dst").alias("id"),
            F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")).alias("colour"))

    return fixpoint(seed, step, [G, "id"])

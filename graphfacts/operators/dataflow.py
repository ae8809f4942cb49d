"""Monotone dataflow over graphs; facts in long form ``(graph_id, node, fact)``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfacts.operators import graph
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.plans.fixpoint import HOPS, fixpoint

FACT = [G, "node", "fact"]
#: Into so many slices the members of a set are dealt where they are listed for every holder.
SLICES = 32


class Flow(NamedTuple):
    """Facts before (``into``) and after (``out``) each node."""

    into: DataFrame
    out: DataFrame


def _across(edges: DataFrame, out: DataFrame, kill_edge: DataFrame | None) -> DataFrame:
    """Facts leaving nodes, moved over the edges that let them pass."""
    moved = out.withColumnRenamed("node", "src").join(edges, [G, "src"]).select(G, "src", F.col("dst").alias("node"), "fact")
    if kill_edge is not None:
        moved = moved.join(kill_edge.select(G, "src", F.col("dst").alias("node"), "fact"), [G, "src", "node", "fact"], "left_anti")
    return moved.select(*FACT)


def accumulate(edges: DataFrame, gen: DataFrame) -> DataFrame:
    """Everything generated at a node or at any node leading to it."""
    return may(edges, gen).out


def may(edges: DataFrame, gen: DataFrame, kill_node: DataFrame | None = None, kill_edge: DataFrame | None = None,
        backward: bool = False) -> Flow:
    """Union meet: out = (in minus kill) plus gen."""
    if backward:
        edges = graph.invert(edges)
        kill_edge = None if kill_edge is None else graph.invert(kill_edge)
    arcs = tables.write(edges.select(G, "src", "dst").distinct())
    edges = arcs.df

    def step(new, _):
        moved = _across(edges, new, kill_edge)
        return moved if kill_node is None else moved.join(kill_node.select(*FACT), FACT, "left_anti")

    out = fixpoint(gen.select(*FACT), step, hops=HOPS, beside=arcs.rows)
    return Flow(_across(edges, out, kill_edge).distinct(), out)


def shrink(candidates: DataFrame, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Largest part of ``candidates(graph_id, node, fact)`` in which every fact not in ``keep`` is also
    present at each predecessor of its node.

    Works on refutations: first the candidates some predecessor lacks, then what falls with them.
    """
    candidates = tables.materialize(candidates.select(*FACT).distinct())
    open_ = tables.materialize(candidates.join(keep.select(*FACT), FACT, "left_anti"))
    arcs = tables.write(edges.select(G, "src", "dst").distinct())
    edges = arcs.df
    lacking = (
        open_.withColumnRenamed("node", "dst").join(edges, [G, "dst"])
        .join(candidates.withColumnRenamed("node", "src"), [G, "src", "fact"], "left_anti")
        .select(G, F.col("dst").alias("node"), "fact").distinct())

    def step(new, _):
        return _across(edges, new, None).join(open_, FACT, "left_semi")

    return candidates.join(fixpoint(lacking, step, hops=HOPS, beside=arcs.rows), FACT, "left_anti")


def must(edges: DataFrame, gen: DataFrame, entries: DataFrame, kill_node: DataFrame | None = None,
         kill_edge: DataFrame | None = None, backward: bool = False) -> Flow:
    """Intersection meet, greatest solution, over nodes reachable from ``entries(graph_id, id)``.

    A fact that must hold also may hold, so the union solution is the candidate set and no
    node × fact product is built. Nothing holds before an entry.
    """
    if backward:
        edges = graph.invert(edges)
        kill_edge = None if kill_edge is None else graph.invert(kill_edge)
    inside = tables.materialize(graph.reachable(edges, entries))
    edges = tables.materialize(graph.keep_edges(edges.select(G, "src", "dst").distinct(), inside))
    gen = tables.materialize(gen.join(inside.withColumnRenamed("id", "node"), [G, "node"], "left_semi").select(*FACT).distinct())
    weak = may(edges, gen, kill_node, kill_edge)
    out = tables.materialize(weak.out)
    free = tables.materialize(out.join(gen, FACT, "left_anti"))
    # refuted at once: at an entry, over an edge that kills, or absent at a predecessor
    first = free.join(entries.select(G, F.col("id").alias("node")), [G, "node"], "left_semi")
    if kill_edge is not None:
        first = first.unionByName(free.join(kill_edge.join(edges, [G, "src", "dst"], "left_semi").select(G, F.col("dst").alias("node"), "fact"), FACT, "left_semi"))
    absent = free.withColumnRenamed("node", "dst").join(edges, [G, "dst"]).join(
        out.withColumnRenamed("node", "src"), [G, "src", "fact"], "left_anti")
    first = first.unionByName(absent.select(G, F.col("dst").alias("node"), "fact"))

    def step(new, _):
        return _across(edges, new, None).join(free, FACT, "left_semi")

    strong = tables.materialize(out.join(fixpoint(first, step), FACT, "left_anti"))
    # before a node: carried by every incoming edge
    fan_in = edges.groupBy(G, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    carried = _across(edges, strong, kill_edge).groupBy(*FACT).agg(F.count(F.lit(1)).alias("n"))
    into = carried.join(fan_in, [G, "node"]).filter("n = edges").join(
        entries.select(G, F.col("id").alias("node")), [G, "node"], "left_anti").select(*FACT)
    return Flow(into, strong)


def boolean(nodes: DataFrame, edges: DataFrame, settings: DataFrame, entries: DataFrame, meet: str = "may") -> DataFrame:
    """``(graph_id, id, before, after)``: a flag set to true or false by ``settings(graph_id, id, value)``
    and unchanged elsewhere; ``may`` joins with OR, ``must`` with AND. Nodes reachable from entries only
    for ``must``."""
    fact = F.lit(1).alias("fact")
    gen = settings.filter("value").select(G, F.col("id").alias("node"), fact)
    kill = settings.filter("not value").select(G, F.col("id").alias("node"), fact)
    if meet == "may":
        into, out = may(edges, gen, kill)
        scope = nodes.select(G, "id").distinct()
    else:
        into, out = must(edges, gen, entries, kill)
        scope = graph.reachable(edges, entries)
    flag = lambda df, name: df.select(G, F.col("node").alias("id"), F.lit(True).alias(name))
    return scope.join(flag(into, "before"), [G, "id"], "left").join(flag(out, "after"), [G, "id"], "left").select(
        G, "id", F.coalesce("before", F.lit(False)).alias("before"), F.coalesce("after", F.lit(False)).alias("after"))


def reaching_definitions(edges: DataFrame, definitions: DataFrame, cut: DataFrame | None = None) -> Flow:
    """Which ``definitions(graph_id, node, target, definition)`` may reach each node: a definition dies at
    every other definition of its target. ``cut(graph_id, src, dst, label)`` lists edges nothing crosses (call
    to return, in the interprocedural form); without a label it cuts every edge between the two nodes, with one
    only the edge so labelled."""
    if cut is not None:
        edge = [G, "src", "dst"] + [c for c in ("label",) if c in cut.columns and c in edges.columns]
        edges = edges.join(cut.select(*edge), edge, "left_anti")
    gen = definitions.select(G, "node", F.col("definition").alias("fact"))
    return killing_flow(edges, gen, definitions.select(G, "node", "target"), definitions.select(G, F.col("definition").alias("fact"), "target"))


def defined_before(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(graph_id, node, target, definition)``: the definitions that reach a node from before it."""
    into = reaching_definitions(edges, definitions).into.select(G, "node", F.col("fact").alias("definition"))
    return into.join(definitions.select(G, "definition", "target").distinct(), [G, "definition"]).select(G, "node", "target", "definition")


def killing_flow(edges: DataFrame, gen: DataFrame, writes: DataFrame, targets: DataFrame) -> Flow:
    """Union flow in which a node kills all facts about the targets it writes.

    The facts carry their target along, so the kill is one anti join on (node, target) and the quadratic
    relation of definitions that kill one another is never built.
    """
    arcs = tables.write(edges.select(G, "src", "dst").distinct())
    edges = arcs.df
    writes = tables.materialize(writes.select(G, "node", "target").distinct())
    seed = gen.join(targets.select(G, "fact", "target").distinct(), [G, "fact"]).select(*FACT, "target")

    def across(new):
        return new.withColumnRenamed("node", "src").join(edges, [G, "src"]).select(
            G, F.col("dst").alias("node"), "fact", "target")

    def step(new, _):
        return across(new).join(writes, [G, "node", "target"], "left_anti")

    out = fixpoint(seed, step, hops=HOPS, beside=arcs.rows)
    return Flow(across(out).select(*FACT).distinct(), out.select(*FACT))


def live_values(uses: DataFrame, phi: DataFrame) -> DataFrame:
    """Values used by something other than a phi, or by a live phi. ``uses(graph_id, value, by_phi)``,
    ``phi(graph_id, result, operand)``."""
    seed = uses.filter("not by_phi").select(G, F.col("value").alias("id")).distinct()
    return graph.reachable(phi.select(G, F.col("result").alias("src"), F.col("operand").alias("dst")), seed)


def dead_values(values: DataFrame, uses: DataFrame, phi: DataFrame) -> DataFrame:
    return values.select(G, "value").distinct().join(
        live_values(uses, phi).withColumnRenamed("id", "value"), [G, "value"], "left_anti")


def def_use(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """``(graph_id, value, def_node, use_node)``; values without a use keep one row with null."""
    return definitions.select(G, "value", F.col("node").alias("def_node")).join(
        uses.select(G, "value", F.col("node").alias("use_node")), [G, "value"], "left")


def use_counts(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    counted = uses.groupBy(G, "value").agg(F.count(F.lit(1)).alias("uses"))
    return definitions.select(G, "value").distinct().join(counted, [G, "value"], "left").fillna(0, ["uses"])


def live_at(edges: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """``(graph_id, node, value)``: the value may still be read after the node. Nodes are instructions; a
    use at the node itself counts for what lies before it."""
    gen = uses.select(G, "node", F.col("value").alias("fact"))
    kill = definitions.select(G, "node", F.col("value").alias("fact"))
    live = may(graph.invert(edges), gen, kill)
    return live.into.select(G, "node", F.col("fact").alias("value"))


def reaching_sets(flow: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(graph_id, value, set)`` and ``(graph_id, set, member)``: what is known at a value or at any value that flows into it.
    ``flow(graph_id, src, dst)``, ``known(graph_id, value, member)``. Values that reach one another know the same, so a strongly
    connected component is one set, and members move between components only."""
    flow = tables.materialize(flow.filter("src is not null and dst is not null").select(G, "src", "dst").distinct())
    known = tables.materialize(known.filter("value is not null").select(G, "value", "member").distinct())
    values = graph.endpoints(flow).unionByName(known.select(G, F.col("value").alias("id")))
    sets = tables.materialize(graph.strong_components(values, flow).select(G, F.col("id").alias("value"), F.col("component").alias("set")))
    between = graph.quotient(flow, sets.select(G, F.col("value").alias("id"), F.col("set").alias("key"))).filter("src <> dst")
    gen = known.join(sets, [G, "value"]).select(G, F.col("set").alias("node"), F.col("member").alias("fact"))
    reach = accumulate(between, gen)
    return sets, tables.materialize(reach.select(G, F.col("node").alias("set"), F.col("fact").alias("member")).distinct())


def with_members(holders: DataFrame, members: DataFrame) -> DataFrame:
    """``holders(graph_id, set, ...)`` with each ``member`` of their sets, none without one. The members are dealt to slices, so that
    a set with many holders and many members is the work of several tasks."""
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("_slice")
    dealt = members.withColumn("_slice", F.pmod(F.xxhash64("member"), F.lit(SLICES)).cast("int"))
    return holders.select("*", slices).repartition(G, "set", "_slice").join(dealt, [G, "set", "_slice"]).drop("_slice")


def infer_types(flow: DataFrame, known: DataFrame, extends: DataFrame) -> DataFrame:
    """``(graph_id, value, type)``: the least common superclass of the types that reach a value along
    copies and phis. ``flow(graph_id, src, dst)``, ``known(graph_id, value, type)``."""
    from graphfacts.operators.hierarchy import common_superclass

    sets, members = reaching_sets(flow, known.withColumnRenamed("type", "member"))
    return sets.join(common_superclass(extends, members), [G, "set"]).select(G, "value", F.col("superclass").alias("type"))


def infer_type_sets(flow: DataFrame, known: DataFrame, closure: DataFrame) -> DataFrame:
    """``(graph_id, value, type)``: as :func:`infer_types` with interfaces. A value of which several lowest common types
    are known has a row for each; ``closure`` holds superclasses and interfaces."""
    from graphfacts.operators.hierarchy import common_supertypes

    sets, members = reaching_sets(flow, known.withColumnRenamed("type", "member"))
    return sets.join(common_supertypes(closure, members), [G, "set"]).select(G, "value", F.col("supertype").alias("type"))

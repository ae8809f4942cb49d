"""Inclusion-based points-to analysis, heap graph, mod/ref, escape and liveness of objects.

Facts, all with ``graph_id``: ``allocs(method, var, obj, type)``, ``assigns(method, dst, src, cast)``,
``loads(dst, base, field)``, ``stores(base, field, src)``, ``direct_calls(method, site, target)``,
``virtual_calls(site, receiver, selector)``, ``args(site, pos, var)``, ``results(site, var)``,
``params(method, pos, var)``, ``returns(method, var)`` and ``dispatch(type, selector, method)``.
All identifiers are strings. A field of an object is the pointer ``obj.field``; arrays use the field ``[]``,
statics and thrown values are variables of their own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphfacts.operators import alone_heap, dataflow, graph
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.plans.fixpoint import fixpoint, solve

#: Flows, points and calls up to which a program is solved in one task.
ALONE = 3_000_000


def field_pointer(obj, field) -> Column:
    return F.concat(F.col(obj), F.lit("."), F.col(field))


class PointsTo(NamedTuple):
    points_to: DataFrame  # graph_id, pk, obj, type
    calls: DataFrame  # graph_id, site, src, dst
    methods: DataFrame  # graph_id, method
    assigns: DataFrame  # graph_id, dst, src


def points_to(facts: dict[str, DataFrame], entries: DataFrame, subtypes: DataFrame) -> PointsTo:
    """Points-to sets together with the call graph they imply.

    One recursive relation ``(graph_id, kind, a, b, c)`` holds four kinds of rows: ``pts`` (pointer, object,
    its type), ``flow`` (destination, source, cast type or ''), ``call`` (site, target, caller) and
    ``live`` (method). Every rule joins new rows with constant facts, except flow ⋈ pts, which takes
    the new rows of either side. ``subtypes(graph_id, sub, sup)`` is the reflexive closure for casts. A program of up to ``ALONE`` such rows
    is solved in one task (:mod:`alone_heap`), the others by rounds.
    """
    fixed = {k: tables.materialize(v) for k, v in facts.items()}
    # only the types that objects have, and those that casts name
    cast = tables.materialize(subtypes.select(G, F.col("sub").alias("c"), F.col("sup").alias("cast")).distinct()
                              .join(fixed["allocs"].select(G, F.col("type").alias("c")), [G, "c"], "left_semi")
                              .join(fixed["assigns"].select(G, "cast"), [G, "cast"], "left_semi"))
    void = F.lit("")

    def rows(df, kind, a, b=void, c=void):
        return df.select(G, F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))

    col = F.col
    sites = fixed["virtual_calls"].select(G, "site", col("receiver").alias("a"), "selector", "method")
    hidden = fixed["params"].filter("pos = 0").select(G, "method", col("var").alias("this"))
    visible = fixed["params"].filter("pos > 0").select(G, "method", "pos", col("var").alias("param"))

    def step(new, known):
        kind = lambda df, k: df.filter(col("kind") == k)
        live = kind(new, "live").select(G, col("a").alias("method"))
        pts, flow, call = kind(new, "pts"), kind(new, "flow"), kind(new, "call")
        start = rows(fixed["allocs"].join(live, [G, "method"]), "pts", col("var"), col("obj"), col("type"))
        moves = rows(fixed["assigns"].join(live, [G, "method"]), "flow", col("dst"), col("src"), F.coalesce("cast", void))
        jumps = rows(fixed["direct_calls"].join(live, [G, "method"]), "call", col("site"), col("target"), col("method"))

        def carry(flows, points):
            # the files of flows are far smaller than their rows in memory, so size would have them broadcast
            f = flows.select(G, col("a").alias("dst"), col("b").alias("a"), col("c").alias("cast")).hint("merge")
            return f.join(points.select(G, "a", "b", "c"), [G, "a"])

        both = carry(flow, kind(known, "pts")).unionByName(carry(kind(known, "flow"), pts))
        free = both.filter("cast = ''")
        checked = both.filter("cast <> ''").join(cast, [G, "c", "cast"], "left_semi")
        moved = rows(free.unionByName(checked.select(*free.columns)), "pts", col("dst"), col("b"), col("c"))

        base = pts.select(G, col("a").alias("base"), col("b").alias("obj"))
        read = rows(fixed["loads"].join(base, [G, "base"]), "flow", col("dst"), field_pointer("obj", "field"))
        wrote = rows(fixed["stores"].join(base, [G, "base"]), "flow", field_pointer("obj", "field"), col("src"))

        met = sites.join(pts, [G, "a"]).select(G, "site", "selector", col("method").alias("caller"), col("b").alias("obj"), col("c").alias("type"))
        met = met.join(fixed["dispatch"].select(G, "type", "selector", "method"), [G, "type", "selector"])
        virtual = rows(met, "call", col("site"), col("method"), col("caller"))
        this = rows(met.join(hidden, [G, "method"]), "pts", col("this"), col("obj"), col("type"))

        bound = call.select(G, col("a").alias("site"), col("b").alias("method"))
        passed = rows(
            bound.join(fixed["args"], [G, "site"]).join(visible, [G, "method", "pos"]), "flow", col("param"), col("var"))
        given = rows(
            bound.join(fixed["results"].withColumnRenamed("var", "to"), [G, "site"]).join(fixed["returns"], [G, "method"]),
            "flow", col("to"), col("var"))
        woken = rows(bound, "live", col("method"))

        out = start
        for part in (moves, jumps, moved, read, wrote, virtual, this, passed, given, woken):
            out = out.unionByName(part)
        return out

    solved, rest = solve_alone(fixed, entries, cast)
    found = fixpoint(rows(rest, "live", col("method")), step)
    if solved is not None:
        found = found.unionByName(solved.select(G, "kind", "a", "b", "c"))
    kind = lambda k: found.filter(col("kind") == k)
    return PointsTo(
        kind("pts").select(G, col("a").alias("pk"), col("b").alias("obj"), col("c").alias("type")),
        kind("call").select(G, col("a").alias("site"), col("c").alias("src"), col("b").alias("dst")),
        kind("live").select(G, col("a").alias("method")),
        kind("flow").select(G, col("a").alias("dst"), col("b").alias("src")))


def solve_alone(fixed: dict[str, DataFrame], entries: DataFrame, cast: DataFrame, choose=None, clone: bool = False, **more: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The solution of the programs that fit one task, and the entries of the others. ``cast(graph_id, c, cast)``: subtypes for casts."""
    facts = {**fixed, **more, "casts": cast, "entries": entries.select(G, "method")}
    if not ALONE or not alone_heap.can_solve(facts):
        return None, entries
    solved = tables.materialize(alone_heap.solve(facts, choose, clone, ALONE))
    return solved, entries.join(solved.filter("kind = 'live'").select(G).distinct(), G, "left_anti")


def name_objects(allocs: DataFrame, by_site: bool = True, limit: int = 25) -> DataFrame:
    """Add ``obj``, the abstract object of each allocation.

    ``allocs(graph_id, method, var, site, type, is_string, is_throwable, only_primitives)``. By class, or by
    site with strings, throwables and holders of nothing but primitives merged by type, and a
    method's sites of one type merged when there are more than ``limit``.
    """
    by_type = F.concat(F.lit("type:"), "type")
    if not by_site:
        return allocs.withColumn("obj", by_type)
    counts = allocs.groupBy(G, "method", "type").agg(F.count_distinct("site").alias("_sites"))
    merged = F.col("is_string") | F.col("is_throwable") | F.col("only_primitives")
    return allocs.join(counts, [G, "method", "type"]).withColumn(
        "obj",
        F.when(merged, by_type)
        .when(F.col("_sites") > limit, F.concat(F.lit("method:"), "method", F.lit("/"), "type"))
        .otherwise(F.concat(F.lit("site:"), "site"))).drop("_sites")


def assignable_only(assigns: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Rows ``(graph_id, dst, obj, type, filter)`` whose object type fits one of the target's types;
    several filters per target are alternatives."""
    fits = subtypes.select(G, F.col("sub").alias("type"), F.col("sup").alias("filter"))
    return assigns.join(fits, [G, "type", "filter"], "left_semi").select(G, "dst", "obj").distinct()


def points_to_of(pts: DataFrame, keys: DataFrame) -> DataFrame:
    return pts.join(keys.select(G, "pk"), [G, "pk"], "left_semi")


def pointer_keys(pts: DataFrame) -> DataFrame:
    return pts.select(G, "pk").distinct()


def objects(pts: DataFrame) -> DataFrame:
    return pts.select(G, "obj", "type").distinct()


def flows_to(assigns: DataFrame, allocs: DataFrame, asked: DataFrame) -> DataFrame:
    """``(graph_id, obj, pk)``: pointers the asked objects may reach, forward from their allocations."""
    start = allocs.join(asked.select(G, "obj"), [G, "obj"], "left_semi").select(G, F.col("var").alias("node"), F.col("obj").alias("fact"))
    flow = assigns.select(G, F.col("src"), F.col("dst"))
    return dataflow.accumulate(flow, start).select(G, F.col("fact").alias("obj"), F.col("node").alias("pk"))


def demand_points_to(facts: dict[str, DataFrame], asked: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(graph_id, pk, obj, status)`` for the asked pointers only: backward over assignments, with each
    field taken as one variable. ``BUDGETEXCEEDED`` marks the pointers whose search ``rounds`` steps did not end,
    otherwise ``SUCCESS`` when a pointer has objects and ``NOMOREREFINE`` when it has none."""
    field = F.concat(F.lit("field:"), "field")
    back = (
        facts["assigns"].select(G, F.col("dst").alias("at"), F.col("src").alias("to"))
        .unionByName(facts["loads"].select(G, F.col("dst").alias("at"), field.alias("to")))
        .unionByName(facts["stores"].select(G, field.alias("at"), F.col("src").alias("to"))).distinct())
    back = tables.materialize(back)
    allocs = facts["allocs"].select(G, F.col("var").alias("at"), "obj")
    status = F.when(F.col("obj").isNull(), "NOMOREREFINE").otherwise("SUCCESS")
    if rounds is None:
        sets, members = dataflow.reaching_sets(
            back.select(G, F.col("to").alias("src"), F.col("at").alias("dst")), allocs.select(G, F.col("at").alias("value"), F.col("obj").alias("member")))
        filled = members.select(G, "set").distinct()
        held = tables.materialize(asked.select(G, "pk").distinct().join(sets.withColumnRenamed("value", "pk"), [G, "pk"], "left").join(
            filled.withColumn("_any", F.lit(True)), [G, "set"], "left"))
        hits = dataflow.with_members(held.filter("_any").select(G, "set", "pk"), members).select(G, "pk", F.col("member").alias("obj"))
        none = held.filter("_any is null").select(G, "pk", F.lit(None).cast(members.schema["member"].dataType).alias("obj"))
        return hits.unionByName(none).withColumn("status", status)

    def step(new, _):
        return new.join(back, [G, "at"]).select(G, "pk", F.col("to").alias("at"))

    found = solve(asked.select(G, "pk", F.col("pk").alias("at")), step, rounds=rounds)
    reached = tables.materialize(found.df)
    hits = reached.join(allocs, [G, "at"]).select(G, "pk", "obj").distinct()
    out = asked.select(G, "pk").distinct().join(hits, [G, "pk"], "left")
    if found.complete:
        return out.withColumn("status", status)
    more = _unfinished(reached, back, step).withColumn("_open", F.lit(True))
    return out.join(more, [G, "pk"], "left").withColumn("status", F.when(F.col("_open"), "BUDGETEXCEEDED").otherwise(status)).drop("_open")


def _unfinished(reached: DataFrame, back: DataFrame, step) -> DataFrame:
    """``(graph_id, pk)``: the pointers from whose ``reached(graph_id, pk, at)`` one more step leads on. Most are told without that step:
    a variable with more successors than the pointer has reached, or one successor that it has not. Only the others take the
    step, and their variables have no more successors each than the pointer has reached."""
    onward = back.groupBy(G, "at").agg(F.count(F.lit(1)).alias("_n"), F.min("to").alias("_to"))
    size = reached.groupBy(G, "pk").agg(F.count(F.lit(1)).alias("_size"))
    ahead = tables.materialize(reached.join(onward, [G, "at"]).join(size, [G, "pk"]))
    wide = ahead.filter("_n > _size").select(G, "pk").distinct()
    narrow = ahead.join(wide, [G, "pk"], "left_anti").select(G, "pk", F.col("_to").alias("at"))
    told = tables.materialize(wide.unionByName(narrow.join(reached, [G, "pk", "at"], "left_anti").select(G, "pk").distinct()))
    rest = reached.join(told, [G, "pk"], "left_anti")
    return told.unionByName(step(rest, None).join(reached, [G, "pk", "at"], "left_anti").select(G, "pk").distinct())


def unsafe_casts(casts: DataFrame, pts: DataFrame, subtypes: DataFrame) -> DataFrame:
    """``(graph_id, cast_site, obj, type)``: objects a cast operand may hold that are no subtype of the target.
    ``casts(graph_id, cast_site, pk, target)``."""
    fits = subtypes.select(G, F.col("sub").alias("type"), F.col("sup").alias("target"))
    return casts.join(pts, [G, "pk"]).join(fits, [G, "type", "target"], "left_anti").select(G, "cast_site", "obj", "type").distinct()


def heap_graph(pts: DataFrame, fields: DataFrame) -> DataFrame:
    """Edges pointer → object and object → its field pointers. ``fields(graph_id, obj, pk)``."""
    return pts.select(G, F.col("pk").alias("src"), F.col("obj").alias("dst")).unionByName(
        fields.select(G, F.col("obj").alias("src"), F.col("pk").alias("dst"))).distinct()


def reachable_objects(heap: DataFrame, pts: DataFrame, starts: DataFrame) -> DataFrame:
    """Objects reachable in the heap graph from ``starts(graph_id, id)``, pointers or objects."""
    return graph.reachable(heap, starts).join(objects(pts).withColumnRenamed("obj", "id"), [G, "id"]).select(
        G, F.col("id").alias("obj"), "type")


def accessed_locations(accesses: DataFrame, pts: DataFrame) -> DataFrame:
    """``(graph_id, method, stmt, kind, loc)``: locations each access may touch.
    ``accesses(graph_id, method, stmt, kind, base, field)`` with kind read or write."""
    return accesses.join(pts.select(G, F.col("pk").alias("base"), "obj"), [G, "base"]).select(
        G, "method", "stmt", "kind", field_pointer("obj", "field").alias("loc")).distinct()


def mod_ref(touched: DataFrame, cg: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``(graph_id, method, kind, loc)``: locations read or written by a method or its callees."""
    if excluded is not None:
        touched = touched.join(excluded.select(G, "loc"), [G, "loc"], "left_anti")
    own = touched.select(G, F.col("method").alias("node"), F.struct("kind", "loc").alias("fact")).distinct()
    all_ = dataflow.accumulate(graph.invert(cg.select(G, "src", "dst")), own)
    return all_.select(G, F.col("node").alias("method"), "fact.kind", "fact.loc")


def heap_dependence(touched: DataFrame) -> DataFrame:
    """Statements that may depend on a write: ``(graph_id, src, dst)``, src writes what dst reads."""
    w = touched.filter("kind = 'write'").select(G, "loc", F.col("stmt").alias("src"))
    r = touched.filter("kind = 'read'").select(G, "loc", F.col("stmt").alias("dst"))
    return w.join(r, [G, "loc"]).select(G, "src", "dst").distinct()


def heap_reaching_definitions(edges: DataFrame, touched: DataFrame, exact: DataFrame) -> DataFrame:
    """``(graph_id, node, fact)``: write statements that may reach a node; a statement kills the other
    writes of a location only where it surely overwrites it (``exact(graph_id, stmt, loc)``)."""
    writes = touched.filter("kind = 'write'").select(G, F.col("stmt").alias("node"), "loc").distinct()
    gen = writes.select(G, "node", F.struct(F.col("node").alias("stmt"), "loc").alias("fact"))
    flow = dataflow.killing_flow(
        edges, gen, exact.select(G, F.col("stmt").alias("node"), F.col("loc").alias("target")),
        gen.select(G, "fact", F.col("fact.loc").alias("target")))
    return flow.into.select(G, "node", "fact.stmt", "fact.loc")


def escapes(pts: DataFrame, pointers: DataFrame, asked: DataFrame) -> DataFrame:
    """``(graph_id, obj, escapes)``: an object escapes its method when a heap pointer or a returned value
    holds it. ``pointers(graph_id, pk, kind)`` with kind field, static, array, return, local …"""
    out = pts.join(pointers.filter("kind in ('field', 'static', 'array', 'return')").select(G, "pk"), [G, "pk"], "left_semi")
    out = out.select(G, "obj").distinct().withColumn("escapes", F.lit(True))
    return asked.select(G, "obj").distinct().join(out, [G, "obj"], "left").withColumn("escapes", F.coalesce("escapes", F.lit(False)))


def may_be_live(heap: DataFrame, pointers: DataFrame, cg: DataFrame, asked: DataFrame) -> DataFrame:
    """``(graph_id, obj, method)``: methods in which an object may be live; a null method means everywhere.

    ``pointers(graph_id, pk, kind, method)``. Backward in the heap graph to the pointers that lead to the
    object; a static among them makes it live everywhere, locals in their methods and all callees.
    """
    holders = graph.reachable_from_each(graph.invert(heap), asked.select(G, F.col("obj").alias("id"))).join(
        pointers.withColumnRenamed("pk", "id"), [G, "id"])
    holders = tables.materialize(holders.select(G, F.col("source").alias("obj"), "kind", "method").distinct())
    always = holders.filter("kind = 'static'").select(G, "obj").distinct()
    local = holders.filter("method is not null").join(always, [G, "obj"], "left_anti")
    seen = dataflow.accumulate(cg, local.select(G, F.col("method").alias("node"), F.col("obj").alias("fact")))
    return seen.select(G, F.col("fact").alias("obj"), F.col("node").alias("method")).unionByName(
        always.withColumn("method", F.lit(None).cast("string")))


def thread_escape(heap: DataFrame, pts: DataFrame, starts: DataFrame) -> DataFrame:
    """``(graph_id, type)``: types of objects shared through statics or thread objects ``starts(graph_id, id)``."""
    return reachable_objects(heap, pts, starts).select(G, "type").distinct()

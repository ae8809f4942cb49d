"""Resource state: what is acquired, by whom, and still held where it must not be.

State of one resource: ``acquired``, ``timed``, ``is_async`` and the sorted array ``contexts`` of involved components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfacts.functions.scalars import flag_types
from graphfacts.operators import alone, dataflow, dominance, graph, hierarchy, paths, tabulation
from graphfacts.operators.graph import G
from graphfacts.plans import segments, tables
from graphfacts.plans.fixpoint import HOPS, fixpoint

# Declared callback order per component kind (kind, from, to).
LIFECYCLE = [
    ("Activity", "<init>", "onCreate"),
    ("Activity", "onCreate", "onStart"),
    ("Activity", "onStart", "onResume"),
    ("Activity", "onResume", "onPause"),
    ("Activity", "onPause", "onStop"),
    ("Activity", "onStop", "onDestroy"),
    ("Activity", "onPause", "onResume"),
    ("Activity", "onStop", "onCreate"),
    ("Activity", "onStop", "onRestart"),
    ("Activity", "onRestart", "onStart"),
    ("Service", "onCreate", "onStart"),
    ("Service", "onStart", "onStartCommand"),
    ("Service", "onStartCommand", "onDestroy"),
    ("Service", "onCreate", "onBind"),
    ("Service", "onBind", "onUnbind"),
    ("Service", "onUnbind", "onRebind"),
    ("Service", "onRebind", "onUnbind"),
    ("Service", "onUnbind", "onDestroy"),
    ("IntentService", "onCreate", "onHandleIntent"),
    ("IntentService", "onHandleIntent", "onDestroy"),
    ("IntentService", "onCreate", "onBind"),
    ("IntentService", "onBind", "onUnbind"),
    ("IntentService", "onUnbind", "onRebind"),
    ("IntentService", "onRebind", "onUnbind"),
    ("IntentService", "onUnbind", "onDestroy"),
    ("Application", "onCreate", "onTerminate"),
]

# Where a component kind must hold nothing (kind, callback, violation, level, callback the component
# must have for the rule to apply).
POLICY = [
    ("Activity", "onPause", "ACTIVITY_ONPAUSE", 2, None),
    ("Activity", "onStop", "ACTIVITY_ONSTOP", 3, None),
    ("Service", "onStart", "SERVICE_ONSTART", 2, "onStart"),
    ("Service", "onStartCommand", "SERVICE_ONSTART", 2, "onStartCommand"),
    ("Service", "onUnbind", "SERVICE_ONUNBIND", 2, "onBind"),
    ("IntentService", "onHandleIntent", "INTENTSERVICE_ONHANDLEINTENT", 2, None),
    ("BroadcastReceiver", "onReceive", "BROADCAST_RECEIVER_ONRECEIVE", 2, None),
    ("Application", "onTerminate", "APPLICATION_TERMINATE", 2, None),
    ("AsyncTask", "onPostExecute", "ASYNC_TASK_ONPOSTEXECUTE", 2, None),
    ("Runnable", "run", "RUNNABLE_RUN", 2, None),
    ("Callable", "call", "CALLABLE_CALL", 2, None),
]

# Kind of a component that could not be classified, and what holding a resource at any of its callbacks is.
UNRESOLVED = ("UnresolvedComponent", "UNRESOLVED_CALLBACK_LOCKED", 2)

# Warning levels.
WARNINGS = [
    ("NO_WAKELOCK_CALLS", 1),
    ("UNRESOLVED_ASYNC_CALLS", 2),
    ("UNRESOLVED_WAKELOCK_CALLS", 2),
]

STATE = "struct<lock:string,acquired:boolean,timed:boolean,is_async:boolean,contexts:array<string>>"


def lifecycle_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIFECYCLE, "kind string, src string, dst string")


def policy_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "kind string, selector string, violation string, level int, needs string")


# --- which resource ------------------------------------------------------------------------------------
def resolve_instances(flows: DataFrame, operations: DataFrame, creations: DataFrame) -> DataFrame:
    """``(graph_id, op, lock, unresolved)``: the creation points that flow into each operation's argument.
    ``flows(graph_id, dst, src)`` are assignments, field moves, parameters and returns;
    ``operations(graph_id, op, var)``, ``creations(graph_id, var, lock)``."""
    found = _flows_into(flows, operations, creations.select(G, F.col("var").alias("value"), F.col("lock").alias("member")))
    return found.select(G, "op", F.col("member").alias("lock"), F.col("member").isNull().alias("unresolved"))


def _flows_into(flows: DataFrame, operations: DataFrame, known: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """``(graph_id, <columns of operations>, member)``, distinct: what flows into the ``var`` of each operation, a row with null where
    nothing does. ``shown(graph_id, member)`` lists the members to name, others count as null. Members stay with the sets of variables
    that share them; only operations with several sets can meet a member twice, so only their rows are compared."""
    sets, members = dataflow.reaching_sets(flows, known)
    if shown is not None:
        members = members.join(shown.select(G, "member", F.col("member").alias("_shown")).distinct(), [G, "member"], "left").select(
            G, "set", F.col("_shown").alias("member")).distinct()
    members = tables.materialize(members)
    by = [c for c in operations.columns if c not in (G, "var")]
    asked = operations.join(sets.withColumnRenamed("value", "var"), [G, "var"], "left").join(
        members.select(G, "set").distinct().withColumn("_any", F.lit(True)), [G, "set"], "left").select(
        G, *by, F.when(F.col("_any"), F.col("set")).alias("set")).distinct()
    own = asked.groupBy(G, *by).agg(F.count(F.lit(1)).alias("_sets"), F.first("set").alias("set"))
    own = tables.materialize(own)
    kind = members.schema["member"].dataType
    alone = own.filter("_sets = 1")
    none = alone.filter("set is null").select(G, *by, F.lit(None).cast(kind).alias("member"))
    one = dataflow.with_members(alone.filter("set is not null").select(G, *by, "set"), members).select(G, *by, "member")
    mixed = own.filter("_sets > 1").select(G, *by)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (G, *by)]
    shared = asked.alias("a").join(mixed.alias("b"), same, "left_semi")
    several = dataflow.with_members(shared.filter("set is not null"), members).select(G, *by, "member").unionByName(
        shared.filter("set is null").select(G, *by, F.lit(None).cast(kind).alias("member"))).distinct()
    return one.unionByName(none).unionByName(several)


def metadata(flags: DataFrame, counted: DataFrame) -> DataFrame:
    """``(graph_id, lock, flags, types, ref_counted)``. ``flags(graph_id, lock, flags)``: bits of one lock
    are united; ``counted(graph_id, lock, at, value)``: the last word on reference counting, by ``at``, else UNSET."""
    bits = flags.groupBy(G, "lock").agg(F.bit_or("flags").alias("flags"))
    said = counted.groupBy(G, "lock").agg(F.max_by("value", "at").alias("value"))
    return bits.join(said, [G, "lock"], "left").select(
        G, "lock", "flags", flag_types(F.col("flags")).alias("types"),
        F.when(F.col("value").isNull(), "UNSET").when(F.col("value"), "TRUE").otherwise("FALSE").alias("ref_counted"))


def resolve_starts(flows: DataFrame, starts: DataFrame, constants: DataFrame, components: DataFrame) -> DataFrame:
    """``(graph_id, op, caller, component, resolved)`` for asynchronous ``starts(graph_id, op, caller, var)``:
    the component class named by a constant that flows into the call. ``constants(graph_id, var, cls)``."""
    known = constants.select(G, F.col("var").alias("value"), F.col("cls").alias("member"))
    # every caller of an operation meets what flows into any of its variables
    named = starts.select(G, "op", "caller").distinct()
    operations = starts.select(G, "op", "var").distinct().join(named, [G, "op"])
    lost = starts.filter("op is null or graph_id is null").select(G, "op", "caller", F.lit(None).cast(starts.schema["var"].dataType).alias("var"))
    found = _flows_into(flows, operations.select(G, "op", "caller", "var").unionByName(lost), known, components.select(G, F.col("cls").alias("member")))
    return found.select(G, "op", "caller", F.col("member").alias("component"), F.col("member").isNotNull().alias("resolved"))


def start_statistics(resolved: DataFrame) -> DataFrame:
    per = resolved.groupBy(G, "op").agg(F.bool_or("resolved").alias("ok"))
    return per.groupBy(G).agg(F.count_if("ok").alias("successfully_resolved_calls"), F.count(F.lit(1)).alias("total_calls"))


# --- components ------------------------------------------------------------------------------------------
def constraint_graph(*resolved: DataFrame) -> DataFrame:
    """Caller component → started component over any number of start kinds, without self calls."""
    out = None
    for r in resolved:
        e = r.filter("resolved and caller <> component").select(G, F.col("caller").alias("src"), F.col("component").alias("dst"))
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def super_components(components: DataFrame, constraint: DataFrame) -> DataFrame:
    return graph.weak_components(components.select(G, F.col("cls").alias("id")), constraint).select(
        G, F.col("id").alias("cls"), F.col("component").alias("super_component"))


def _shapes(callbacks: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components by their shape, that is their kind and which declared callbacks they have: ``owners(graph_id,
    component, shape)``, the shapes' callbacks and the shapes' declared edges. There are as many shapes as the rules
    allow, however many components there are."""
    declared = rules.select("kind", F.explode(F.array("src", "dst")).alias("selector")).distinct()
    own = callbacks.select(G, "component", "kind", "selector").distinct().join(F.broadcast(declared), ["kind", "selector"], "left_semi")
    present = own.groupBy(G, "component", "kind").agg(F.sort_array(F.collect_list("selector")).alias("present"))  # declared ones, a few
    owners = callbacks.select(G, "component", "kind").distinct().join(present, [G, "component", "kind"], "left")
    owners = tables.materialize(owners.withColumn("present", F.coalesce("present", F.array().cast("array<string>"))).withColumn(
        "shape", F.concat_ws(" ", "kind", "present")))
    shapes = tables.materialize(owners.select("shape", "kind", "present").distinct())
    node = lambda s: F.struct(F.col("shape").alias("component"), F.col(s).alias("selector"))
    edges = shapes.join(F.broadcast(rules), "kind").select(F.lit(0).alias(G), node("src").alias("src"), node("dst").alias("dst"))
    has = shapes.select(F.lit(0).alias(G), "shape", F.explode("present").alias("selector")).select(G, node("selector").alias("id"))
    return owners.select(G, "component", "shape"), tables.materialize(has), tables.materialize(edges)


def lifecycle_graph(callbacks: DataFrame, rules: DataFrame) -> DataFrame:
    """``(graph_id, component, src, dst)`` over the selectors a component implements: the declared order with
    the callbacks it lacks contracted away. ``callbacks(graph_id, component, kind, selector)``. Components of one
    shape have one graph, which is computed once."""
    owners, has, edges = _shapes(callbacks, rules)
    solved = graph.project(edges, has).select(
        F.col("src.component").alias("shape"), F.col("src.selector").alias("src"), F.col("dst.selector").alias("dst"))
    return owners.join(solved, "shape").select(G, "component", "src", "dst")


def neighbour_callbacks(callbacks: DataFrame, rules: DataFrame, forward: bool = True) -> DataFrame:
    """``(graph_id, component, selector, near)``: nearest present callbacks after (or before) every declared
    one, walking through absent ones only; computed once for each shape of component."""
    owners, present, edges = _shapes(callbacks, rules)
    edges = edges if forward else graph.invert(edges)
    through = tables.materialize(edges.join(present.withColumnRenamed("id", "src"), [G, "src"], "left_anti"))

    def step(new, _):
        return new.withColumnRenamed("near", "src").join(through, [G, "src"]).select(G, "id", F.col("dst").alias("near"))

    seed = edges.select(G, F.col("src").alias("id"), F.col("dst").alias("near"))
    found = fixpoint(seed, step, hops=HOPS).join(present.withColumnRenamed("id", "near"), [G, "near"], "left_semi")
    solved = found.select(F.col("id.component").alias("shape"), F.col("id.selector").alias("selector"), F.col("near.selector").alias("near"))
    return owners.join(solved, "shape").select(G, "component", "selector", "near")


def worth_solving(classes: DataFrame, closure: DataFrame, frameworks: DataFrame, cg: DataFrame, members: DataFrame,
                  targets: DataFrame) -> DataFrame:
    """Components that extend a framework class and reach an operation of interest: a filter to apply before
    any solving. ``members(graph_id, cls, method)``, ``targets(graph_id, method)``."""
    known = closure.join(frameworks.select(F.col("cls").alias("ancestor")), "ancestor", "left_semi").select(G, "cls").distinct()
    leads = graph.backward_closure(cg, targets.select(G, F.col("method").alias("id")))
    busy = members.join(leads.withColumnRenamed("id", "method"), [G, "method"], "left_semi").select(G, "cls").distinct()
    return classes.select(G, "cls").distinct().join(known, [G, "cls"], "left_semi").join(busy, [G, "cls"], "left_semi")


def component_edges(starts: DataFrame, after: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """Supergraph edges of asynchronous starts: start block → entry callbacks, exit callbacks → return block.
    ``starts(graph_id, block, component)``, ``after(graph_id, block, ret, label)``,
    ``entries``/``exits(graph_id, component, id)``."""
    none = F.lit(None).cast(starts.schema["block"].dataType).alias("call")
    go = starts.join(entries, [G, "component"]).select(
        G, F.col("block").alias("src"), F.col("id").alias("dst"), F.lit("call").alias("label"), none)
    back = starts.join(after.filter("label <> 'exceptional'"), [G, "block"]).join(exits, [G, "component"]).select(
        G, F.col("id").alias("src"), F.col("ret").alias("dst"), F.lit("return").alias("label"), F.col("block").alias("call"))
    return go.unionByName(back).distinct()


def nodes_leading_to(edges: DataFrame, targets: DataFrame, hops: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with a path (of at most ``hops`` edges) to a target, and the edges among them."""
    near = tables.materialize(graph.within_hops(graph.invert(edges), targets, hops).select(G, "id", "hop"))
    return near, graph.keep_edges(edges, near)


# --- state -----------------------------------------------------------------------------------------------
def describe(acquired: Column, timed: Column, is_async: Column) -> Column:
    """Name of a state."""
    mode = F.when(is_async, F.lit("ASYNC_")).otherwise(F.lit(""))
    return (
        F.when(acquired & timed, F.concat(mode, F.lit("TIMED_ACQUIRED")))
        .when(acquired, F.concat(mode, F.lit("ACQUIRED")))
        .when(timed, F.lit("UNDEFINED"))
        .otherwise(F.concat(mode, F.lit("RELEASED"))))


def merge_states(facts: DataFrame, by: list[str]) -> DataFrame:
    """One state per group: acquired if any, timed if all, asynchronous if any, contexts united.

    Contexts are deduplicated before they are collected, so a hot group shuffles its distinct components only.
    """
    flags = facts.groupBy(*by).agg(
        F.bool_or("acquired").alias("acquired"), F.bool_and("timed").alias("timed"), F.bool_or("is_async").alias("is_async"))
    ctx = facts.select(*by, F.explode("contexts").alias("c")).distinct().groupBy(*by).agg(
        F.sort_array(F.collect_list("c")).alias("contexts"))
    out = flags.join(ctx, by, "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return out.withColumn("state", describe(F.col("acquired"), F.col("timed"), F.col("is_async")))


def locked_points(nodes: DataFrame, edges: DataFrame, operations: DataFrame, entries: DataFrame, meet: str = "may") -> DataFrame:
    """``(graph_id, id, before, after)``: is anything acquired, ignoring calling contexts?"""
    value = F.col("op").isin("acquire", "timed_acquire")
    settings = operations.filter("op in ('acquire', 'timed_acquire', 'release')").select(
        G, F.col("block").alias("id"), value.alias("value")).distinct()
    return dataflow.boolean(nodes, edges, settings, entries, meet)


def branch_kills(tests: DataFrame) -> DataFrame:
    """Edges on which a resource cannot be held: the null branch of a null test, the false branch of an
    is-held test. ``tests(graph_id, block, lock, op, when_true, when_false)`` with branch targets;
    gives ``(graph_id, src, dst, lock)``."""
    dead = F.when(F.col("op") == "null_check", F.col("when_true")).when(F.col("op") == "is_held", F.col("when_false"))
    return tests.select(G, F.col("block").alias("src"), dead.alias("dst"), "lock").filter("dst is not null")


def resource_states(edges: DataFrame, operations: DataFrame, entries: DataFrame, kills: DataFrame | None = None,
                    timed_seeds: bool = False) -> DataFrame:
    """``(graph_id, node, lock, acquired, timed, is_async, contexts)``: unmerged states before each node, context-sensitive.

    ``operations(graph_id, block, lock, op, contexts)``; ``entries(graph_id, node, entry)``: entry of the
    procedure of a node; ``kills`` from :func:`branch_kills`. Every acquire is a seed which may leave its
    procedure. A release turns a synchronous state into a released one, asynchronous unless the
    releasing components include all acquiring ones; it leaves an asynchronous state as it is and adds its
    components. Exceptional edges and call-to-return edges carry nothing; edges past a call without callee do.
    """
    seeds = "op in ('acquire', 'timed_acquire')" if timed_seeds else "op = 'acquire'"
    fact = F.struct(
        F.col("lock"), F.lit(True).alias("acquired"), (F.col("op") == "timed_acquire").alias("timed"),
        F.lit(False).alias("is_async"), F.sort_array("contexts").alias("contexts")).cast(STATE)
    starts = operations.filter(seeds).select(G, F.col("block").alias("node"), fact.alias("d")).join(entries, [G, "node"])
    seed = starts.select(G, "entry", F.col("d").alias("d1"), "node", F.col("d").alias("d2"))
    release = tables.materialize(operations.filter("op = 'release'").select(
        G, F.col("block").alias("src"), F.col("lock").alias("_lock"), F.col("contexts").alias("_by")))
    inner = edges.filter("label not in ('exceptional', 'call_to_return')")

    def flow(frame):
        names = frame.columns
        out = frame.withColumn("_lock", F.col("d.lock")).join(release, [G, "src", "_lock"], "left")
        by, d = F.col("_by"), F.col("d")
        kept = F.struct(
            d["lock"].alias("lock"), d["acquired"].alias("acquired"), d["timed"].alias("timed"), F.lit(True).alias("is_async"),
            F.sort_array(F.array_union(d["contexts"], by)).alias("contexts"))
        freed = F.struct(
            d["lock"].alias("lock"), F.lit(False).alias("acquired"), F.lit(False).alias("timed"),
            (F.size(F.array_except(d["contexts"], by)) > 0).alias("is_async"), d["contexts"].alias("contexts"))
        out = out.withColumn("d", F.when(by.isNull(), d).when(d["is_async"], kept.cast(STATE)).otherwise(freed.cast(STATE)))
        if kills is not None:
            out = out.withColumn("_held", F.col("d.lock")).join(
                kills.select(G, "src", "dst", F.col("lock").alias("_held")), [G, "src", "dst", "_held"], "left_anti")
        return out.select(*names)

    if kills is None:
        flow = alone.Flow(flow, release.select(G, "src", F.struct(F.col("_lock").alias("lock"), F.col("_by").alias("by")).alias("own")), alone.released)
    found = tabulation.tabulate(inner, seed, flow=flow, unbalanced=True).df
    return found.select(G, "node", "d2").distinct().select(G, "node", "d2.*")


def exit_states(states: DataFrame, exits: DataFrame) -> DataFrame:
    """Merged state per lock at the exit of every callback: ``exits(graph_id, component, selector, node)``."""
    return merge_states(exits.join(states, [G, "node"]), [G, "component", "selector", "lock"])


def violations(at_exit: DataFrame, callbacks: DataFrame, policy: DataFrame, before: DataFrame) -> DataFrame:
    """``(graph_id, component, violation, level, selector, lock)``: held and relevant resources where the
    policy of the component's kind wants none. A mandated callback the component lacks is represented by
    the nearest preceding ones (``before``, from :func:`neighbour_callbacks` backward). A rule with ``needs`` applies
    to components that have that callback. Unresolved components are checked at each of their callbacks."""
    kind, violation, level = UNRESOLVED
    has = callbacks.select(G, "component", F.col("selector").alias("needs")).distinct()
    rules = callbacks.select(G, "component", "kind").distinct().join(policy, "kind")
    rules = rules.filter("needs IS NULL").drop("needs").unionByName(rules.join(has, [G, "component", "needs"], "left_semi").drop("needs"))
    rules = rules.unionByName(callbacks.filter(F.col("kind") == kind).select(
        G, "component", "kind", "selector", F.lit(violation).alias("violation"), F.lit(level).alias("level")).distinct())
    own = callbacks.select(G, "component", "selector", F.col("selector").alias("checked"))
    absent = before.join(own.select(G, "component", "selector"), [G, "component", "selector"], "left_anti").select(
        G, "component", "selector", F.col("near").alias("checked"))
    where = rules.join(own.unionByName(absent), [G, "component", "selector"])
    held = at_exit.filter("acquired").select(G, "component", F.col("selector").alias("checked"), "lock", "contexts")
    return where.join(held, [G, "component", "checked"]).filter(
        F.array_contains("contexts", F.col("component"))).select(G, "component", "violation", "level", "selector", "lock").distinct()


def warnings(apps: DataFrame, operations: DataFrame, resolved_ops: DataFrame, starts: DataFrame, states: DataFrame) -> DataFrame:
    """``(graph_id, level, message)``: no operation at all; an operation on an unknown resource; an
    unresolved start while something is held. ``starts(graph_id, op, block, resolved)``."""
    level = dict(WARNINGS)
    tag = lambda df, name: df.select(G, F.lit(level[name]).alias("level"), F.lit(name).alias("message")).distinct()
    none = apps.select(G).join(operations.select(G), G, "left_anti")
    unknown = resolved_ops.filter("unresolved")
    held = states.filter("acquired").select(G, F.col("node").alias("block"))
    open_ = starts.filter("not resolved").join(held, [G, "block"], "left_semi")
    return tag(none, "NO_WAKELOCK_CALLS").unionByName(tag(unknown, "UNRESOLVED_WAKELOCK_CALLS")).unionByName(
        tag(open_, "UNRESOLVED_ASYNC_CALLS"))


def released_after(edges: DataFrame, exits: DataFrame, operations: DataFrame) -> DataFrame:
    """``(graph_id, block, lock, released)``: is an acquire post-dominated, for every exit, by a release of the
    same lock? ``operations(graph_id, block, lock, op)`` within one method per ``graph_id``."""
    tree = dominance.post_dominator_tree(edges, exits)
    got = operations.filter("op in ('acquire', 'timed_acquire')").select(G, F.col("block").alias("id"), "lock")
    released = operations.filter("op = 'release'").select(G, "lock", F.col("block").alias("dominator")).distinct()
    # from each acquire to the nodes that post-dominate it, and only then to the releases among them
    hit = got.distinct().join(dominance.above(tree, got.select(G, "id").distinct()), [G, "id"]).join(
        released, [G, "lock", "dominator"], "left_semi").select(G, "id", "lock").distinct()
    return got.distinct().join(hit.withColumn("ok", F.lit(True)), [G, "id", "lock"], "left").select(
        G, F.col("id").alias("block"), "lock", F.coalesce("ok", F.lit(False)).alias("released"))


def call_conditions(nodes: DataFrame, edges: DataFrame, entry: DataFrame, calls: DataFrame, controlling: DataFrame,
                    conditions: DataFrame) -> DataFrame:
    """``(graph_id, call, conditions)``: sets of branch conditions under which a call is made, minimal ones only.

    A way from the entry to the call, without edges inside components, gives the conditions ``(graph_id, src, dst, condition)``
    on its edges, as far as the blocks that own them control the call. ``controlling(graph_id, call, src)`` names those
    blocks per call; without a ``call`` column they control every call, and one walk from the entry serves all of them.

    Ways are not listed: a node keeps its minimal sets. A set that contains a smaller one known at the same node is
    dropped in the round that finds it, so its continuations are never made.
    """
    back = graph.cycle_edges(tables.materialize(graph.strong_components(nodes, edges)), edges)
    names = conditions.groupBy(G, "src", "dst").agg(F.collect_set("condition").alias("names"))
    arcs = edges.select(G, "src", "dst").distinct().join(back.select(G, "src", "dst"), [G, "src", "dst"], "left_anti").join(
        names, [G, "src", "dst"], "left")
    none = F.array().cast("array<string>")
    per_call = "call" in controlling.columns
    if per_call:
        # from each call towards the entry
        owners = controlling.select(G, "call", F.col("src").alias("to")).distinct().withColumn("owned", F.lit(True))
        arcs = arcs.select(G, F.col("dst").alias("at"), F.col("src").alias("to"), "names")
        seed, useful = calls.select(G, F.col("id").alias("call"), F.col("id").alias("at")), graph.reachable(edges, entry)
    else:
        arcs = arcs.join(controlling.select(G, "src").distinct().withColumn("owned", F.lit(True)), [G, "src"], "left").select(
            G, F.col("src").alias("at"), F.col("dst").alias("to"), "names", "owned")
        seed, useful = entry.select(G, F.col("id").alias("at")), graph.backward_closure(edges, calls)
    arcs = tables.materialize(arcs.join(useful.select(G, F.col("id").alias("to")), [G, "to"], "left_semi"))
    place = [c for c in (G, "call", "at") if c in seed.columns]

    def step(new, known):
        more = new.join(arcs, [G, "at"])
        if per_call:
            more = more.join(owners, [G, "call", "to"], "left")
        added = F.coalesce(F.when(F.col("owned"), F.col("names")), none)
        more = more.select(*[F.col("to").alias("at") if c == "at" else F.col(c) for c in place],
                           F.array_sort(F.array_union("conditions", added)).alias("conditions"))
        old = known.select(*[F.col(c).alias(f"_{c}") for c in place], F.col("conditions").alias("_old"))
        same = [F.col(c) == F.col(f"_{c}") for c in place]
        return _minimal_sets(more, place).join(old, [*same, F.size(F.array_except("_old", "conditions")) == 0], "left_anti")

    found = fixpoint(seed.distinct().withColumn("conditions", none), step, distinct=False)
    ends = (entry if per_call else calls).select(G, F.col("id").alias("at")).distinct()
    hit = _minimal_sets(found.join(ends, [G, "at"], "left_semi"), place)
    return hit.select(G, "call" if per_call else F.col("at").alias("call"), "conditions")


def _minimal_sets(sets: DataFrame, by: list[str]) -> DataFrame:
    """Of the sorted sets ``conditions`` of each group those that contain no other one."""
    alike = sets.groupBy(*by).agg(F.collect_set("conditions").alias("_all"))
    least = F.filter("_all", lambda s: ~F.exists("_all", lambda o: (F.size(o) < F.size(s)) & (F.size(F.array_except(o, s)) == 0)))
    return alike.select(*by, F.explode(least).alias("conditions"))


# --- event logs ------------------------------------------------------------------------------------------
def states_in_log(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Resource state after every event of an ordered log: ``op`` is acquire, timed_acquire, release or null.

    The state is the last operation so far; before the first one it is released.
    """
    out = segments.last_known(events, by, order, F.col("op"), "_last")
    last = F.col("_last")
    acquired = F.coalesce(last.isin("acquire", "timed_acquire"), F.lit(False))
    timed = F.coalesce(last == "timed_acquire", F.lit(False))
    return out.withColumns({"acquired": acquired, "timed": timed}).withColumn(
        "state", describe(F.col("acquired"), F.col("timed"), F.lit(False))).drop("_last")


def open_at_end(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Groups whose log ends with the resource held: the last operation by an aggregate, so a hot group is
    combined before the shuffle and never sorted."""
    last = events.filter("op is not null").groupBy(*by).agg(F.max_by(F.struct("op", *order), F.struct(*order)).alias("last"))
    return last.filter("last.op in ('acquire', 'timed_acquire')").select(*by, "last.*")


def component_kinds(closure: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    return hierarchy.classify(closure, classes, rules, F.col("loader").isin("Primordial", "Extension"))

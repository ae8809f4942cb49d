"""Call graphs, program statistics and interprocedural flow graphs from fact tables.

``methods(graph_id, method, cls, selector, ...)``; ``call_sites(graph_id, site, caller, declared_cls,
selector, ...)``; ``cg(graph_id, site, src, dst)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.operators import graph, hierarchy
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.plans.fixpoint import fixpoint


# --- entry points ----------------------------------------------------------------------------------
def main_methods(methods: DataFrame) -> DataFrame:
    return methods.filter("selector = 'main([Ljava/lang/String;)V' and is_static").select(G, "method").distinct()


def all_methods_of(methods: DataFrame, classes: DataFrame, loader: str) -> DataFrame:
    """Concrete methods of every class of one loader (the application's, usually)."""
    mine = classes.filter(F.col("loader") == loader).select(G, "cls")
    return methods.filter("not is_abstract").join(mine, [G, "cls"], "left_semi").select(G, "method").distinct()


def methods_of_subtypes(methods: DataFrame, closure: DataFrame, types: DataFrame) -> DataFrame:
    """Concrete methods declared in a subtype of the asked ``types(graph_id, cls)``."""
    below = closure.join(types.select(G, F.col("cls").alias("ancestor")), [G, "ancestor"], "left_semi").select(G, "cls")
    return methods.filter("not is_abstract").join(below, [G, "cls"], "left_semi").select(G, "method").distinct()


def compose_entries(*entries: DataFrame) -> DataFrame:
    out = entries[0]
    for e in entries[1:]:
        out = out.unionByName(e)
    return out.distinct()


# --- call graphs -----------------------------------------------------------------------------------
def site_targets(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """Call edges: every site with every method its declared class and selector may run."""
    return sites.select(G, "site", F.col("caller").alias("src"), F.col("declared_cls").alias("cls"), "selector").join(
        targets, [G, "cls", "selector"]).select(G, "site", "src", F.col("method").alias("dst")).distinct()


def hierarchy_call_graph(sites: DataFrame, closure: DataFrame, methods: DataFrame, entries: DataFrame) -> DataFrame:
    """Call edges of the methods reachable from ``entries(graph_id, method)``, targets by class hierarchy."""
    asked = sites.select(G, F.col("declared_cls").alias("cls"), "selector")
    edges = tables.materialize(site_targets(sites, hierarchy.possible_targets(closure, methods, asked)))
    live = graph.reachable(edges, entries.select(G, F.col("method").alias("id")))
    return edges.join(live.withColumnRenamed("id", "src"), [G, "src"], "left_semi").select(G, "site", "src", "dst")


def receiver_table(sites: DataFrame, closure: DataFrame, methods: DataFrame) -> DataFrame:
    """``(graph_id, site, src, receiver, dst)``: what each site runs for each possible receiver class."""
    asked = sites.select(G, F.col("declared_cls").alias("ancestor"), "selector").distinct()
    below = asked.join(closure.select(G, "ancestor", "cls"), [G, "ancestor"])
    found = hierarchy.resolve(closure, methods, below.select(G, "cls", "selector")).join(
        methods.filter("not is_abstract").select(G, "method"), [G, "method"], "left_semi")
    rows = below.join(found, [G, "cls", "selector"]).select(
        G, F.col("ancestor").alias("declared_cls"), "selector", F.col("cls").alias("receiver"), F.col("method").alias("dst"))
    return sites.join(rows, [G, "declared_cls", "selector"]).select(G, "site", F.col("caller").alias("src"), "receiver", "dst")


def rapid_type_analysis(receivers: DataFrame, direct: DataFrame, allocations: DataFrame, entries: DataFrame) -> DataFrame:
    """``(graph_id, kind, id)``: reachable methods (kind ``method``) and instantiated classes (``class``).

    ``receivers(graph_id, src, receiver, dst)`` are virtual calls by receiver class, ``direct(graph_id, src,
    dst)`` static and special calls as well as static initialisers run by field access,
    ``allocations(graph_id, method, type)``.
    """
    virtual = tables.materialize(receivers.select(G, "src", "receiver", "dst").distinct())
    plain = tables.materialize(direct.select(G, "src", "dst").distinct())
    made = tables.materialize(allocations.select(G, "method", "type").distinct())
    method, cls = F.lit("method").alias("kind"), F.lit("class").alias("kind")
    seed = entries.select(G, method, F.col("method").alias("id"))

    def step(new, known):
        m = lambda df, c: df.filter("kind = 'method'").select(G, F.col("id").alias(c))
        k = lambda df: df.filter("kind = 'class'").select(G, F.col("id").alias("receiver"))
        by_method = virtual.join(m(new, "src"), [G, "src"]).join(k(known), [G, "receiver"], "left_semi")
        by_class = virtual.join(k(new), [G, "receiver"]).join(m(known, "src"), [G, "src"], "left_semi")
        run = by_method.select(G, "dst").unionByName(by_class.select(G, "dst")).unionByName(
            plain.join(m(new, "src"), [G, "src"]).select(G, "dst"))
        return run.select(G, method, F.col("dst").alias("id")).unionByName(
            made.join(m(new, "method"), [G, "method"]).select(G, cls, F.col("type").alias("id")))

    return fixpoint(seed, step)


def rapid_call_graph(receivers: DataFrame, solution: DataFrame) -> DataFrame:
    """Virtual call edges under a rapid-type solution."""
    methods = solution.filter("kind = 'method'").select(G, F.col("id").alias("src"))
    classes = solution.filter("kind = 'class'").select(G, F.col("id").alias("receiver"))
    return receivers.join(methods, [G, "src"], "left_semi").join(classes, [G, "receiver"], "left_semi").select(
        G, "site", "src", "dst").distinct()


def call_strings(cg: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """``(graph_id, method, ctx)``: methods under the last ``k`` call sites, newest first."""
    cg = tables.materialize(cg.select(G, "site", "src", "dst").distinct())
    kind = cg.schema["site"].dataType.simpleString()
    seed = entries.select(G, "method", F.array().cast(f"array<{kind}>").alias("ctx"))

    def step(new, _):
        return new.withColumnRenamed("method", "src").join(cg, [G, "src"]).select(
            G, F.col("dst").alias("method"), F.slice(F.concat(F.array("site"), "ctx"), 1, k).alias("ctx"))

    return fixpoint(seed, step)


def receiver_contexts(receivers: DataFrame, containers: DataFrame) -> DataFrame:
    """Key column for container methods: cloned per receiver object, shared (null) elsewhere.
    ``receivers(graph_id, method, obj)``, ``containers(graph_id, method)``."""
    inside = containers.select(G, "method", F.lit(True).alias("_container")).distinct()
    return receivers.join(inside, [G, "method"], "left").select(
        G, "method", F.when(F.col("_container"), F.col("obj")).alias("ctx")).distinct()


# --- statistics --------------------------------------------------------------------------------------
def call_graph_statistics(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Per graph: nodes and edges reachable from the entries; distinct methods and their bytes over the
    whole graph, bytes counted once per method. ``nodes(graph_id, id, method, bytes)``."""
    live = tables.materialize(graph.reachable(edges, entries))
    n = live.groupBy(G).agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.select(G, "src", "dst").distinct().join(live.withColumnRenamed("id", "src"), [G, "src"], "left_semi").groupBy(G).agg(
        F.count(F.lit(1)).alias("edges"))
    m = nodes.groupBy(G, "method").agg(F.max("bytes").alias("bytes")).groupBy(G).agg(
        F.count(F.lit(1)).alias("methods"), F.sum("bytes").alias("bytes"))
    return m.join(n, G, "left").join(e, G, "left").fillna(0, ["nodes", "edges"]).select(G, "nodes", "edges", "methods", "bytes")


def parameter_statistics(methods: DataFrame, parameters: DataFrame) -> DataFrame:
    """Per graph: classes, methods, parameters, mean parameters per method."""
    m = methods.groupBy(G).agg(F.count_distinct("cls").alias("classes"), F.count_distinct("method").alias("methods"))
    p = parameters.groupBy(G).agg(F.count(F.lit(1)).alias("parameters"))
    return m.join(p, G, "left").fillna(0, ["parameters"]).withColumn("mean", F.col("parameters") / F.col("methods"))


def fields_read(reads: DataFrame) -> DataFrame:
    """``(graph_id, method, field)``: the set of fields each method reads, one row per member."""
    return reads.select(G, "method", "field").distinct()


def fields_read_counts(methods: DataFrame, reads: DataFrame) -> DataFrame:
    """``(graph_id, method, n)``, 0 for methods that read none."""
    counted = fields_read(reads).groupBy(G, "method").agg(F.count(F.lit(1)).alias("n"))
    return methods.select(G, "method").distinct().join(counted, [G, "method"], "left").fillna(0, ["n"])


def mean_fields_read(counts: DataFrame) -> DataFrame:
    return counts.groupBy(G).agg(F.avg("n").alias("mean"))


def interface_usage(signatures: DataFrame) -> DataFrame:
    """Per type named in interface signatures: total occurrences, distinct methods, public methods and
    public methods of foreign packages (their first two package parts differ; primitives never foreign).

    ``signatures(graph_id, method, cls, is_public, types array)`` with types as JVM names.
    """
    from graphfacts.functions import names

    # the short package is computed before the explosion and stays null-free for the default package
    home = lambda c: F.coalesce(F.regexp_extract(c, "^\\[*L?((?:[^/;]+/){0,2})", 1), F.lit(""))
    rows = signatures.select(G, "method", "is_public", home(F.col("cls")).alias("home"), F.explode("types").alias("raw"))
    rows = rows.select(G, "method", "is_public", "home", names.innermost(F.col("raw")).alias("type"))
    foreign = ~names.is_primitive(F.col("type")) & (home(F.col("type")) != F.col("home"))
    per_method = rows.groupBy(G, "type", "method").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("is_public").alias("pub"), F.bool_or(F.col("is_public") & foreign).alias("far"))
    return per_method.groupBy(G, "type").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("methods"),
        F.count_if("pub").alias("public_methods"), F.count_if("far").alias("foreign_methods"))


def instruction_histogram(instructions: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Counts per method and instruction kind; with ``kinds`` one column each."""
    if kinds is None:
        return instructions.groupBy(G, "method", "kind").agg(F.count(F.lit(1)).alias("n"))
    return instructions.groupBy(G, "method").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def restricted_creation(methods: DataFrame, constructions: DataFrame) -> DataFrame:
    """Classes whose constructors are all private, that have a static initialiser, and that no other method
    constructs. ``constructions(graph_id, method, cls)``: method constructs cls."""
    own = methods.groupBy(G, "cls").agg(
        F.bool_and(F.when(F.col("is_constructor"), F.col("is_private"))).alias("all_private"),
        F.bool_or("is_initialiser").alias("has_initialiser"))
    other = constructions.join(methods.filter("not is_initialiser").select(G, "method"), [G, "method"], "left_semi")
    return own.filter("all_private and has_initialiser").select(G, "cls").join(
        other.select(G, "cls").distinct(), [G, "cls"], "left_anti")


def class_references(constants: DataFrame, classes: DataFrame) -> DataFrame:
    """Constant-pool rows that name one of the given classes."""
    return constants.join(classes.select("cls"), "cls", "left_semi")


def method_scan(instructions: DataFrame) -> DataFrame:
    """Per method: distinct call sites, fields read and written, array types written, allocations, caught
    and cast types, and whether it loads or stores object arrays.

    ``instructions(graph_id, method, idx, kind, operand)``.
    """
    kind, operand = F.col("kind"), F.col("operand")
    each = instructions.groupBy(G, "method", "kind", "operand").agg(F.count(F.lit(1)).alias("n"))
    rows = lambda k, name: F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).alias(name)
    distinct = lambda k, name: F.count_if((kind == k) & operand.isNotNull()).alias(name)
    return each.groupBy(G, "method").agg(
        rows("invoke", "call_sites"), distinct("getfield", "fields_read"),
        distinct("putfield", "fields_written"), distinct("arraystore", "array_types_written"),
        rows("new", "allocations"), distinct("catch", "caught_types"), distinct("checkcast", "cast_types"),
        F.bool_or((kind == "arrayload") & operand.startswith("L")).alias("object_array_load"),
        F.bool_or((kind == "arraystore") & operand.startswith("L")).alias("object_array_store"))


def scanned(instructions: DataFrame, kind: str) -> DataFrame:
    """Distinct operands of one kind of instruction per method."""
    return instructions.filter(F.col("kind") == kind).select(G, "method", "operand").distinct()


def assigns_receiver(methods: DataFrame, instructions: DataFrame) -> DataFrame:
    """``(graph_id, method, assigns_this)``: an instance method stores into local slot 0.
    ``instructions(graph_id, method, kind, slot)``."""
    hit = instructions.filter("kind = 'store' and slot = 0").select(G, "method").distinct().withColumn("hit", F.lit(True))
    return methods.select(G, "method", "is_static").join(hit, [G, "method"], "left").select(
        G, "method", (F.coalesce("hit", F.lit(False)) & ~F.col("is_static")).alias("assigns_this"))


def share_by_category(nodes: DataFrame, by: list[str], category: str, values: list[str]) -> DataFrame:
    """Size of each group and the share of every category in it."""
    return nodes.groupBy(G, *by).agg(
        F.count(F.lit(1)).alias("nodes"),
        *[F.avg(F.when(F.col(category) == v, 1.0).otherwise(0.0)).alias(f"share_{v}") for v in values])


def component_composition(components: DataFrame, categories: DataFrame, values: list[str]) -> DataFrame:
    """Composition of strongly connected components by node category (``categories(graph_id, id, category)``)."""
    return share_by_category(components.join(categories, [G, "id"]), ["component"], "category", values)


def size_by_root(references: DataFrame, objects: DataFrame, held: DataFrame) -> DataFrame:
    """``(graph_id, root, instances, bytes, mean)``, largest first: what is reachable from each root.
    ``objects(graph_id, id, bytes)``, ``held(graph_id, id)``: root objects."""
    seen = graph.reachable_from_each(references, held).join(objects, [G, "id"])
    return seen.groupBy(G, F.col("source").alias("root")).agg(
        F.count(F.lit(1)).alias("instances"), F.sum("bytes").alias("bytes")).withColumn(
        "mean", F.col("bytes") / F.col("instances")).orderBy(F.desc("bytes"), G, "root")


def collect_warnings(*parts: DataFrame) -> DataFrame:
    """Distinct warnings ``(graph_id, level, message)`` of a run, in order."""
    return compose_entries(*parts).orderBy("level", "message", G)


def field_accesses(accesses: DataFrame) -> DataFrame:
    """The access map of fields, arrays and statics: ``(graph_id, location, kind, stmt)``, one row per member,
    since a container field may be touched by any share of all statements."""
    return accesses.select(G, "location", "kind", "stmt").distinct()


def access_counts(accesses: DataFrame) -> DataFrame:
    """``(graph_id, location, reads, writes)``: how many statements read and write each location."""
    return field_accesses(accesses).groupBy(G, "location").agg(
        F.count_if(F.col("kind") == "read").alias("reads"), F.count_if(F.col("kind") == "write").alias("writes"))


def type_based_points_to(declared: DataFrame, closure: DataFrame, instantiated: DataFrame) -> DataFrame:
    """``(graph_id, var, cls)``: every instantiated subtype of a variable's declared type."""
    types = closure.join(instantiated.select(G, "cls"), [G, "cls"], "left_semi").select(G, F.col("ancestor").alias("type"), "cls")
    return declared.join(types, [G, "type"]).select(G, "var", "cls")


# --- interprocedural flow graph ------------------------------------------------------------------------
def supergraph(block_edges: DataFrame, calls: DataFrame, cg: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """``(graph_id, src, dst, label, call)``: block edges plus call → entry and exit → return site. The normal edges out of
    a call block are labelled ``call_to_return``, or ``call_none_to_return`` where no call of the block has a callee.

    ``block_edges(graph_id, src, dst, label)``; ``calls(graph_id, site, block)``: block of a call site, whose
    non-exceptional successors are the return sites; ``entries``/``exits(graph_id, method, id)``.
    """
    none = F.lit(None).cast(block_edges.schema["src"].dataType).alias("call")
    called = cg.select(G, "site").distinct().withColumn("_has", F.lit(True))
    at = calls.join(called, [G, "site"], "left").groupBy(G, "block").agg(F.bool_or(F.coalesce("_has", F.lit(False))).alias("has_callee"))
    inner = block_edges.join(at.withColumnRenamed("block", "src"), [G, "src"], "left").select(
        G, "src", "dst",
        F.when(F.col("has_callee").isNull() | (F.col("label") != "normal"), F.col("label")).when(F.col("has_callee"), "call_to_return")
        .otherwise("call_none_to_return").alias("label"), none)
    jump = cg.select(G, "site", F.col("dst").alias("method")).distinct().join(calls, [G, "site"])
    enter = jump.join(entries, [G, "method"]).select(
        G, F.col("block").alias("src"), F.col("id").alias("dst"), F.lit("call").alias("label"), none)
    after = block_edges.filter("label = 'normal'").select(G, F.col("src").alias("block"), F.col("dst").alias("ret"))
    leave = jump.join(exits, [G, "method"]).join(after, [G, "block"]).select(
        G, F.col("id").alias("src"), F.col("ret").alias("dst"), F.lit("return").alias("label"), F.col("block").alias("call"))
    return inner.unionByName(enter).unionByName(leave).distinct()


def map_nodes(nodes: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of one program graph with their counterpart (same natural key) in another, null if unmatched.
    Both have ``graph_id, id`` and the key columns."""
    return nodes.select(G, "id", *keys).join(other.select(G, F.col("id").alias("other"), *keys), [G, *keys], "left").select(
        G, "id", "other")


def branch_taken(branches: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Resolve branches on constants: ``branches(graph_id, block, op, left, right)`` gives ``taken`` true or
    false, null when an operand is unknown. A switch (op ``switch``) takes the case labelled like ``left``
    in ``cases(graph_id, block, label, target)``, its null label being the default."""
    a, b = F.col("left"), F.col("right")
    test: Column = F.when(F.col("op") == "eq", a == b).when(F.col("op") == "ne", a != b).when(
        F.col("op") == "lt", a < b).when(F.col("op") == "ge", a >= b).when(F.col("op") == "gt", a > b).when(
        F.col("op") == "le", a <= b)
    out = branches.withColumn("taken", test)
    if cases is None:
        return out
    # cases may be made from tables far smaller than they are, by whose size they would be broadcast
    match = cases.filter("label is not null").select(G, "block", F.col("label").alias("left"), F.col("target").alias("hit")).hint("merge")
    default = cases.filter("label is null").select(G, "block", F.col("target").alias("default")).hint("merge")
    return out.join(match, [G, "block", "left"], "left").join(default, [G, "block"], "left").withColumn(
        "target", F.when((F.col("op") == "switch") & F.col("left").isNotNull(), F.coalesce("hit", "default"))).drop("hit", "default")


def replace_with_models(facts: DataFrame, models: DataFrame) -> DataFrame:
    """Facts of modelled methods are replaced by the model's."""
    return facts.join(models.select(G, "method").distinct(), [G, "method"], "left_anti").unionByName(models)

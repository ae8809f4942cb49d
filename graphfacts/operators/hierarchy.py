"""Class-hierarchy queries over ``extends(graph_id, sub, sup)`` and ``implements(graph_id, cls, iface)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.plans.fixpoint import HOPS, fixpoint


def supertypes(extends: DataFrame, implements: DataFrame | None = None) -> DataFrame:
    """Direct subtype relation: superclasses and, when given, interfaces."""
    up = extends.select(G, "sub", "sup")
    if implements is not None:
        up = up.unionByName(implements.select(G, F.col("cls").alias("sub"), F.col("iface").alias("sup")))
    return up.distinct()


def ancestors(up: DataFrame, classes: DataFrame | None = None, proper: bool = False) -> DataFrame:
    """``(graph_id, cls, ancestor, distance)`` with shortest distances, the class itself at distance 0.

    ``classes(graph_id, cls)`` restricts the walk to the classes asked for.
    """
    stored = tables.write(up.select(G, "sub", "sup").distinct())
    up = stored.df
    if classes is None:
        classes = up.select(G, F.explode(F.array("sub", "sup")).alias("cls"))
    seed = classes.select(G, "cls", F.col("cls").alias("ancestor"), F.lit(0).alias("distance"))

    def step(new, _):
        return new.join(up.select(G, F.col("sub").alias("ancestor"), "sup"), [G, "ancestor"]).select(
            G, "cls", F.col("sup").alias("ancestor"), (F.col("distance") + 1).alias("distance"))

    found = fixpoint(seed, step, [G, "cls", "ancestor"], hops=HOPS)
    return found.filter("distance > 0") if proper else found


def assignable(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs(graph_id, sub, sup)`` for which sub is sup or one of its subtypes."""
    return pairs.join(closure.select(G, F.col("cls").alias("sub"), F.col("ancestor").alias("sup")), [G, "sub", "sup"], "left_semi")


def subclasses(closure: DataFrame, of: DataFrame) -> DataFrame:
    """``(graph_id, cls, sub)``: all subtypes of the asked classes, themselves included."""
    return closure.join(of.select(G, F.col("cls").alias("ancestor")), [G, "ancestor"], "left_semi").select(
        G, F.col("ancestor").alias("cls"), F.col("cls").alias("sub"))


def implementors(closure: DataFrame, interfaces: DataFrame, classes: DataFrame) -> DataFrame:
    """``(graph_id, iface, cls)``: classes (no interfaces) below each interface through either relation."""
    below = closure.select(G, F.col("ancestor").alias("iface"), "cls").join(
        interfaces.select(G, F.col("cls").alias("iface")), [G, "iface"], "left_semi")
    return below.join(classes.filter("not is_interface").select(G, "cls"), [G, "cls"], "left_semi").select(G, "iface", "cls")


def immediate_subclasses(extends: DataFrame) -> DataFrame:
    return extends.groupBy(G, F.col("sup").alias("cls")).agg(F.count_distinct("sub").alias("n"))


def common_superclass(extends: DataFrame, sets: DataFrame) -> DataFrame:
    """``(graph_id, set, superclass)``: the deepest class above every ``member`` of each set (a class is
    above itself)."""
    sets = sets.select(G, "set", "member").distinct()
    up = ancestors(extends, sets.select(G, F.col("member").alias("cls")))
    height = up.groupBy(G, "cls").agg(F.max("distance").alias("height"))
    ranked = up.join(height, [G, "cls"]).select(
        G, F.col("cls").alias("member"), "ancestor", (F.col("height") - F.col("distance")).alias("depth"))
    size = sets.groupBy(G, "set").agg(F.count(F.lit(1)).alias("size"))
    shared = sets.join(ranked, [G, "member"]).groupBy(G, "set", "ancestor").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    return shared.join(size, [G, "set"]).filter("n = size").groupBy(G, "set").agg(
        F.max_by("ancestor", F.struct("depth", "ancestor")).alias("superclass"))


def least_common_superclass(extends: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(graph_id, a, b, superclass)`` for asked ``pairs(graph_id, a, b)``."""
    key = F.struct("a", "b")
    sets = pairs.select(G, key.alias("set"), F.explode(F.array("a", "b")).alias("member"))
    return common_superclass(extends, sets).select(G, "set.a", "set.b", "superclass")


def common_supertypes(closure: DataFrame, sets: DataFrame) -> DataFrame:
    """``(graph_id, set, supertype)``: the lowest types, classes and interfaces, that are above every ``member`` of a set (a type
    is above itself). ``closure`` as from :func:`ancestors` over superclasses and interfaces. Common types below which
    no other common type stands are all returned, one row each; a set without any common type has no row."""
    sets = sets.select(G, "set", "member").distinct()
    size = sets.groupBy(G, "set").agg(F.count(F.lit(1)).alias("size"))
    up = closure.select(G, F.col("cls").alias("member"), "ancestor")
    common = tables.materialize(sets.join(up, [G, "member"]).groupBy(G, "set", "ancestor").agg(F.count(F.lit(1)).alias("n")).join(
        size, [G, "set"]).filter("n = size").select(G, "set", F.col("ancestor").alias("supertype")))
    return _lowest(closure, common)


def _lowest(closure: DataFrame, common: DataFrame) -> DataFrame:
    """Of the common types ``(graph_id, set, supertype)`` those below which no other of the set stands."""
    higher = closure.filter("distance > 0").select(G, F.col("cls").alias("supertype"), "ancestor")
    covered = common.join(higher, [G, "supertype"]).select(G, "set", F.col("ancestor").alias("supertype"))
    return common.join(covered, [G, "set", "supertype"], "left_anti")


def least_common_supertypes(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(graph_id, a, b, supertype)`` for asked ``pairs(graph_id, a, b)``, one row per lowest common type.

    The types above a type are one list, as long as the hierarchy is deep at most, so a pair stays one row. Many pairs have the same
    common types: the lowest are found once for each such list. An unnamed type (null) is common if both know one.
    """
    above = tables.materialize(closure.groupBy(G, "cls").agg(
        F.sort_array(F.collect_list("ancestor")).alias("above"), F.count_if(F.col("ancestor").isNull()).alias("unnamed")))
    both = pairs.select(G, "a", "b").distinct()
    for name in "ab":
        both = both.join(above.select(G, F.col("cls").alias(name), F.col("above").alias(f"_{name}"), F.col("unnamed").alias(f"_n{name}")), [G, name], "left")
    same, none = F.col("a").eqNullSafe(F.col("b")), F.array().cast(above.schema["above"].dataType)
    unnamed = F.coalesce("_na", F.lit(0)) + F.when(same, 0).otherwise(F.coalesce("_nb", F.lit(0)))
    types = F.array_intersect(F.coalesce("_a", none), F.coalesce("_b", none))
    types = F.when(unnamed == F.when(same, 1).otherwise(2), F.concat(types, F.array(F.lit(None).cast(above.schema["cls"].dataType)))).otherwise(types)
    both = tables.materialize(both.select(G, "a", "b", types.alias("set")).filter(F.size("set") > 0))
    lists = both.select(G, "set").distinct()
    low = tables.materialize(_lowest(closure, tables.materialize(lists.select(G, "set", F.explode("set").alias("supertype")))))
    return both.join(low, [G, "set"]).select(G, "a", "b", "supertype")


def one_supertype(found: DataFrame, by: list[str], classes: DataFrame) -> DataFrame:
    """Of several lowest common types the one to show: a class before interfaces, then the smallest name."""
    kind = classes.select(G, F.col("cls").alias("supertype"), "is_interface")
    return found.join(kind, [G, "supertype"], "left").groupBy(G, *by).agg(
        F.min_by("supertype", F.struct(F.coalesce("is_interface", F.lit(False)), "supertype")).alias("supertype"))


def resolve(closure: DataFrame, declared: DataFrame, asked: DataFrame, member: str = "method") -> DataFrame:
    """``(graph_id, cls, selector, method, owner)``: the declaration in the nearest class at or above the
    asked ``(graph_id, cls, selector)``. ``declared(graph_id, cls, selector, method)``."""
    owner = declared.select(G, F.col("cls").alias("ancestor"), "selector", member)
    near = asked.select(G, "cls", "selector").distinct().join(closure, [G, "cls"]).join(owner, [G, "ancestor", "selector"])
    best = near.groupBy(G, "cls", "selector").agg(F.min(F.struct("distance", "ancestor", member)).alias("b"))
    return best.select(G, "cls", "selector", F.col(f"b.{member}").alias(member), F.col("b.ancestor").alias("owner"))


def possible_targets(closure: DataFrame, methods: DataFrame, asked: DataFrame) -> DataFrame:
    """``(graph_id, cls, selector, method)``: what a virtual call on a receiver declared as ``cls`` may run:
    the resolved method and every override below; abstract methods never, constructors only the resolved
    one. ``methods(graph_id, cls, selector, method, is_abstract, is_constructor)``."""
    asked = asked.select(G, "cls", "selector").distinct()
    found = resolve(closure, methods, asked).join(
        methods.select(G, "method", "is_abstract", "is_constructor"), [G, "method"])
    fixed = found.filter("not is_abstract").select(G, "cls", "selector", "method")
    below = closure.filter("distance > 0").select(G, F.col("ancestor").alias("cls"), F.col("cls").alias("sub"))
    own = methods.filter("not is_abstract and not is_constructor").select(
        G, F.col("cls").alias("sub"), "selector", "method")
    over = asked.join(below, [G, "cls"]).join(own, [G, "sub", "selector"]).select(G, "cls", "selector", "method")
    return fixed.unionByName(over).distinct()


def classify(closure: DataFrame, classes: DataFrame, rules: DataFrame, framework: Column) -> DataFrame:
    """``(graph_id, cls, kind)`` by the nearest ancestor that a rule ``(ancestor, kind, priority)`` names,
    the lower priority among equally near; otherwise "unresolved". ``framework`` tells classes to skip."""
    mine = classes.filter(~framework).select(G, "cls")
    hit = closure.join(rules, "ancestor").groupBy(G, "cls").agg(
        F.min_by("kind", F.struct("distance", "priority")).alias("kind"))
    return mine.join(hit, [G, "cls"], "left").withColumn("kind", F.coalesce("kind", F.lit("unresolved")))


def abstract_without_concrete(closure: DataFrame, classes: DataFrame) -> DataFrame:
    """Abstract classes that have no concrete subclass."""
    concrete = closure.join(classes.filter("not is_abstract").select(G, "cls"), [G, "cls"], "left_semi")
    return classes.filter("is_abstract").select(G, "cls").join(
        concrete.select(G, F.col("ancestor").alias("cls")), [G, "cls"], "left_anti")


def overridden(closure: DataFrame, methods: DataFrame) -> DataFrame:
    """``(graph_id, method, overrides, root)``: nearest and farthest declaration of the selector above."""
    above = methods.select(G, "cls", "selector", "method").join(closure.filter("distance > 0"), [G, "cls"]).join(
        methods.select(G, F.col("cls").alias("ancestor"), "selector", F.col("method").alias("other")), [G, "ancestor", "selector"])
    return above.groupBy(G, "method").agg(
        F.min_by("other", F.struct("distance", "other")).alias("overrides"),
        F.max_by("other", F.struct("distance", "other")).alias("root"))


def hierarchy_size(classes: DataFrame, methods: DataFrame) -> DataFrame:
    c = classes.groupBy(G).agg(F.count_distinct("cls").alias("classes"), F.count_if("is_interface").alias("interfaces"))
    return c.join(methods.groupBy(G).agg(F.count_distinct("method").alias("methods")), G, "left").fillna(0, ["methods"])

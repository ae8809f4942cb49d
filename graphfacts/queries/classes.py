"""Hierarchy operators on the part tree (single inheritance, brands as interfaces) and the geography tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphfacts.operators import hierarchy
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.queries import query

UP = "SELECT graph_id, sub, sup FROM extends UNION ALL SELECT graph_id, cls, iface FROM implements"


def above(up: str) -> str:
    """Recursive table of (graph_id, cls, ancestor, distance) over a direct relation ``up``."""
    return (f"up AS MATERIALIZED ({up}), ids AS (SELECT graph_id, sub AS cls FROM up UNION SELECT graph_id, sup FROM up), "
            "an0(graph_id, cls, ancestor, distance) AS (SELECT graph_id, cls, cls, 0 FROM ids UNION "
            "SELECT a.graph_id, a.cls, u.sup, a.distance + 1 FROM an0 a JOIN up u ON u.graph_id = a.graph_id AND u.sub = a.ancestor), "
            "an AS MATERIALIZED (SELECT graph_id, cls, ancestor, CAST(min(distance) AS INTEGER) AS distance FROM an0 GROUP BY 1, 2, 3)")


CLASSES = above("SELECT graph_id, sub, sup FROM extends")
TYPES = above(UP)
GEO = above("SELECT graph_id, sub, sup FROM geo")


def up_classes(s):
    return tables.materialize(hierarchy.ancestors(s.extends))


def up_types(s):
    return tables.materialize(hierarchy.ancestors(hierarchy.supertypes(s.extends, s.implements)))


@query("h1_ancestors", "SELECT * FROM an", GEO)
def _(s):
    return hierarchy.ancestors(s.geo)


@query("h1_superclass_chain", "SELECT * FROM an WHERE distance > 0", CLASSES)
def _(s):
    return hierarchy.ancestors(s.extends, proper=True)


@query("h2_assignable", "SELECT DISTINCT s.graph_id, s.declared_cls AS sub, i.iface AS sup FROM sites s JOIN implements i ON concat(i.cls, '.', s.selector) = s.caller WHERE (s.declared_cls, i.iface) IN (SELECT (cls, ancestor) FROM an)", TYPES)
def _(s):
    # the calling class as a column of its own: compared as a text put together of both sides, every site would meet every interface
    calls = s.sites.filter(F.expr("endswith(caller, concat('.', selector))")).select(
        G, F.col("declared_cls").alias("sub"), F.expr("substring(caller, 1, length(caller) - length(selector) - 1)").alias("cls")).distinct()
    pairs = calls.join(s.implements.select("cls", F.col("iface").alias("sup")), "cls").select(G, "sub", "sup").distinct()
    return hierarchy.assignable(up_types(s), pairs)


@query("h3_subclasses", "SELECT graph_id, ancestor AS cls, cls AS sub FROM an WHERE ancestor IN (SELECT cls FROM classes WHERE is_abstract AND NOT is_interface)", CLASSES)
def _(s):
    return hierarchy.subclasses(up_classes(s), s.classes.filter("is_abstract and not is_interface"))


@query("h4_implementors", "SELECT graph_id, ancestor AS iface, cls FROM an WHERE ancestor IN (SELECT iface FROM implements) AND cls NOT IN (SELECT iface FROM implements)", TYPES)
def _(s):
    return hierarchy.implementors(up_types(s), s.classes.filter("is_interface"), s.classes)


@query("h5_immediate_subclasses", "SELECT graph_id, sup AS cls, count(DISTINCT sub) AS n FROM geo GROUP BY 1, 2")
def _(s):
    return hierarchy.immediate_subclasses(s.geo)


@query("h6_least_common_superclass", """
    SELECT q.graph_id, q.a, q.b, max_by(x.ancestor, d.depth) AS superclass
    FROM (SELECT DISTINCT graph_id, concat('P', o_custkey) AS a, concat('P', o_orderkey) AS b FROM (SELECT 'part' AS graph_id, o_custkey, o_orderkey FROM orders)
          WHERE o_custkey IN (SELECT p_partkey FROM part) AND o_orderkey IN (SELECT p_partkey FROM part)) q
    JOIN an x ON x.cls = q.a JOIN an y ON y.cls = q.b AND y.ancestor = x.ancestor
    JOIN (SELECT cls, count(*) AS depth FROM an GROUP BY 1) d ON d.cls = x.ancestor GROUP BY 1, 2, 3""", CLASSES)
def _(s):
    known = s.classes.select(F.col("cls"))
    q = s.orders.select(F.lit("part").alias(G), F.concat(F.lit("P"), "o_custkey").alias("a"), F.concat(F.lit("P"), "o_orderkey").alias("b")).distinct()
    q = q.join(known.withColumnRenamed("cls", "a"), "a", "left_semi").join(known.withColumnRenamed("cls", "b"), "b", "left_semi")
    return hierarchy.least_common_superclass(s.extends, q)


@query("h6_common_superclass_of_sets", """
    SELECT graph_id, set, max_by(ancestor, depth) AS superclass FROM (
        SELECT m.graph_id, m.set, x.ancestor, count(*) AS n, any_value(d.depth) AS depth, any_value(m.size) AS size
        FROM (SELECT graph_id, iface AS set, cls AS member, count(*) OVER (PARTITION BY iface) AS size FROM implements) m
        JOIN an x ON x.cls = m.member JOIN (SELECT cls, count(*) AS depth FROM an GROUP BY 1) d ON d.cls = x.ancestor GROUP BY 1, 2, 3)
    WHERE n = size GROUP BY 1, 2""", CLASSES)
def _(s):
    return hierarchy.common_superclass(s.extends, s.implements.select(G, F.col("iface").alias("set"), F.col("cls").alias("member")))


def lowest(sets: str) -> str:
    """Tables of common types ``ct(graph_id, key, ancestor)`` and the lowest of them, ``low``, for ``sets(graph_id, key, member)``."""
    return f"""ms AS MATERIALIZED (SELECT DISTINCT * FROM ({sets})),
    ct AS MATERIALIZED (SELECT m.graph_id, m.key, x.ancestor FROM ms m JOIN an x ON x.cls = m.member
        GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM ms n WHERE n.graph_id = m.graph_id AND n.key = m.key)),
    low AS MATERIALIZED (SELECT c.* FROM ct c WHERE NOT EXISTS (
        SELECT 1 FROM ct d JOIN an x ON x.cls = d.ancestor AND x.distance > 0 WHERE d.graph_id = c.graph_id AND d.key = c.key AND x.ancestor = c.ancestor))"""


PAIRS = """SELECT DISTINCT 'part' AS graph_id, concat('P', cast(a.l_partkey AS string)) AS a, concat('P', cast(b.l_partkey AS string)) AS b
    FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""


# parts of consecutive lines, superclasses and interfaces
@query("h6_least_common_supertypes", "SELECT graph_id, key.a AS a, key.b AS b, ancestor AS supertype FROM low",
       TYPES + ", " + lowest(f"SELECT graph_id, {{'a': a, 'b': b}} AS key, unnest([a, b]) AS member FROM ({PAIRS})"))
def _(s):
    return hierarchy.least_common_supertypes(up_types(s), s.sql(PAIRS))


@query("h6_common_supertype_of_sets", """
    SELECT l.graph_id, l.key AS set, arg_min(l.ancestor, (coalesce(c.is_interface, false), l.ancestor)) AS supertype
    FROM low l LEFT JOIN classes c ON c.cls = l.ancestor GROUP BY 1, 2""", TYPES + ", " + lowest("SELECT graph_id, iface AS key, cls AS member FROM implements"))
def _(s):
    found = hierarchy.common_supertypes(up_types(s), s.implements.select(G, F.col("iface").alias("set"), F.col("cls").alias("member")))
    return hierarchy.one_supertype(found, ["set"], s.classes)


ASKED = "SELECT DISTINCT graph_id, declared_cls AS cls, selector FROM sites"
RESOLVED = f"""res AS MATERIALIZED (SELECT q.graph_id, q.cls, q.selector, min_by(m.method, a.distance) AS method, min_by(a.ancestor, a.distance) AS owner
    FROM ({ASKED}) q JOIN an a ON a.cls = q.cls JOIN methods m ON m.cls = a.ancestor AND m.selector = q.selector GROUP BY 1, 2, 3)"""
TARGETS = f"""tg AS MATERIALIZED (SELECT r.graph_id, r.cls, r.selector, r.method FROM res r JOIN methods m ON m.method = r.method WHERE NOT m.is_abstract
    UNION SELECT q.graph_id, q.cls, q.selector, m.method FROM ({ASKED}) q JOIN an a ON a.ancestor = q.cls AND a.distance > 0
    JOIN methods m ON m.cls = a.cls AND m.selector = q.selector WHERE NOT m.is_abstract AND NOT m.is_constructor)"""


def asked(s):
    return s.sites.select(G, F.col("declared_cls").alias("cls"), "selector")


@query("h7_method_resolution", "SELECT * FROM res", ", ".join([CLASSES, RESOLVED]))
def _(s):
    return hierarchy.resolve(up_classes(s), s.methods, asked(s))


@query("h7_field_resolution", """
    SELECT q.graph_id, q.cls, q.selector, min_by(f.field, a.distance) AS field, min_by(a.ancestor, a.distance) AS owner
    FROM (SELECT graph_id, cls, 'getter' AS selector FROM classes WHERE NOT is_interface) q JOIN an a ON a.cls = q.cls
    JOIN (SELECT cls, concat(cls, ':f') AS field FROM implements) f ON f.cls = a.ancestor GROUP BY 1, 2, 3""", CLASSES)
def _(s):
    fields = s.implements.select(G, "cls", F.lit("getter").alias("selector"), F.concat("cls", F.lit(":f")).alias("field"))
    q = s.classes.filter("not is_interface").select(G, "cls", F.lit("getter").alias("selector"))
    return hierarchy.resolve(up_classes(s), fields, q, member="field")


@query("h8_j3_possible_targets", "SELECT * FROM tg", ", ".join([CLASSES, RESOLVED, TARGETS]))
def _(s):
    return hierarchy.possible_targets(up_classes(s), s.methods, asked(s))


RULES = [("P1", "Activity", 1), ("P2", "Service", 2), ("P5", "IntentService", 3), ("P12", "Application", 4), ("Brand#4", "Runnable", 9)]
KINDS = "(VALUES " + ", ".join(f"('{a}', '{k}', {p})" for a, k, p in RULES) + ") r(ancestor, kind, priority)"


@query("h9_component_kinds", f"""
    SELECT c.graph_id, c.cls, coalesce(k.kind, 'unresolved') AS kind FROM classes c
    LEFT JOIN (SELECT a.cls, arg_min(r.kind, a.distance * 100 + r.priority) AS kind FROM an a JOIN {KINDS} ON r.ancestor = a.ancestor GROUP BY 1) k ON k.cls = c.cls
    WHERE c.loader <> 'Primordial'""", TYPES)
def _(s):
    rules = s.spark.createDataFrame(RULES, "ancestor string, kind string, priority int")
    return hierarchy.classify(up_types(s), s.classes, rules, F.col("loader").isin("Primordial", "Extension"))


@query("h10_abstract_without_concrete", """
    SELECT graph_id, cls FROM classes WHERE is_abstract AND cls NOT IN (SELECT a.ancestor FROM an a JOIN classes c ON c.cls = a.cls WHERE NOT c.is_abstract)""", CLASSES)
def _(s):
    return hierarchy.abstract_without_concrete(up_classes(s), s.classes)


@query("h11_overridden", """
    SELECT m.graph_id, m.method, min_by(o.method, a.distance) AS overrides, max_by(o.method, a.distance) AS root
    FROM methods m JOIN an a ON a.cls = m.cls AND a.distance > 0 JOIN methods o ON o.cls = a.ancestor AND o.selector = m.selector GROUP BY 1, 2""", CLASSES)
def _(s):
    return hierarchy.overridden(up_classes(s), s.methods)

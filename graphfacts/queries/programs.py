"""Call graph, points-to, dependence and slicing operators on facts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphfacts.operators import contexts, dataflow, graph, heap, hierarchy, program, slicing
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.queries import query
from graphfacts.queries.classes import CLASSES, RESOLVED, TARGETS, TYPES, asked, up_classes, up_types
from graphfacts.queries.flows import WRITES as DEFINED
from graphfacts.queries.flows import reaching_sql
from graphfacts.queries.graphs import AVOID, DOM, closure, inverse, reach

# --- entry points and call graphs -------------------------------------------------------------------------
ENTRIES = "SELECT graph_id, method FROM methods WHERE is_static AND NOT is_abstract"


@query("p1_entry_points", """
    SELECT graph_id, method FROM methods WHERE NOT is_abstract AND cls IN (SELECT cls FROM classes WHERE loader = 'Application')
    UNION SELECT graph_id, method FROM methods WHERE NOT is_abstract AND cls IN (SELECT a.cls FROM an a JOIN implements i ON i.iface = a.ancestor)""", TYPES)
def _(s):
    by_type = program.methods_of_subtypes(s.methods, up_types(s), s.implements.select(G, F.col("iface").alias("cls")))
    return program.compose_entries(program.all_methods_of(s.methods, s.classes, "Application"), by_type, program.main_methods(s.methods))


EDGES = "ce AS MATERIALIZED (SELECT DISTINCT s.graph_id, s.site, s.caller AS src, t.method AS dst FROM sites s JOIN tg t ON t.cls = s.declared_cls AND t.selector = s.selector)"


@query("p2_hierarchy_call_graph", "SELECT graph_id, site, src, dst FROM ce WHERE src IN (SELECT id FROM live)",
       ", ".join([CLASSES, RESOLVED, TARGETS, EDGES, f"e0 AS MATERIALIZED (SELECT graph_id, method AS id FROM ({ENTRIES}))", reach("live", "ce", "e0")]))
def _(s):
    return program.hierarchy_call_graph(s.sites, up_classes(s), s.methods, s.sql(ENTRIES))


ALLOC = "SELECT graph_id, caller AS method, declared_cls AS type FROM sites WHERE selector = '<init>'"
RECEIVERS = """rv AS MATERIALIZED (SELECT DISTINCT s.graph_id, s.caller AS src, b.cls AS receiver, m.method AS dst FROM sites s
    JOIN an b ON b.ancestor = s.declared_cls JOIN (SELECT q.cls, q.selector, min_by(m.method, a.distance) AS method FROM
        (SELECT DISTINCT b.cls, s.selector FROM sites s JOIN an b ON b.ancestor = s.declared_cls WHERE s.selector <> '<init>') q
        JOIN an a ON a.cls = q.cls JOIN methods m ON m.cls = a.ancestor AND m.selector = q.selector GROUP BY 1, 2) r ON r.cls = b.cls AND r.selector = s.selector
    JOIN methods m ON m.method = r.method AND NOT m.is_abstract WHERE s.selector <> '<init>')"""
DIRECT = """SELECT s.graph_id, s.caller AS src, m.method AS dst FROM sites s JOIN methods m ON m.cls = s.declared_cls AND m.selector = '<init>' WHERE s.selector = '<init>'"""
RTA = f"""dr AS MATERIALIZED (SELECT DISTINCT * FROM ({DIRECT})), al AS MATERIALIZED (SELECT DISTINCT * FROM ({ALLOC})),
    t(kind, id) USING KEY (kind, id) AS (SELECT 'method', method FROM ({ENTRIES}) UNION
        SELECT n.* FROM (SELECT DISTINCT * FROM (
            SELECT 'method' AS kind, v.dst AS id FROM t JOIN rv v ON t.kind = 'method' AND v.src = t.id JOIN recurring.t c ON c.kind = 'class' AND c.id = v.receiver
            UNION ALL SELECT 'method', v.dst FROM t JOIN rv v ON t.kind = 'class' AND v.receiver = t.id JOIN recurring.t m ON m.kind = 'method' AND m.id = v.src
            UNION ALL SELECT 'method', d.dst FROM t JOIN dr d ON t.kind = 'method' AND d.src = t.id
            UNION ALL SELECT 'class', a.type FROM t JOIN al a ON t.kind = 'method' AND a.method = t.id)) n
        WHERE NOT EXISTS (SELECT 1 FROM recurring.t o WHERE o.kind = n.kind AND o.id = n.id))"""


def _rta(s):
    virtual = s.sites.filter("selector <> '<init>'")
    receivers = tables.materialize(program.receiver_table(virtual, up_classes(s), s.methods))
    return receivers, tables.materialize(program.rapid_type_analysis(receivers, s.sql(DIRECT), s.sql(ALLOC), s.sql(ENTRIES)))


@query("p3_rapid_type_analysis", "SELECT 'part' AS graph_id, kind, id FROM t", ", ".join([CLASSES, RECEIVERS, RTA]))
def _(s):
    return _rta(s)[1]


@query("p3_rapid_call_graph", """
    SELECT DISTINCT graph_id, src, dst FROM rv WHERE src IN (SELECT id FROM t WHERE kind = 'method') AND receiver IN (SELECT id FROM t WHERE kind = 'class')""",
       ", ".join([CLASSES, RECEIVERS, RTA]))
def _(s):
    return program.rapid_call_graph(*_rta(s)).select(G, "src", "dst").distinct()


@query("p6_v5_call_strings", "SELECT * FROM c",
       """cg AS MATERIALIZED (SELECT graph_id, site, src, dst FROM call_edges),
       c(graph_id, method, ctx) AS (SELECT graph_id, id, []::BIGINT[] FROM supp_high UNION
          SELECT c.graph_id, g.dst, list_slice(list_prepend(g.site, c.ctx), 1, 2) FROM c JOIN cg g ON g.graph_id = c.graph_id AND g.src = c.method)""")
def _(s):
    cg = tables.materialize(s.call_edges)
    return program.call_strings(cg, s.supp_high.withColumnRenamed("id", "method"), 2)


@query("p6_receiver_contexts", """
    SELECT DISTINCT 'heap' AS graph_id, l_returnflag AS method, CASE WHEN l_returnflag = 'R' THEN concat('o', l_suppkey) END AS ctx FROM lineitem""")
def _(s):
    r = s.lineitem.select(F.lit("heap").alias(G), F.col("l_returnflag").alias("method"), F.concat(F.lit("o"), "l_suppkey").alias("obj"))
    boxes = s.lineitem.filter("l_returnflag = 'R'").select(F.lit("heap").alias(G), F.col("l_returnflag").alias("method"))
    return program.receiver_contexts(r, boxes)


ACCESSES = "SELECT 'li' AS graph_id, l_partkey AS location, l_orderkey AS stmt, CASE WHEN l_linestatus = 'F' THEN 'read' ELSE 'write' END AS kind FROM lineitem"


@query("p12_field_accesses", f"SELECT DISTINCT graph_id, location, kind, stmt FROM ({ACCESSES})")
def _(s):
    return program.field_accesses(s.sql(ACCESSES))


@query("p12_access_counts", f"""
    SELECT graph_id, location, count(DISTINCT stmt) FILTER (kind = 'read') AS reads, count(DISTINCT stmt) FILTER (kind = 'write') AS writes FROM ({ACCESSES}) GROUP BY 1, 2""")
def _(s):
    return program.access_counts(s.sql(ACCESSES))


@query("p17_supergraph", """
    SELECT graph_id, src, dst, label, call FROM super WHERE label IN ('call', 'return', 'normal', 'call_none_to_return')
    UNION SELECT graph_id, site, site + 1, 'call_to_return', NULL FROM call_edges""")
def _(s):
    n = s.supp_nodes
    at = lambda i: (F.col("id") * 10 + i)
    blocks = n.select(G, F.explode(F.array(*[F.struct(at(i).alias("src"), at(i + 1).alias("dst")) for i in range(5)])).alias("e")).select(
        G, "e.src", "e.dst", F.lit("normal").alias("label"))
    calls = n.select(G, F.explode(F.array(at(1), at(3))).alias("block")).withColumn("site", F.col("block"))
    cg = s.call_edges
    ends = lambda i: n.select(G, F.col("id").alias("method"), at(i).alias("id"))
    return program.supergraph(blocks, calls, cg, ends(0), ends(5))


@query("p22_type_based_points_to", """
    SELECT DISTINCT s.graph_id, s.site AS var, a.cls FROM sites s JOIN an a ON a.ancestor = s.declared_cls WHERE a.cls IN (SELECT type FROM ({0}))""".format(ALLOC), CLASSES)
def _(s):
    declared = s.sites.select(G, F.col("site").alias("var"), F.col("declared_cls").alias("type"))
    made = s.sql(ALLOC).select(G, F.col("type").alias("cls")).distinct()
    return program.type_based_points_to(declared, up_classes(s), made)


@query("j7_map_nodes", """
    SELECT a.graph_id, concat(a.graph_id, a.id) AS id, b.id AS other FROM supp_nodes a LEFT JOIN (SELECT graph_id, concat('m', id) AS id, id AS method FROM supp_rich) b
    ON b.graph_id = a.graph_id AND b.method = a.id""")
def _(s):
    a = s.supp_nodes.select(G, F.concat(G, "id").alias("id"), F.col("id").alias("method"))
    return program.map_nodes(a, s.supp_rich.select(G, F.concat(F.lit("m"), "id").alias("id"), F.col("id").alias("method")), ["method"])


# --- points-to -----------------------------------------------------------------------------------------------
def facts(s) -> dict:
    return {
        "allocs": s.pt_allocs, "assigns": s.pt_assigns.withColumnRenamed("cast_type", "cast"), "loads": s.pt_loads, "stores": s.pt_stores,
        "direct_calls": s.pt_direct, "virtual_calls": s.pt_virtual, "args": s.pt_args, "results": s.pt_results,
        "params": s.pt_params, "returns": s.pt_returns, "dispatch": s.pt_dispatch}


def solved(s) -> heap.PointsTo:
    subtypes = up_classes(s).select(G, F.col("cls").alias("sub"), F.col("ancestor").alias("sup")).withColumn(G, F.lit("heap"))
    return heap.points_to(facts(s), s.pt_entries, subtypes)


# one keyed recursion over rows (k, a, b, c): pts(pointer, object, type), flow(dst, src, cast), call(site, target, caller), live(method)
POINTS = CLASSES + """, f_al AS MATERIALIZED (SELECT * FROM pt_allocs), f_as AS MATERIALIZED (SELECT * FROM pt_assigns), f_ld AS MATERIALIZED (SELECT * FROM pt_loads),
    f_st AS MATERIALIZED (SELECT * FROM pt_stores), f_vc AS MATERIALIZED (SELECT v.*, d.type, d.method AS target FROM pt_virtual v JOIN pt_dispatch d ON d.selector = v.selector),
    pt(k, a, b, c) USING KEY (k, a, b, c) AS (SELECT 'live', method, '', '' FROM pt_entries UNION
      SELECT n.* FROM (SELECT DISTINCT * FROM (
        SELECT 'pts' AS k, f.var AS a, f.obj AS b, f.type AS c FROM pt JOIN f_al f ON pt.k = 'live' AND f.method = pt.a
        UNION ALL SELECT 'flow', f.dst, f.src, coalesce(f.cast_type, '') FROM pt JOIN f_as f ON pt.k = 'live' AND f.method = pt.a
        UNION ALL SELECT 'call', d.site, d.target, d.method FROM pt JOIN pt_direct d ON pt.k = 'live' AND d.method = pt.a
        UNION ALL SELECT 'pts', f.a, p.b, p.c FROM pt f JOIN recurring.pt p ON f.k = 'flow' AND p.k = 'pts' AND p.a = f.b WHERE f.c = '' OR (p.c, f.c) IN (SELECT (cls, ancestor) FROM an)
        UNION ALL SELECT 'pts', f.a, p.b, p.c FROM recurring.pt f JOIN pt p ON f.k = 'flow' AND p.k = 'pts' AND p.a = f.b WHERE f.c = '' OR (p.c, f.c) IN (SELECT (cls, ancestor) FROM an)
        UNION ALL SELECT 'flow', l.dst, concat(p.b, '.', l.field), '' FROM pt p JOIN f_ld l ON p.k = 'pts' AND l.base = p.a
        UNION ALL SELECT 'flow', concat(p.b, '.', l.field), l.src, '' FROM pt p JOIN f_st l ON p.k = 'pts' AND l.base = p.a
        UNION ALL SELECT 'call', v.site, v.target, v.method FROM pt p JOIN f_vc v ON p.k = 'pts' AND v.receiver = p.a AND v.type = p.c
        UNION ALL SELECT 'pts', r.var, p.b, p.c FROM pt p JOIN f_vc v ON p.k = 'pts' AND v.receiver = p.a AND v.type = p.c JOIN pt_params r ON r.method = v.target AND r.pos = 0
        UNION ALL SELECT 'flow', r.var, a.var, '' FROM pt c JOIN pt_args a ON c.k = 'call' AND a.site = c.a JOIN pt_params r ON r.method = c.b AND r.pos = a.pos AND r.pos > 0
        UNION ALL SELECT 'flow', a.var, r.var, '' FROM pt c JOIN pt_results a ON c.k = 'call' AND a.site = c.a JOIN pt_returns r ON r.method = c.b
        UNION ALL SELECT 'live', c.b, '', '' FROM pt c WHERE c.k = 'call')) n
      WHERE NOT EXISTS (SELECT 1 FROM recurring.pt o WHERE o.k = n.k AND o.a = n.a AND o.b = n.b AND o.c = n.c))"""
PTS = "pts AS MATERIALIZED (SELECT 'heap' AS graph_id, a AS pk, b AS obj, c AS type FROM pt WHERE k = 'pts')"


@query("p4_j4_p7_points_to", "SELECT 'heap' AS graph_id, a AS pk, b AS obj, c AS type FROM pt WHERE k = 'pts'", POINTS)
def _(s):
    return solved(s).points_to


@query("p4_call_graph", "SELECT 'heap' AS graph_id, a AS site, c AS src, b AS dst FROM pt WHERE k = 'call'", POINTS)
def _(s):
    return solved(s).calls


# --- contexts --------------------------------------------------------------------------------------------------
def _contextual(s, policy, containers=True) -> contexts.ContextSensitive:
    facts = {"locals": s.cx_locals, "allocs": heap.name_objects(s.cx_allocs), "assigns": s.cx_assigns.withColumnRenamed("cast_type", "cast"), "loads": s.cx_loads,
             "stores": s.cx_stores, "direct_calls": s.cx_direct, "virtual_calls": s.cx_virtual, "args": s.cx_args, "results": s.cx_results,
             "params": s.cx_params, "returns": s.cx_returns, "dispatch": s.cx_dispatch}
    above = up_classes(s).select(F.col("cls").alias("sub"), F.col("ancestor").alias("sup"))
    subtypes = s.cx_allocs.select(G, F.col("type").alias("sub")).distinct().join(above, "sub").select(G, "sub", "sup")
    return contexts.points_to(facts, s.cx_entries, subtypes, policy, s.cx_boxes if containers else None, clone=containers)


INTO = """CASE WHEN {box} THEN concat('@', {obj}) ELSE array_to_string(list_slice(list_prepend({site}, CASE WHEN {ctx} = '' OR starts_with({ctx}, '@') THEN [] ELSE string_split({ctx}, '/') END), 1, 2), '/') END"""
# rows (g, k, a, ac, b, bc, c) as in `pt`, with the contexts of a and b
CONTEXTS = CLASSES + f""", f_lc AS MATERIALIZED (SELECT graph_id AS g, method, var FROM cx_locals),
    f_al AS MATERIALIZED (SELECT a.graph_id AS g, a.method, a.var, a.type, l.var IS NOT NULL AS own, CASE WHEN is_string OR is_throwable OR only_primitives THEN concat('type:', a.type)
        WHEN n.n > 25 THEN concat('method:', a.method, '/', a.type) ELSE concat('site:', a.site) END AS obj FROM cx_allocs a
        JOIN (SELECT graph_id, method, type, count(DISTINCT site) AS n FROM cx_allocs GROUP BY 1, 2, 3) n ON n.graph_id = a.graph_id AND n.method = a.method AND n.type = a.type
        LEFT JOIN f_lc l ON l.g = a.graph_id AND l.method = a.method AND l.var = a.var),
    f_as AS MATERIALIZED (SELECT a.graph_id AS g, a.method, a.dst, a.src, coalesce(cast_type, '') AS c, d.var IS NOT NULL AS dst_own, r.var IS NOT NULL AS src_own FROM cx_assigns a
        LEFT JOIN f_lc d ON d.g = a.graph_id AND d.method = a.method AND d.var = a.dst LEFT JOIN f_lc r ON r.g = a.graph_id AND r.method = a.method AND r.var = a.src),
    f_ld AS MATERIALIZED (SELECT * FROM cx_loads), f_st AS MATERIALIZED (SELECT * FROM cx_stores), f_di AS MATERIALIZED (SELECT * FROM cx_direct),
    f_vc AS MATERIALIZED (SELECT v.graph_id AS g, v.method, v.site, v.receiver, d.type, d.method AS target, b.method IS NOT NULL AS box FROM cx_virtual v
        JOIN cx_dispatch d ON d.graph_id = v.graph_id AND d.selector = v.selector LEFT JOIN cx_boxes b ON b.graph_id = d.graph_id AND b.method = d.method),
    f_pm AS MATERIALIZED (SELECT * FROM cx_params), f_ar AS MATERIALIZED (SELECT * FROM cx_args), f_rs AS MATERIALIZED (SELECT * FROM cx_results), f_rt AS MATERIALIZED (SELECT * FROM cx_returns),
    ct(g, k, a, ac, b, bc, c) USING KEY (g, k, a, ac, b, bc, c) AS (SELECT graph_id, 'live', method, '', '', '', '' FROM cx_entries UNION
      SELECT n.* FROM (SELECT DISTINCT * FROM (
        SELECT t.g, 'pts' AS k, f.var AS a, CASE WHEN f.own THEN t.ac ELSE '' END AS ac, f.obj AS b, CASE WHEN starts_with(f.obj, 'site:') THEN t.ac ELSE '' END AS bc, f.type AS c
            FROM ct t JOIN f_al f ON t.k = 'live' AND f.g = t.g AND f.method = t.a
        UNION ALL SELECT t.g, 'flow', f.dst, CASE WHEN f.dst_own THEN t.ac ELSE '' END, f.src, CASE WHEN f.src_own THEN t.ac ELSE '' END, f.c FROM ct t JOIN f_as f ON t.k = 'live' AND f.g = t.g AND f.method = t.a
        UNION ALL SELECT t.g, 'call', d.site, t.ac, d.target, {INTO.format(box='false', obj="''", site='d.site', ctx='t.ac')}, t.a FROM ct t JOIN f_di d ON t.k = 'live' AND d.graph_id = t.g AND d.method = t.a
        UNION ALL SELECT f.g, 'pts', f.a, f.ac, p.b, p.bc, p.c FROM ct f JOIN recurring.ct p ON f.k = 'flow' AND p.k = 'pts' AND p.g = f.g AND p.a = f.b AND p.ac = f.bc WHERE f.c = '' OR (p.c, f.c) IN (SELECT (cls, ancestor) FROM an)
        UNION ALL SELECT f.g, 'pts', f.a, f.ac, p.b, p.bc, p.c FROM recurring.ct f JOIN ct p ON f.k = 'flow' AND p.k = 'pts' AND p.g = f.g AND p.a = f.b AND p.ac = f.bc WHERE f.c = '' OR (p.c, f.c) IN (SELECT (cls, ancestor) FROM an)
        UNION ALL SELECT p.g, 'flow', l.dst, p.ac, concat(p.b, '.', l.field), p.bc, '' FROM ct p JOIN f_ld l ON p.k = 'pts' AND l.graph_id = p.g AND l.base = p.a
        UNION ALL SELECT p.g, 'flow', concat(p.b, '.', l.field), p.bc, l.src, p.ac, '' FROM ct p JOIN f_st l ON p.k = 'pts' AND l.graph_id = p.g AND l.base = p.a
        UNION ALL SELECT p.g, 'call', v.site, p.ac, v.target, {INTO.format(box='v.box', obj='p.b', site='v.site', ctx='p.ac')}, v.method FROM ct p JOIN f_vc v ON p.k = 'pts' AND v.g = p.g AND v.receiver = p.a AND v.type = p.c
        UNION ALL SELECT p.g, 'pts', r.var, {INTO.format(box='v.box', obj='p.b', site='v.site', ctx='p.ac')}, p.b, p.bc, p.c FROM ct p JOIN f_vc v ON p.k = 'pts' AND v.g = p.g AND v.receiver = p.a AND v.type = p.c
            JOIN f_pm r ON r.graph_id = p.g AND r.method = v.target AND r.pos = 0
        UNION ALL SELECT c.g, 'flow', r.var, c.bc, a.var, c.ac, '' FROM ct c JOIN f_ar a ON c.k = 'call' AND a.graph_id = c.g AND a.site = c.a JOIN f_pm r ON r.graph_id = c.g AND r.method = c.b AND r.pos = a.pos AND r.pos > 0
        UNION ALL SELECT c.g, 'flow', a.var, c.ac, r.var, c.bc, '' FROM ct c JOIN f_rs a ON c.k = 'call' AND a.graph_id = c.g AND a.site = c.a JOIN f_rt r ON r.graph_id = c.g AND r.method = c.b
        UNION ALL SELECT c.g, 'live', c.b, c.bc, '', '', '' FROM ct c WHERE c.k = 'call')) n
      WHERE NOT EXISTS (SELECT 1 FROM recurring.ct o WHERE o.g = n.g AND o.k = n.k AND o.a = n.a AND o.ac = n.ac AND o.b = n.b AND o.bc = n.bc AND o.c = n.c))"""


@query("p6_points_to_contexts", "SELECT g AS graph_id, a AS pk, ac AS ctx, b AS obj, bc AS obj_ctx, c AS type FROM ct WHERE k = 'pts'", CONTEXTS)
def _(s):
    return _contextual(s, contexts.receivers(contexts.call_string(2))).points_to


@query("p6_calls_in_context", "SELECT g AS graph_id, a AS site, c AS src, ac AS src_ctx, b AS dst, bc AS dst_ctx FROM ct WHERE k = 'call'", CONTEXTS)
def _(s):
    return _contextual(s, contexts.receivers(contexts.call_string(2))).calls


NAMED = """SELECT l_returnflag AS graph_id, l_suppkey AS method, l_orderkey AS site, p_type AS type, p_size < 5 AS is_string, p_size > 48 AS is_throwable,
           p_size = 25 AS only_primitives FROM lineitem JOIN part ON p_partkey = l_partkey"""


@query("p5_object_names", f"""
    SELECT DISTINCT a.graph_id, a.method, a.site, a.type, CASE WHEN is_string OR is_throwable OR only_primitives THEN concat('type:', a.type)
        WHEN c.n > 25 THEN concat('method:', a.method, '/', a.type) ELSE concat('site:', a.site) END AS obj
    FROM ({NAMED}) a JOIN (SELECT graph_id, method, type, count(DISTINCT site) AS n FROM ({NAMED}) GROUP BY 1, 2, 3) c
    ON c.graph_id = a.graph_id AND c.method = a.method AND c.type = a.type""")
def _(s):
    return heap.name_objects(s.sql(NAMED)).select(G, "method", "site", "type", "obj").distinct()


@query("j4_type_filtered_assignment", """
    SELECT DISTINCT a.graph_id, a.site AS dst, a.caller AS obj FROM sites a JOIN an x ON concat(x.cls, '.', regexp_extract(a.caller, '[a-z]+$', 0)) = a.caller AND x.ancestor IN ('P1', 'P5')
    WHERE x.ancestor = CASE WHEN a.selector = 'ring' THEN 'P1' ELSE 'P5' END""", CLASSES)
def _(s):
    rows = s.sites.select(G, F.col("site").alias("dst"), F.col("caller").alias("obj"), F.regexp_extract("caller", "^(P[0-9]+)", 1).alias("type"),
                          F.when(F.col("selector") == "ring", "P1").otherwise("P5").alias("filter"))
    return heap.assignable_only(rows, up_classes(s).select(G, F.col("cls").alias("sub"), F.col("ancestor").alias("sup")))


@query("p9_flows_to", "SELECT DISTINCT 'heap' AS graph_id, obj, pk FROM fl",
       "ar AS MATERIALIZED (SELECT src, dst FROM pt_assigns), fl(obj, pk) AS (SELECT obj, var FROM pt_allocs UNION SELECT f.obj, e.dst FROM fl f JOIN ar e ON e.src = f.pk)")
def _(s):
    return heap.flows_to(s.pt_assigns, s.pt_allocs, s.pt_allocs)


DEMAND = """bk AS MATERIALIZED (SELECT dst AS cur, src AS nxt FROM pt_assigns UNION SELECT dst, concat('field:', field) FROM pt_loads UNION SELECT concat('field:', field), src FROM pt_stores),
    ak AS MATERIALIZED (SELECT receiver AS pk FROM pt_virtual), dm(pk, cur) AS (SELECT pk, pk FROM ak UNION SELECT d.pk, b.nxt FROM dm d JOIN bk b ON b.cur = d.cur)"""


@query("p10_demand_points_to", """
    SELECT 'heap' AS graph_id, a.pk, h.obj, CASE WHEN h.obj IS NULL THEN 'NOMOREREFINE' ELSE 'SUCCESS' END AS status FROM (SELECT DISTINCT pk FROM ak) a
    LEFT JOIN (SELECT DISTINCT d.pk, l.obj FROM dm d JOIN pt_allocs l ON l.var = d.cur) h ON h.pk = a.pk""", DEMAND)
def _(s):
    return heap.demand_points_to(facts(s), s.pt_virtual.select(G, F.col("receiver").alias("pk")))


@query("p10_demand_budget", """
    SELECT 'heap' AS graph_id, a.pk, h.obj, CASE WHEN a.pk IN (SELECT z.pk FROM two z WHERE (z.pk, z.cur) NOT IN (SELECT (pk, cur) FROM one)) THEN 'BUDGETEXCEEDED'
        WHEN h.obj IS NULL THEN 'NOMOREREFINE' ELSE 'SUCCESS' END AS status FROM (SELECT DISTINCT pk FROM ak) a
    LEFT JOIN (SELECT DISTINCT d.pk, l.obj FROM one d JOIN pt_allocs l ON l.var = d.cur) h ON h.pk = a.pk""",
       DEMAND + """, one AS MATERIALIZED (SELECT pk, pk AS cur FROM ak UNION SELECT a.pk, b.nxt FROM ak a JOIN bk b ON b.cur = a.pk),
       two AS MATERIALIZED (SELECT o.pk, b.nxt AS cur FROM one o JOIN bk b ON b.cur = o.cur)""")
def _(s):
    return heap.demand_points_to(facts(s), s.pt_virtual.select(G, F.col("receiver").alias("pk")), rounds=1)


@query("p11_unsafe_casts", """
    SELECT DISTINCT 'heap' AS graph_id, concat('cast', p.pk) AS cast_site, p.obj, p.type FROM pts p JOIN pt_virtual v ON v.receiver = p.pk WHERE (p.type, 'P1') NOT IN (SELECT (cls, ancestor) FROM an)""",
       POINTS + ", " + PTS)
def _(s):
    casts = s.pt_virtual.select(G, F.concat(F.lit("cast"), "receiver").alias("cast_site"), F.col("receiver").alias("pk"), F.lit("P1").alias("target"))
    subtypes = up_classes(s).select(F.lit("heap").alias(G), F.col("cls").alias("sub"), F.col("ancestor").alias("sup"))
    return heap.unsafe_casts(casts, tables.materialize(solved(s).points_to), subtypes)


# a simple heap relation, one per customer and order status, for the operators that take a finished solution: open lines say that a
# supplier variable holds a part object, filled lines that a field of the part holds what the supplier does
HOLDS = """SELECT DISTINCT graph_id, concat('s', cast(l_suppkey AS string)) AS pk, concat('o', cast(l_partkey AS string)) AS obj,
           concat('T', cast(l_linenumber AS string)) AS type FROM graph_lines WHERE l_linestatus = 'O'"""
OBJECTS = "SELECT DISTINCT graph_id, pk, obj FROM ({0})".format(HOLDS)
FIELDS = """SELECT DISTINCT graph_id, concat('o', cast(l_partkey AS string)) AS obj, concat('s', cast(l_suppkey AS string)) AS pk
            FROM graph_lines WHERE l_linestatus <> 'O'"""
HEAP = f"SELECT graph_id, pk AS src, obj AS dst FROM ({HOLDS}) UNION SELECT graph_id, obj, pk FROM ({FIELDS})"
POINTERS = """SELECT graph_id, concat('s', cast(s_suppkey AS string)) AS pk, CASE WHEN s_acctbal < 0 THEN 'static' WHEN s_acctbal > 8000 THEN 'return' ELSE 'local' END AS kind,
    CASE WHEN s_acctbal >= 0 THEN concat('n', cast(s_nationkey AS string)) END AS method FROM supp_nodes JOIN supplier ON s_suppkey = id"""
LOWVARS = "SELECT graph_id, concat('s', cast(id AS string)) AS id FROM supp_low"


@query("p8_heap_graph", f"SELECT DISTINCT * FROM ({HEAP})")
def _(s):
    return heap.heap_graph(s.sql(HOLDS), s.sql(FIELDS))


@query("p8_reachable_objects", f"SELECT DISTINCT o.graph_id, o.obj, o.type FROM ({HOLDS}) o WHERE (o.graph_id, o.obj) IN (SELECT (graph_id, id) FROM r)",
       f"hp AS MATERIALIZED ({HEAP}), lv AS MATERIALIZED ({LOWVARS}), " + reach("r", "hp", "lv"))
def _(s):
    h = tables.materialize(heap.heap_graph(s.sql(HOLDS), s.sql(FIELDS)))
    return heap.reachable_objects(h, s.sql(HOLDS), s.sql(LOWVARS))


@query("p16_thread_escape", f"SELECT DISTINCT o.graph_id, o.type FROM ({HOLDS}) o WHERE (o.graph_id, o.obj) IN (SELECT (graph_id, id) FROM r)",
       f"hp AS MATERIALIZED ({HEAP}), lv AS MATERIALIZED ({LOWVARS}), " + reach("r", "hp", "lv"))
def _(s):
    h = tables.materialize(heap.heap_graph(s.sql(HOLDS), s.sql(FIELDS)))
    return heap.thread_escape(h, s.sql(HOLDS), s.sql(LOWVARS))


@query("p14_escapes", f"SELECT graph_id, obj, bool_or((graph_id, pk) IN (SELECT (graph_id, pk) FROM ({POINTERS}) WHERE kind IN ('static', 'return'))) AS escapes FROM ({OBJECTS}) GROUP BY 1, 2")
def _(s):
    return heap.escapes(s.sql(HOLDS), s.sql(POINTERS), s.sql(HOLDS))


REGION_CALLS = """SELECT 'heap' AS graph_id, concat('n', cast(a.n_nationkey AS string)) AS src, concat('n', cast(b.nxt AS string)) AS dst FROM nation a
    JOIN (SELECT n_nationkey, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nxt FROM nation) b ON a.n_nationkey = b.n_nationkey WHERE nxt IS NOT NULL"""
CUSTOMER_CALLS = f"SELECT n.graph_id, c.src, c.dst FROM (SELECT DISTINCT graph_id FROM supp_nodes) n JOIN ({REGION_CALLS}) c ON c.graph_id = 'heap'"
ASKED_OBJECTS = f"SELECT DISTINCT graph_id, obj FROM ({HOLDS}) WHERE type = 'T7'"


@query("p15_may_be_live", """
    SELECT graph_id, obj, NULL AS method FROM al UNION ALL SELECT DISTINCT graph_id, obj, method FROM lv""",
       f"""hp AS MATERIALIZED ({HEAP}), aq AS MATERIALIZED ({ASKED_OBJECTS}), ps AS MATERIALIZED ({POINTERS}), rc AS MATERIALIZED ({REGION_CALLS}),
       hb(graph_id, obj, id) AS (SELECT graph_id, obj, obj FROM aq UNION SELECT h.graph_id, h.obj, e.src FROM hb h JOIN hp e ON e.graph_id = h.graph_id AND e.dst = h.id),
       al AS MATERIALIZED (SELECT DISTINCT h.graph_id, h.obj FROM hb h JOIN ps p ON p.graph_id = h.graph_id AND p.pk = h.id WHERE p.kind = 'static'),
       lv(graph_id, obj, method) AS (SELECT h.graph_id, h.obj, p.method FROM hb h JOIN ps p ON p.graph_id = h.graph_id AND p.pk = h.id
          WHERE p.method IS NOT NULL AND (h.graph_id, h.obj) NOT IN (SELECT (graph_id, obj) FROM al)
          UNION SELECT l.graph_id, l.obj, c.dst FROM lv l JOIN rc c ON c.src = l.method)""")
def _(s):
    h = tables.materialize(heap.heap_graph(s.sql(HOLDS), s.sql(FIELDS)))
    return heap.may_be_live(h, s.sql(POINTERS), s.sql(CUSTOMER_CALLS), s.sql(ASKED_OBJECTS))


# --- mod / ref and dependence --------------------------------------------------------------------------------
ACCESS = """SELECT 'heap' AS graph_id, concat('n', cast(s_nationkey AS string)) AS method, l_orderkey AS stmt, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS kind,
    concat('s', cast(l_suppkey AS string)) AS base, concat('f', cast(l_linenumber AS string)) AS field FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""
FEW = "SELECT DISTINCT graph_id, pk, obj FROM (SELECT 'heap' AS graph_id, concat('s', cast(s_suppkey AS string)) AS pk, concat('k', cast(s_nationkey AS string)) AS obj FROM supplier) x"
TOUCHED = f"""tc AS MATERIALIZED (SELECT DISTINCT a.graph_id, a.method, a.stmt, a.kind, concat(h.obj, '.', a.field) AS loc FROM ({ACCESS}) a JOIN ({FEW}) h ON h.pk = a.base)"""


def _touched(s):
    return tables.materialize(heap.accessed_locations(s.sql(ACCESS), s.sql(FEW)))


@query("p13_mod_ref", "SELECT DISTINCT 'heap' AS graph_id, method, kind, loc FROM m",
       f"{TOUCHED}, rc AS MATERIALIZED ({REGION_CALLS}), m(method, kind, loc) AS (SELECT method, kind, loc FROM tc WHERE loc NOT LIKE '%.f7' UNION SELECT c.src, m.kind, m.loc FROM m JOIN rc c ON c.dst = m.method)")
def _(s):
    t = _touched(s)
    skip = t.filter("loc like '%.f7'").select(G, "loc").distinct()
    return heap.mod_ref(t, s.sql(REGION_CALLS), skip)


# one location per (supplier, line number, part size): a write reaches the reads of the same location
DEPEND = "SELECT 'li' AS graph_id, l_orderkey AS stmt, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS kind, concat(cast(l_suppkey AS string), '.', cast(l_linenumber AS string), '.', cast(l_quantity AS string)) AS loc FROM lineitem"


@query("j2_heap_dependence", """
    SELECT DISTINCT 'li' AS graph_id, w.l_orderkey AS src, r.l_orderkey AS dst FROM lineitem w JOIN lineitem r ON r.l_suppkey = w.l_suppkey AND r.l_linenumber = w.l_linenumber
    AND r.l_quantity = w.l_quantity WHERE w.l_returnflag = 'R' AND r.l_returnflag <> 'R'""")
def _(s):
    return heap.heap_dependence(s.sql(DEPEND))


# writes: orders; a flow of a customer's orders, each order writing the location of its priority
WRITES = "SELECT 'lines' AS graph_id, o_orderkey AS stmt, 'write' AS kind, o_orderpriority AS loc FROM orders"
EXACT = "SELECT 'lines' AS graph_id, o_orderkey AS stmt, o_orderpriority AS loc FROM orders WHERE o_orderstatus = 'F'"


@query("p19_heap_reaching_definitions", "SELECT DISTINCT 'lines' AS graph_id, e.dst AS node, f.stmt, f.loc FROM f JOIN order_flow e ON e.src = f.node",
       f"""wr AS MATERIALIZED ({WRITES}), ex AS MATERIALIZED ({EXACT}), f(node, stmt, loc) AS (SELECT stmt, stmt, loc FROM wr UNION
           SELECT e.dst, f.stmt, f.loc FROM f JOIN order_flow e ON e.src = f.node WHERE (e.dst, f.loc) NOT IN (SELECT (stmt, loc) FROM ex))""")
def _(s):
    return heap.heap_reaching_definitions(s.order_flow, s.sql(WRITES), s.sql(EXACT))


# dependence of suppliers as statements of a customer's flow: those in debt define a variable, their nation, and write the heap of their region;
# rich ones read both; deep debt surely overwrites
USED = "SELECT h.graph_id, h.id AS node, n.key AS target FROM supp_high h JOIN supp_nation n ON n.graph_id = h.graph_id AND n.id = h.id"
STATED = """SELECT l.graph_id, l.id AS stmt, 'write' AS kind, n.region AS loc FROM supp_low l JOIN supp_nation n ON n.graph_id = l.graph_id AND n.id = l.id
            UNION ALL SELECT h.graph_id, h.id, 'read', n.region FROM supp_high h JOIN supp_nation n ON n.graph_id = h.graph_id AND n.id = h.id"""
SURE = f"SELECT t.graph_id, t.stmt, t.loc FROM ({STATED}) t JOIN supplier ON s_suppkey = t.stmt WHERE t.kind = 'write' AND s_acctbal < -500"
DATA = f"""data_dep AS MATERIALIZED (SELECT DISTINCT f.graph_id, f.fact AS src, e.dst FROM f JOIN ed e ON e.graph_id = f.graph_id AND e.src = f.node
    JOIN ({USED}) u ON u.graph_id = f.graph_id AND u.node = e.dst AND u.target = f.target)"""
HEAPDEP = f"""touches AS MATERIALIZED ({STATED}), sure AS MATERIALIZED ({SURE}),
    hf(graph_id, node, stmt, loc) AS (SELECT graph_id, stmt, stmt, loc FROM touches WHERE kind = 'write' UNION SELECT h.graph_id, e.dst, h.stmt, h.loc FROM hf h
        JOIN succ e ON e.graph_id = h.graph_id AND e.src = h.node WHERE (e.graph_id, e.dst, h.loc) NOT IN (SELECT (graph_id, stmt, loc) FROM sure)),
    heap_dep AS MATERIALIZED (SELECT DISTINCT h.graph_id, h.stmt AS src, e.dst FROM hf h JOIN succ e ON e.graph_id = h.graph_id AND e.src = h.node
        JOIN touches t ON t.graph_id = h.graph_id AND t.kind = 'read' AND t.stmt = e.dst AND t.loc = h.loc)"""
CONTROL = ", ".join([reach("r", inverse("succ"), "supp_root"), AVOID.format(edges=inverse("succ")), DOM]) + """, control_dep AS MATERIALIZED (
    SELECT DISTINCT e.graph_id, e.src, d.dominator AS dst FROM succ e JOIN dom d ON d.graph_id = e.graph_id AND d.id = e.dst WHERE (e.graph_id, e.src) IN (SELECT (graph_id, id) FROM r)
      AND (d.dominator = e.src OR (e.graph_id, e.src, d.dominator) NOT IN (SELECT (graph_id, id, dominator) FROM dom)))"""
VALUES = reaching_sql("SELECT graph_id, src, dst FROM succ", DEFINED) + ", " + DATA + ", " + HEAPDEP
BACK = "SELECT graph_id, dst AS src, src AS dst FROM"


def _dependence(s):
    """The derived edge tables, written: data, heap and control."""
    parts = slicing.from_facts(s.succ, s.supp_root, s.sql(DEFINED), s.sql(USED), s.sql(STATED), s.sql(SURE))
    return {k: tables.materialize(v) for k, v in parts.items()}


@query("p18_dependence_graph", """
    SELECT graph_id, src, dst, 'data' AS kind FROM data_dep UNION ALL SELECT graph_id, src, dst, 'heap' FROM heap_dep UNION ALL SELECT graph_id, src, dst, 'control' FROM control_dep""",
       VALUES + ", " + CONTROL)
def _(s):
    return slicing.dependence_graph(_dependence(s)).select(G, "src", "dst", "kind")


@query("p21_thin_slice", "SELECT * FROM sl", f"{VALUES}, vf AS MATERIALIZED ({BACK} data_dep UNION {BACK} heap_dep), " + reach("sl", "vf", "supp_high"))
def _(s):
    parts = _dependence(s)
    return slicing.thin_slice(slicing.dependence_graph(parts), parts["heap"], s.supp_high)


@query("p21_context_insensitive_slice", "SELECT * FROM sl",
       f"{VALUES}, {CONTROL}, vf AS MATERIALIZED ({BACK} data_dep UNION {BACK} heap_dep UNION {BACK} control_dep), " + reach("sl", "vf", "supp_high"))
def _(s):
    parts = _dependence(s)
    return slicing.context_insensitive_slice(slicing.dependence_graph(parts), parts["heap"], s.supp_high)


# context-sensitive slice: reachability through the supergraph along matched calls, from procedure entries
SLICE = """calls AS MATERIALIZED ({calls}), rets AS MATERIALIZED ({rets}), flat AS MATERIALIZED ({flat}),
    pe(graph_id, entry, node, seeded) USING KEY (graph_id, entry, node) AS (SELECT graph_id, id * 10 + {start}, id * 10 + {start}, true FROM supp_root UNION
      SELECT n.* FROM (SELECT graph_id, entry, node, bool_or(seeded) AS seeded FROM (
        SELECT p.graph_id, p.entry, e.dst, p.seeded FROM pe p JOIN flat e ON e.graph_id = p.graph_id AND e.src = p.node
        UNION ALL SELECT p.graph_id, e.dst, e.dst, false FROM pe p JOIN calls e ON e.graph_id = p.graph_id AND e.src = p.node
        UNION ALL SELECT p.graph_id, p.entry, r.dst, p.seeded FROM pe p JOIN calls e ON e.graph_id = p.graph_id AND e.src = p.node
            JOIN recurring.pe x ON x.graph_id = p.graph_id AND x.entry = e.dst JOIN rets r ON r.graph_id = p.graph_id AND r.src = x.node AND r.call = p.node
        UNION ALL SELECT p.graph_id, p.entry, r.dst, p.seeded FROM pe x JOIN calls e ON e.graph_id = x.graph_id AND e.dst = x.entry
            JOIN recurring.pe p ON p.graph_id = x.graph_id AND p.node = e.src JOIN rets r ON r.graph_id = p.graph_id AND r.src = x.node AND r.call = p.node
        UNION ALL SELECT p.graph_id, r.dst, r.dst, true FROM pe p JOIN rets r ON r.graph_id = p.graph_id AND r.src = p.node WHERE p.seeded) z(graph_id, entry, node, seeded) GROUP BY 1, 2, 3) n
      WHERE NOT EXISTS (SELECT 1 FROM recurring.pe o WHERE o.graph_id = n.graph_id AND o.entry = n.entry AND o.node = n.node AND NOT (o.seeded < n.seeded)))"""


FORWARD = SLICE.format(calls="SELECT * FROM super WHERE label = 'call'", rets="SELECT * FROM super WHERE label = 'return'",
                       flat="SELECT * FROM super WHERE label NOT IN ('call', 'return')", start=0)
# backwards, calls are entered at their exits, from return sites, and left at their entries, towards the call
BACKWARD = SLICE.format(calls="SELECT graph_id, dst AS src, src AS dst FROM super WHERE label = 'return'", rets="SELECT graph_id, dst AS src, src AS dst, src + 1 AS call FROM super WHERE label = 'call'",
                        flat="SELECT graph_id, dst AS src, src AS dst FROM super WHERE label NOT IN ('call', 'return')", start=5)


def _sliceable(s):
    kind = F.when(F.col("label") == "call", "param").when(F.col("label") == "return", "return").otherwise("data")
    return tables.materialize(s.super.select(G, "src", "dst", kind.alias("kind"), F.when(F.col("label") == "call", F.col("src")).otherwise(F.col("call")).alias("call")))


@query("p20_forward_slice", "SELECT DISTINCT graph_id, node AS id FROM pe", FORWARD)
def _(s):
    return slicing.forward_slice(_sliceable(s), s.supp_root.select(G, (F.col("id") * 10).alias("id")))


@query("p20_backward_slice", "SELECT DISTINCT graph_id, node AS id FROM pe", BACKWARD)
def _(s):
    return slicing.backward_slice(_sliceable(s), s.supp_root.select(G, (F.col("id") * 10 + 5).alias("id")))

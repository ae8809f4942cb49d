"""Dataflow operators on supplier flow graphs and on the supergraph derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphfacts.operators import dataflow, graph, tabulation
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.queries import query
from graphfacts.queries.classes import CLASSES, TYPES, lowest, up_types

ZERO = -1
GEN = "SELECT graph_id, id AS node, id AS fact FROM supp_low"
# nodes of another region than the fact's supplier, with a high balance, end the fact
KILL = """SELECT h.graph_id, h.id AS node, l.id AS fact FROM supp_high h JOIN supp_low l ON l.graph_id = h.graph_id"""
# an edge into a supplier of the fact's own nation does not carry it
KILL_EDGE = """SELECT e.graph_id, e.src, e.dst, l.id AS fact FROM succ e JOIN supp_nation n ON n.graph_id = e.graph_id AND n.id = e.dst
               JOIN supp_nation m ON m.graph_id = e.graph_id AND m.key = n.key AND m.id <> e.dst JOIN supp_low l ON l.graph_id = m.graph_id AND l.id = m.id"""


def may_sql(edges: str) -> str:
    return f"""gen AS MATERIALIZED ({GEN}), kn AS MATERIALIZED ({KILL}), ke AS MATERIALIZED ({KILL_EDGE}), ed AS MATERIALIZED (SELECT graph_id, src, dst FROM {edges}),
    f(graph_id, node, fact) AS (SELECT * FROM gen UNION SELECT f.graph_id, e.dst, f.fact FROM f JOIN ed e ON e.graph_id = f.graph_id AND e.src = f.node
        WHERE (e.graph_id, e.src, e.dst, f.fact) NOT IN (SELECT (graph_id, src, dst, fact) FROM ke) AND (e.graph_id, e.dst, f.fact) NOT IN (SELECT (graph_id, node, fact) FROM kn))"""


IN = """SELECT DISTINCT f.graph_id, e.dst AS node, f.fact FROM f JOIN ed e ON e.graph_id = f.graph_id AND e.src = f.node
        WHERE (e.graph_id, e.src, e.dst, f.fact) NOT IN (SELECT (graph_id, src, dst, fact) FROM ke)"""


def _parts(s):
    return tables.materialize(s.succ), s.sql(GEN), tables.materialize(s.sql(KILL)), tables.materialize(s.sql(KILL_EDGE))


@query("k1_accumulate", "SELECT * FROM f",
       "f(graph_id, node, fact) AS (SELECT graph_id, id, id FROM supp_low UNION SELECT f.graph_id, e.dst, f.fact FROM f JOIN succ e ON e.graph_id = f.graph_id AND e.src = f.node)")
def _(s):
    return dataflow.accumulate(s.succ, s.sql(GEN))


@query("k2_k3_may_out", "SELECT * FROM f", may_sql("succ"))
def _(s):
    e, gen, kn, ke = _parts(s)
    return dataflow.may(e, gen, kn, ke).out


@query("k2_v2_may_in", IN, may_sql("succ"))
def _(s):
    e, gen, kn, ke = _parts(s)
    return dataflow.may(e, gen, kn, ke).into


# greatest solution by its complement: (node, fact) is lost at the root, over a killing edge, at a killing node
MUST = f"""rc(graph_id, id) AS (SELECT graph_id, id FROM supp_root UNION SELECT r.graph_id, e.dst FROM rc r JOIN succ e ON e.graph_id = r.graph_id AND e.src = r.id),
    inside AS MATERIALIZED (SELECT DISTINCT * FROM rc), gen AS MATERIALIZED (SELECT g.* FROM ({GEN}) g JOIN inside i ON i.graph_id = g.graph_id AND i.id = g.node),
    kn AS MATERIALIZED ({KILL}), ke AS MATERIALIZED ({KILL_EDGE}),
    ed AS MATERIALIZED (SELECT e.graph_id, e.src, e.dst FROM succ e JOIN inside i ON i.graph_id = e.graph_id AND i.id = e.src),
    facts AS MATERIALIZED (SELECT DISTINCT graph_id, fact FROM gen),
    lost(graph_id, node, fact) AS (
        SELECT * FROM (SELECT r.graph_id, r.id AS node, f.fact FROM supp_root r JOIN facts f ON f.graph_id = r.graph_id
        UNION SELECT k.graph_id, k.node, k.fact FROM kn k JOIN inside i ON i.graph_id = k.graph_id AND i.id = k.node
        UNION SELECT k.graph_id, k.dst, k.fact FROM ke k JOIN inside i ON i.graph_id = k.graph_id AND i.id = k.src) z
        WHERE (graph_id, node, fact) NOT IN (SELECT (graph_id, node, fact) FROM gen)
        UNION SELECT l.graph_id, e.dst, l.fact FROM lost l JOIN ed e ON e.graph_id = l.graph_id AND e.src = l.node
        WHERE (l.graph_id, e.dst, l.fact) NOT IN (SELECT (graph_id, node, fact) FROM gen))"""
HELD = "SELECT i.graph_id, i.id AS node, f.fact FROM inside i JOIN facts f ON f.graph_id = i.graph_id WHERE (i.graph_id, i.id, f.fact) NOT IN (SELECT (graph_id, node, fact) FROM lost)"


@query("k2_must_out", HELD, MUST)
def _(s):
    e, gen, kn, ke = _parts(s)
    return dataflow.must(e, gen, s.supp_root, kn, ke).out


@query("k4_boolean_may", """
    SELECT n.graph_id, n.id, (n.graph_id, n.id) IN (SELECT (e.graph_id, e.dst) FROM succ e JOIN f ON f.graph_id = e.graph_id AND f.id = e.src) AS before,
           (n.graph_id, n.id) IN (SELECT (graph_id, id) FROM f) AS after FROM supp_nodes n""",
       """f(graph_id, id) AS (SELECT graph_id, id FROM supp_low UNION SELECT f.graph_id, e.dst FROM f JOIN succ e ON e.graph_id = f.graph_id AND e.src = f.id
          WHERE (e.graph_id, e.dst) NOT IN (SELECT (graph_id, id) FROM supp_high))""")
def _(s):
    settings = s.supp_low.withColumn("value", F.lit(True)).unionByName(s.supp_high.withColumn("value", F.lit(False)))
    return dataflow.boolean(s.supp_nodes, tables.materialize(s.succ), settings, s.supp_root)


@query("k4_boolean_must", """
    SELECT n.graph_id, n.id, (n.graph_id, n.id) NOT IN (SELECT (graph_id, id) FROM supp_root) AND NOT EXISTS (SELECT 1 FROM succ e JOIN f ON f.graph_id = e.graph_id AND f.id = e.src
        WHERE e.graph_id = n.graph_id AND e.dst = n.id AND (e.graph_id, e.src) IN (SELECT (graph_id, id) FROM rc)) AS before,
        (n.graph_id, n.id) NOT IN (SELECT (graph_id, id) FROM f) AS after FROM (SELECT DISTINCT * FROM rc) n""",
       """rc(graph_id, id) AS (SELECT graph_id, id FROM supp_root UNION SELECT r.graph_id, e.dst FROM rc r JOIN succ e ON e.graph_id = r.graph_id AND e.src = r.id),
       f(graph_id, id) AS (SELECT * FROM (SELECT graph_id, id FROM supp_root UNION SELECT graph_id, id FROM supp_high) WHERE (graph_id, id) NOT IN (SELECT (graph_id, id) FROM supp_low)
          UNION SELECT f.graph_id, e.dst FROM f JOIN succ e ON e.graph_id = f.graph_id AND e.src = f.id
          WHERE (e.graph_id, f.id) IN (SELECT (graph_id, id) FROM rc) AND (e.graph_id, e.dst) NOT IN (SELECT (graph_id, id) FROM supp_low))""")
def _(s):
    settings = s.supp_low.withColumn("value", F.lit(True)).unionByName(s.supp_high.withColumn("value", F.lit(False)))
    return dataflow.boolean(s.supp_nodes, tables.materialize(s.succ), settings, s.supp_root, meet="must")


WRITES = "SELECT l.graph_id, l.id AS node, n.key AS target, l.id AS definition FROM supp_low l JOIN supp_nation n ON n.graph_id = l.graph_id AND n.id = l.id"


def reaching_sql(edges: str, defs: str) -> str:
    return f"""d AS MATERIALIZED ({defs}), ed AS MATERIALIZED ({edges}),
    f(graph_id, node, fact, target) AS (SELECT graph_id, node, definition, target FROM d UNION SELECT f.graph_id, e.dst, f.fact, f.target FROM f
        JOIN ed e ON e.graph_id = f.graph_id AND e.src = f.node WHERE (e.graph_id, e.dst, f.target) NOT IN (SELECT (graph_id, node, target) FROM d))"""


@query("k5_reaching_definitions", "SELECT graph_id, node, fact FROM f", reaching_sql("SELECT graph_id, src, dst FROM succ", WRITES))
def _(s):
    return dataflow.reaching_definitions(tables.materialize(s.succ), s.sql(WRITES)).out


@query("k6_interprocedural_definitions", "SELECT graph_id, node, fact FROM f",
       reaching_sql("SELECT graph_id, src, dst FROM super WHERE label <> 'call_to_return'", "SELECT graph_id, node, target, definition FROM defs"))
def _(s):
    sup = tables.materialize(s.super)
    return dataflow.reaching_definitions(sup, s.defs, cut=sup.filter("label = 'call_to_return'")).out


def tabulation_sql(seeds: str = "super_seeds", unbalanced: bool = False, extra: str = "") -> str:
    """Path edges as one keyed recursion; `recurring` is everything found so far."""
    call = "SELECT p.*, e.dst AS callee FROM {p} p JOIN calls e ON e.graph_id = p.graph_id AND e.src = p.node"
    leave = "SELECT p.graph_id, p.entry AS callee, p.d1 AS din, p.d2 AS dout, e.dst AS ret, e.call FROM {p} p JOIN rets e ON e.graph_id = p.graph_id AND e.src = p.node"
    met = ("SELECT c.graph_id, c.entry, c.d1, x.ret, x.dout{s} FROM ({c}) c JOIN ({x}) x ON x.graph_id = c.graph_id AND x.callee = c.callee AND x.din = c.d2 AND x.call = c.node")
    s, s0 = (", c.seeded", ", false") if unbalanced else ("", "")
    names = "graph_id, entry, d1, node, d2" + (", seeded" if unbalanced else "")
    rules = [
        f"""SELECT m.graph_id, m.entry, m.d1, m.dst, m.d2{', m.seeded' if unbalanced else ''} FROM (SELECT p.*, e.dst, e.src AS at_src FROM pe p JOIN inner_ e ON e.graph_id = p.graph_id AND e.src = p.node) m
            LEFT JOIN tgt t ON t.graph_id = m.graph_id AND t.fact = m.d2 LEFT JOIN wr w ON w.graph_id = m.graph_id AND w.src = m.at_src AND w.target = t.target WHERE w.src IS NULL""",
        f"SELECT p.graph_id, p.entry, p.d1, e.dst, g.fact{', p.seeded' if unbalanced else ''} FROM pe p JOIN inner_ e ON e.graph_id = p.graph_id AND e.src = p.node JOIN super_gen g ON g.graph_id = p.graph_id AND g.src = e.src WHERE p.d2 = {ZERO}",
        f"SELECT c.graph_id, c.callee, c.d2, c.callee, c.d2{s0} FROM ({call.format(p='pe')}) c",
        met.format(s=s, c=call.format(p="pe"), x=leave.format(p="recurring.pe")),
        met.format(s=s, c=call.format(p="recurring.pe"), x=leave.format(p="pe")),
    ]
    if unbalanced:
        rules.append("SELECT p.graph_id, e.dst, p.d2, e.dst, p.d2, true FROM pe p JOIN rets e ON e.graph_id = p.graph_id AND e.src = p.node WHERE p.seeded")
    step = " UNION ALL ".join(rules)
    old = "AND NOT (o.seeded < n.seeded)" if unbalanced else ""
    if unbalanced:
        step = f"SELECT graph_id, entry, d1, node, d2, bool_or(seeded) AS seeded FROM ({step}) z(graph_id, entry, d1, node, d2, seeded) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5")
    else:
        step = f"SELECT DISTINCT * FROM ({step}) z(graph_id, entry, d1, node, d2)"
    return f"""inner_ AS MATERIALIZED (SELECT * FROM super WHERE label NOT IN ('call', 'return')), calls AS MATERIALIZED (SELECT * FROM super WHERE label = 'call'),
    rets AS MATERIALIZED (SELECT * FROM super WHERE label = 'return'), tgt AS MATERIALIZED (SELECT graph_id, definition AS fact, target FROM defs),
    wr AS MATERIALIZED (SELECT DISTINCT graph_id, node AS src, target FROM defs), {extra}
    pe({names}) USING KEY (graph_id, entry, d1, node, d2) AS (SELECT graph_id, entry, d1, node, d2{', true' if unbalanced else ''} FROM {seeds} UNION
        SELECT n.* FROM ({step}) n WHERE NOT EXISTS (SELECT 1 FROM recurring.pe o WHERE o.graph_id = n.graph_id AND o.entry = n.entry AND o.d1 = n.d1 AND o.node = n.node AND o.d2 = n.d2 {old}))"""


def _problem(s, seeds, **options):
    """Path edges of reaching definitions on the supergraph, facts shown by their definition."""
    edges, flow = tabulation.redefine(s.super, s.defs)
    fact = lambda c: F.when(F.col(c) == ZERO, tabulation.nothing()).otherwise(
        F.struct(F.col("target").alias("target"), F.col(c).alias("definition")).cast(tabulation.DEFINITION)).alias(c)
    seeds = seeds.join(s.defs.select(G, F.col("definition").alias("d1"), "target"), [G, "d1"], "left").select(G, "entry", fact("d1"), "node", fact("d2"))
    found = tabulation.tabulate(edges, seeds, flow=flow, **options)
    return found, found.df.select(G, "entry", F.col("d1.definition").alias("d1"), "node", F.col("d2.definition").alias("d2"))


@query("k10_path_edges", "SELECT graph_id, entry, d1, node, d2 FROM pe", tabulation_sql())
def _(s):
    return _problem(s, s.super_seeds)[1]


@query("k7_k12_merged_definitions", f"SELECT graph_id, node, min(d2) AS lowest, max(d2) AS highest, count(*) AS n FROM (SELECT DISTINCT graph_id, node, d2 FROM pe WHERE d2 <> {ZERO}) GROUP BY 1, 2", tabulation_sql())
def _(s):
    facts = tabulation.results(_problem(s, s.super_seeds)[1], ZERO)
    facts = facts.select(G, "node", F.col("fact").alias("lowest"), F.col("fact").alias("highest"), F.lit(1).alias("n"))
    return tabulation.merge(facts, [G, "node"], [("lowest", F.min), ("highest", F.max), ("n", F.count)])


MIDWAY = "SELECT l.graph_id, l.id * 10 AS entry, l.id AS d1, l.id * 10 + 4 AS node, l.id AS d2 FROM supp_low l"


@query("k11_k14_unbalanced_summaries", "SELECT graph_id, entry, d1, node AS exit, d2 FROM pe WHERE (graph_id, node) IN (SELECT (graph_id, id * 10 + 5) FROM supp_nodes)",
       tabulation_sql("midway", True, f"midway AS MATERIALIZED ({MIDWAY}),"))
def _(s):
    found = _problem(s, s.sql(MIDWAY), unbalanced=True)[1]
    return tabulation.summaries(found, s.supp_nodes.select(G, (F.col("id") * 10 + 5).alias("id")))


@query("k13_reverse_supergraph", """
    SELECT graph_id, dst AS src, src AS dst, label, call FROM super WHERE label NOT IN ('call', 'return')
    UNION SELECT graph_id, dst, src, 'call', NULL FROM super WHERE label = 'return'
    UNION SELECT c.graph_id, c.dst, c.src, 'return', r.dst FROM super c JOIN super r ON r.graph_id = c.graph_id AND r.label = 'return' AND r.call = c.src WHERE c.label = 'call'""")
def _(s):
    return tabulation.reverse(s.super)


# demand, backwards: rich suppliers' exits read the variable of their nation, the second call of those in debt writes theirs; a variable is demanded
# at a node if a read may follow on a path of matched calls, with no write between
READ_AT = "SELECT h.graph_id, h.id * 10 + 5 AS src, n.key AS fact FROM supp_high h JOIN supp_nation n ON n.graph_id = h.graph_id AND n.id = h.id"
WRITTEN_AT = "SELECT l.graph_id, l.id * 10 + 3 AS src, n.key AS fact FROM supp_low l JOIN supp_nation n ON n.graph_id = l.graph_id AND n.id = l.id"
DEMAND_CALLS = "SELECT p.*, e.dst AS callee FROM {p} p JOIN calls e ON e.graph_id = p.graph_id AND e.src = p.node"
DEMAND_EXITS = "SELECT p.graph_id, p.entry AS callee, p.d1 AS din, p.d2 AS dout, e.dst AS ret, e.call FROM {p} p JOIN rets e ON e.graph_id = p.graph_id AND e.src = p.node"
DEMAND_MET = "SELECT c.graph_id, c.entry, c.d1, x.ret, x.dout FROM ({c}) c JOIN ({x}) x ON x.graph_id = c.graph_id AND x.callee = c.callee AND x.din = c.d2 AND x.call = c.node"
DEMAND = f"""inner_ AS MATERIALIZED (SELECT graph_id, dst AS src, src AS dst FROM super WHERE label NOT IN ('call', 'return')),
    calls AS MATERIALIZED (SELECT DISTINCT graph_id, dst AS src, src AS dst FROM super WHERE label = 'return'),
    rets AS MATERIALIZED (SELECT DISTINCT graph_id, dst AS src, src AS dst, src + 1 AS call FROM super WHERE label = 'call'),
    reads AS MATERIALIZED ({READ_AT}), writes AS MATERIALIZED ({WRITTEN_AT}),
    pe(graph_id, entry, d1, node, d2) USING KEY (graph_id, entry, d1, node, d2) AS (SELECT graph_id, id * 10 + 5, {ZERO}::BIGINT, id * 10 + 5, {ZERO}::BIGINT FROM supp_root UNION
        SELECT n.* FROM (SELECT DISTINCT * FROM (
            SELECT p.graph_id, p.entry, p.d1, e.dst, p.d2 FROM pe p JOIN inner_ e ON e.graph_id = p.graph_id AND e.src = p.node
                LEFT JOIN writes w ON w.graph_id = p.graph_id AND w.src = p.node AND w.fact = p.d2 WHERE w.src IS NULL
            UNION ALL SELECT p.graph_id, p.entry, p.d1, e.dst, g.fact FROM pe p JOIN inner_ e ON e.graph_id = p.graph_id AND e.src = p.node
                JOIN reads g ON g.graph_id = p.graph_id AND g.src = p.node WHERE p.d2 = {ZERO}
            UNION ALL SELECT c.graph_id, c.callee, c.d2, c.callee, c.d2 FROM ({DEMAND_CALLS.format(p='pe')}) c
            UNION ALL {DEMAND_MET.format(c=DEMAND_CALLS.format(p='pe'), x=DEMAND_EXITS.format(p='recurring.pe'))}
            UNION ALL {DEMAND_MET.format(c=DEMAND_CALLS.format(p='recurring.pe'), x=DEMAND_EXITS.format(p='pe'))}) z(graph_id, entry, d1, node, d2)) n
        WHERE NOT EXISTS (SELECT 1 FROM recurring.pe o WHERE o.graph_id = n.graph_id AND o.entry = n.entry AND o.d1 = n.d1 AND o.node = n.node AND o.d2 = n.d2))"""


def _demanded(s):
    zero = F.lit(ZERO).cast("bigint")
    at = (F.col("id") * 10 + 5)
    seeds = s.supp_root.select(G, at.alias("entry"), zero.alias("d1"), at.alias("node"), zero.alias("d2"))
    flow = tabulation.gen_kill(ZERO, tables.materialize(s.sql(READ_AT)), tables.materialize(s.sql(WRITTEN_AT)))
    return tabulation.tabulate(tabulation.reverse(tables.materialize(s.super)), seeds, flow=flow).df


@query("k13_v3_backward_problem", "SELECT graph_id, entry, d1, node, d2 FROM pe", DEMAND)
def _(s):
    return _demanded(s)


# what holds at the entries of procedures, given nothing at the exit where the question began
@query("k14_facts_given", f"SELECT graph_id, node, d2 AS fact FROM pe WHERE (graph_id, entry) IN (SELECT (graph_id, id * 10 + 5) FROM supp_root) AND d1 = {ZERO} AND (graph_id, node) IN (SELECT (graph_id, id * 10) FROM supp_root)", DEMAND)
def _(s):
    asked = s.supp_root.select(G, (F.col("id") * 10 + 5).alias("entry"), F.lit(ZERO).cast("bigint").alias("d1"), (F.col("id") * 10).alias("node"))
    return tabulation.facts_given(_demanded(s), asked).select(G, "node", F.col("d2").alias("fact"))


# the entry of a procedure is no return site, so a seeded problem is not solved in three steps; without seeds it is
@query("k17_bounded_tabulation", "SELECT count(*) = 0 AS complete FROM super_seeds")
def _(s):
    found, paths = _problem(s, s.super_seeds, rounds=3)
    return paths.groupBy().agg(F.lit(found.complete).alias("complete"))


PHI = "SELECT graph_id, src AS result, dst AS operand FROM dag23"
USES = "SELECT n.graph_id, dst AS value, category <> 'PROMO' AS by_phi FROM dag23 JOIN part_nodes n ON n.id = src"


@query("k8_dead_values", "SELECT graph_id, id AS value FROM part_nodes WHERE id NOT IN (SELECT id FROM r)",
       f"r(id) AS (SELECT DISTINCT value FROM ({USES}) WHERE NOT by_phi UNION SELECT p.operand FROM r JOIN ({PHI}) p ON p.result = r.id)")
def _(s):
    return dataflow.dead_values(s.part_nodes.select(G, F.col("id").alias("value")), s.sql(USES), s.sql(PHI))


@query("k9_def_use", """
    SELECT 'li' AS graph_id, p_partkey AS value, p_size AS def_node, l_orderkey AS use_node FROM part LEFT JOIN lineitem ON l_partkey = p_partkey""")
def _(s):
    d = s.part.select(F.lit("li").alias(G), F.col("p_partkey").alias("value"), F.col("p_size").alias("node"))
    return dataflow.def_use(d, s.lineitem.select(F.lit("li").alias(G), F.col("l_partkey").alias("value"), F.col("l_orderkey").alias("node")))


@query("k9_use_counts", "SELECT 'cust' AS graph_id, c_custkey AS value, count(o_orderkey) AS uses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 2")
def _(s):
    d = s.customer.select(F.lit("cust").alias(G), F.col("c_custkey").alias("value"))
    return dataflow.use_counts(d, s.orders.select(F.lit("cust").alias(G), F.col("o_custkey").alias("value")))


# values are customers' orders by priority: defined by finished orders, used by the others
ORDER_FACTS = "SELECT 'lines' AS graph_id, o_orderkey AS node, o_orderpriority AS value, o_orderstatus AS st FROM orders"


@query("k15_live_values", f"""
    SELECT DISTINCT e.graph_id, e.src AS node, l.value FROM order_flow e JOIN l ON l.node = e.dst""",
       f"""fx AS MATERIALIZED ({ORDER_FACTS}), l(node, value) AS (SELECT node, value FROM fx WHERE st = 'P' UNION
           SELECT e.src, l.value FROM l JOIN order_flow e ON e.dst = l.node WHERE (e.src, l.value) NOT IN (SELECT (node, value) FROM fx WHERE st = 'F'))""")
def _(s):
    fx = tables.materialize(s.sql(ORDER_FACTS))
    return dataflow.live_at(s.order_flow, fx.filter("st = 'F'"), fx.filter("st = 'P'"))


VFLOW = "SELECT DISTINCT 'part' AS graph_id, src, dst FROM succ"
KNOWN = "SELECT DISTINCT 'part' AS graph_id, id AS value, concat('P', cast(id AS string)) AS type FROM supp_low"


@query("k16_infer_types", """
    SELECT 'part' AS graph_id, value, max_by(ancestor, depth) AS type FROM (
        SELECT t.value, x.ancestor, count(*) AS n, any_value(d.depth) AS depth, any_value(t.size) AS size
        FROM (SELECT node AS value, fact, count(*) OVER (PARTITION BY node) AS size FROM (SELECT DISTINCT node, fact FROM fl)) t
        JOIN an x ON x.cls = t.fact JOIN (SELECT cls, count(*) AS depth FROM an GROUP BY 1) d ON d.cls = x.ancestor GROUP BY 1, 2)
    WHERE n = size GROUP BY 2""",
       CLASSES + f", fl(node, fact) AS (SELECT value, type FROM ({KNOWN}) UNION SELECT e.dst, f.fact FROM fl f JOIN ({VFLOW}) e ON e.src = f.node)")
def _(s):
    return dataflow.infer_types(s.sql(VFLOW), s.sql(KNOWN), s.extends)


@query("k16_infer_type_sets", "SELECT 'part' AS graph_id, key AS value, ancestor AS type FROM low",
       TYPES + f", fl(node, fact) AS (SELECT value, type FROM ({KNOWN}) UNION SELECT e.dst, f.fact FROM fl f JOIN ({VFLOW}) e ON e.src = f.node), "
       + lowest("SELECT 'part' AS graph_id, node AS key, fact AS member FROM fl"))
def _(s):
    return dataflow.infer_type_sets(s.sql(VFLOW), s.sql(KNOWN), up_types(s))

"""Resource-state operators: event logs, lifecycle of components, policies, and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphfacts.operators import graph, hierarchy, resource
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.queries import query
from graphfacts.queries.classes import CLASSES, TYPES, up_classes, up_types
from graphfacts.queries.graphs import closure, inverse, reach
from graphfacts.streaming.resource_state import closing_mark, resource_state_stream


def values(rows, names: str) -> str:
    text = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {text}) v({names})"


RULES = f"rules AS MATERIALIZED (SELECT * FROM {values(resource.LIFECYCLE, 'kind, src, dst')})"
POLICY = f"policy AS MATERIALIZED (SELECT * FROM {values(resource.POLICY, 'kind, selector, violation, level, needs')})"

# --- instances and metadata --------------------------------------------------------------------------------
FLOWS = "fl(var, lock) AS (SELECT var, obj FROM pt_allocs UNION SELECT a.dst, f.lock FROM fl f JOIN (SELECT src, dst FROM pt_assigns) a ON a.src = f.var)"


@query("l1_resolve_instances", """
    SELECT DISTINCT v.graph_id, v.site AS op, f.lock, f.lock IS NULL AS unresolved FROM pt_virtual v LEFT JOIN fl f ON f.var = v.receiver""", FLOWS)
def _(s):
    return resource.resolve_instances(s.pt_assigns, s.pt_virtual.select(G, F.col("site").alias("op"), F.col("receiver").alias("var")),
                                      s.pt_allocs.select(G, "var", F.col("obj").alias("lock")))


@query("l2_metadata", """
    SELECT l.graph_id, l.lock, CAST(bit_or(l.flags) AS BIGINT) AS flags,
           list_filter(['ACQUIRE_CAUSES_WAKEUP', 'FULL_WAKE_LOCK', 'ON_AFTER_RELEASE', 'PARTIAL_WAKE_LOCK', 'SCREEN_BRIGHT_WAKE_LOCK', 'SCREEN_DIM_WAKE_LOCK', 'UNKNOWN'],
             lambda n, i: (bit_or(l.flags) & [268435456, 26, 536870912, 1, 10, 6, 4294967295][i]) = [268435456, 26, 536870912, 1, 10, 6, 4294967295][i]) AS types,
           CASE WHEN bool_or(c.v) IS NULL THEN 'UNSET' WHEN bool_or(c.v) THEN 'TRUE' ELSE 'FALSE' END AS ref_counted
    FROM log_locks l LEFT JOIN (SELECT user_id, event_type, max_by(value > 90, event_id) AS v FROM events WHERE event_type <> 'click' GROUP BY 1, 2) c
    ON c.user_id = l.graph_id AND c.event_type = l.lock GROUP BY 1, 2""")
def _(s):
    counted = s.events.filter("event_type <> 'click'").select(F.col("user_id").alias(G), F.col("event_type").alias("lock"), F.col("event_id").alias("at"), (F.col("value") > 90).alias("value"))
    return resource.metadata(s.log_locks, counted)


STARTS = FLOWS + """, st AS MATERIALIZED (SELECT DISTINCT v.graph_id, v.site AS op, v.method AS caller, k.cls AS component, k.cls IS NOT NULL AS resolved FROM pt_virtual v
    LEFT JOIN fl f ON f.var = v.receiver LEFT JOIN pt_allocs a ON a.obj = f.lock LEFT JOIN (SELECT cls FROM classes WHERE NOT is_abstract) k ON k.cls = a.type)"""


def _starts(s):
    starts = s.pt_virtual.select(G, F.col("site").alias("op"), F.col("method").alias("caller"), F.col("receiver").alias("var"))
    kinds = s.classes.filter("not is_abstract").select(F.lit("heap").alias(G), "cls")
    return resource.resolve_starts(s.pt_assigns, starts, s.pt_allocs.select(G, "var", F.col("type").alias("cls")), kinds)


@query("l3_resolve_starts", "SELECT * FROM st", STARTS)
def _(s):
    return _starts(s)


@query("l3_start_statistics", """
    SELECT graph_id, count(*) FILTER (ok) AS successfully_resolved_calls, count(*) AS total_calls FROM (SELECT graph_id, op, bool_or(resolved) AS ok FROM st GROUP BY 1, 2) GROUP BY 1""", STARTS)
def _(s):
    return resource.start_statistics(_starts(s))


# --- components ----------------------------------------------------------------------------------------------
NATION_STARTS = """SELECT r.graph_id, r.src AS op, a.key AS caller, b.key AS component, b.key IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AS resolved FROM {0} r
    JOIN supp_nation a ON a.graph_id = r.graph_id AND a.id = r.src JOIN supp_nation b ON b.graph_id = r.graph_id AND b.id = r.dst"""
CONSTRAINT = f"""cn AS MATERIALIZED (SELECT DISTINCT graph_id, caller AS src, component AS dst FROM (({NATION_STARTS.format("succ_open")}) UNION ALL ({NATION_STARTS.format("succ_filled")})) WHERE resolved AND caller <> component)"""


def _constraint(s):
    return tables.materialize(resource.constraint_graph(s.sql(NATION_STARTS.format("succ_open")), s.sql(NATION_STARTS.format("succ_filled"))))


@query("l4_constraint_graph", "SELECT * FROM cn", CONSTRAINT)
def _(s):
    return _constraint(s)


@query("l4_constraint_acyclic", "SELECT n.graph_id, count(c.src) AS cycle_edges, count(c.src) = 0 AS acyclic FROM (SELECT DISTINCT graph_id FROM cn) n LEFT JOIN (SELECT * FROM cn WHERE (graph_id, dst, src) IN (SELECT (graph_id, src, dst) FROM cl)) c ON c.graph_id = n.graph_id GROUP BY 1",
       CONSTRAINT + ", " + closure("cl", "cn"))
def _(s):
    cn = _constraint(s)
    return graph.acyclic(graph.endpoints(cn), cn)


@query("l5_super_components", "SELECT graph_id, id AS cls, min(other) AS super_component FROM w GROUP BY 1, 2",
       """w1 AS MATERIALIZED (SELECT graph_id, src, dst FROM succ WHERE (graph_id, src) IN (SELECT (graph_id, id) FROM supp_rich) AND (graph_id, dst) IN (SELECT (graph_id, id) FROM supp_rich)),
       both_ways AS MATERIALIZED (SELECT * FROM w1 UNION SELECT graph_id, dst, src FROM w1),
       w(graph_id, id, other) AS (SELECT graph_id, id, id FROM supp_rich UNION SELECT w.graph_id, w.id, b.dst FROM w JOIN both_ways b ON b.graph_id = w.graph_id AND b.src = w.other)""")
def _(s):
    rich = tables.materialize(s.supp_rich)
    return resource.super_components(rich.withColumnRenamed("id", "cls"), graph.keep_edges(s.succ, rich))


@query("l6_lifecycle_graph", "SELECT DISTINCT graph_id, component, src, dst FROM p WHERE (component, dst) IN (SELECT (component, selector) FROM callbacks)",
       RULES + """, pr AS MATERIALIZED (SELECT DISTINCT graph_id, component, kind FROM callbacks), cb AS MATERIALIZED (SELECT component, selector FROM callbacks),
       p(graph_id, component, kind, src, dst) AS (SELECT p.graph_id, p.component, p.kind, r.src, r.dst FROM pr p JOIN rules r ON r.kind = p.kind WHERE (p.component, r.src) IN (SELECT (component, selector) FROM cb)
          UNION SELECT p.graph_id, p.component, p.kind, p.src, r.dst FROM p JOIN rules r ON r.kind = p.kind AND r.src = p.dst WHERE (p.component, p.dst) NOT IN (SELECT (component, selector) FROM cb))""")
def _(s):
    return resource.lifecycle_graph(tables.materialize(s.callbacks), resource.lifecycle_rules(s.spark))


def near_sql(forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return RULES + f""", pr AS MATERIALIZED (SELECT DISTINCT graph_id, component, kind FROM callbacks), cb AS MATERIALIZED (SELECT component, selector FROM callbacks),
       nr(graph_id, component, kind, selector, near) AS (SELECT p.graph_id, p.component, p.kind, r.{a}, r.{b} FROM pr p JOIN rules r ON r.kind = p.kind
          UNION SELECT p.graph_id, p.component, p.kind, p.selector, r.{b} FROM nr p JOIN rules r ON r.kind = p.kind AND r.{a} = p.near WHERE (p.component, p.near) NOT IN (SELECT (component, selector) FROM cb))"""


NEAR = "SELECT DISTINCT graph_id, component, selector, near FROM nr WHERE (component, near) IN (SELECT (component, selector) FROM cb)"


@query("l7_next_callbacks", NEAR, near_sql(True))
def _(s):
    return resource.neighbour_callbacks(tables.materialize(s.callbacks), resource.lifecycle_rules(s.spark))


@query("l7_previous_callbacks", NEAR, near_sql(False))
def _(s):
    return resource.neighbour_callbacks(tables.materialize(s.callbacks), resource.lifecycle_rules(s.spark), forward=False)


@query("l8_component_edges", """
    SELECT graph_id, src * 10 + 1 AS src, dst * 10 AS dst, 'call' AS label, CAST(NULL AS BIGINT) AS call FROM succ
    UNION SELECT graph_id, dst * 10 + 5, src * 10 + 2, 'return', src * 10 + 1 FROM succ""")
def _(s):
    starts = s.succ.select(G, (F.col("src") * 10 + 1).alias("block"), F.col("dst").alias("component"))
    after = s.supp_nodes.select(G, (F.col("id") * 10 + 1).alias("block"), F.explode(F.array(
        F.struct((F.col("id") * 10 + 2).alias("ret"), F.lit("normal").alias("label")),
        F.struct((F.col("id") * 10 + 5).alias("ret"), F.lit("exceptional").alias("label")))).alias("e")).select(G, "block", "e.ret", "e.label")
    ends = lambda i: s.supp_nodes.select(G, F.col("id").alias("component"), (F.col("id") * 10 + i).alias("id"))
    return resource.component_edges(starts, after, ends(0), ends(5))


@query("l9_branch_kills", """
    SELECT user_id AS graph_id, event_id AS src, event_id + 1 AS dst, concat('L', CAST(floor(value) AS BIGINT)) AS lock FROM events WHERE event_type = 'view'
    UNION ALL SELECT user_id, event_id, event_id + 2, concat('L', CAST(floor(value) AS BIGINT)) FROM events WHERE event_type = 'error'""")
def _(s):
    t = s.events.select(F.col("user_id").alias(G), F.col("event_id").alias("block"), F.concat(F.lit("L"), F.floor("value")).alias("lock"),
                        F.when(F.col("event_type") == "view", "null_check").when(F.col("event_type") == "error", "is_held").otherwise("other").alias("op"),
                        (F.col("event_id") + 1).alias("when_true"), (F.col("event_id") + 2).alias("when_false"))
    return resource.branch_kills(t)


@query("l10_locked_points", """
    SELECT n.graph_id, n.id, (n.graph_id, n.id) IN (SELECT (e.graph_id, e.dst) FROM succ e JOIN f ON f.graph_id = e.graph_id AND f.id = e.src) AS before,
           (n.graph_id, n.id) IN (SELECT (graph_id, id) FROM f) AS after FROM supp_nodes n""",
       """f(graph_id, id) AS (SELECT graph_id, id FROM supp_low UNION SELECT f.graph_id, e.dst FROM f JOIN succ e ON e.graph_id = f.graph_id AND e.src = f.id
          WHERE (e.graph_id, e.dst) NOT IN (SELECT (graph_id, id) FROM supp_rich))""")
def _(s):
    ops = s.supp_low.select(G, F.col("id").alias("block"), F.lit("acquire").alias("op")).unionByName(
        s.supp_rich.select(G, F.col("id").alias("block"), F.lit("release").alias("op")))
    return resource.locked_points(s.supp_nodes, tables.materialize(s.succ), ops, s.supp_root)


# Path edges of resource states as one keyed recursion: d1 is the entry's fact as text, the rest the fact at the node.
# A release at an edge's source frees a synchronous state, which turns asynchronous unless the releasing component is the
# only acquirer; an asynchronous state keeps what it is and gains the component.
RESOURCE_STATES = """ops AS MATERIALIZED (SELECT graph_id, block, lock, op, ctx FROM lock_ops),
    fl AS MATERIALIZED (SELECT e.graph_id, e.src, e.dst FROM super e WHERE label NOT IN ('call', 'return', 'call_to_return', 'exceptional')),
    rel AS MATERIALIZED (SELECT graph_id, block, lock, ctx AS by_ctx FROM ops WHERE op = 'release'),
    calls AS MATERIALIZED (SELECT graph_id, src, dst FROM super WHERE label = 'call'), rets AS MATERIALIZED (SELECT graph_id, src, dst, call FROM super WHERE label = 'return'),
    pe(graph_id, entry, d1, node, lock, acquired, timed, is_async, contexts, seeded) USING KEY (graph_id, entry, d1, node, lock, acquired, timed, is_async, contexts) AS (
      SELECT graph_id, block - 2, concat_ws('|', lock, true, false, false, ctx), block, lock, true, false, false, [ctx], true FROM ops WHERE op = 'acquire' UNION
      SELECT n.* FROM (SELECT graph_id, entry, d1, node, lock, acquired, timed, is_async, contexts, bool_or(seeded) AS seeded FROM (
        SELECT p.graph_id, p.entry, p.d1, e.dst, p.lock, CASE WHEN r.by_ctx IS NULL OR p.is_async THEN p.acquired ELSE false END, CASE WHEN r.by_ctx IS NULL OR p.is_async THEN p.timed ELSE false END,
               CASE WHEN r.by_ctx IS NULL THEN p.is_async WHEN p.is_async THEN true ELSE p.contexts <> [r.by_ctx] END,
               CASE WHEN r.by_ctx IS NOT NULL AND p.is_async THEN list_sort(list_distinct(list_append(p.contexts, r.by_ctx))) ELSE p.contexts END, p.seeded
        FROM pe p JOIN fl e ON e.graph_id = p.graph_id AND e.src = p.node LEFT JOIN rel r ON r.graph_id = p.graph_id AND r.block = p.node AND r.lock = p.lock
        UNION ALL SELECT p.graph_id, e.dst, {enc_p}, e.dst, p.lock, p.acquired, p.timed, p.is_async, p.contexts, false FROM pe p JOIN calls e ON e.graph_id = p.graph_id AND e.src = p.node
        UNION ALL SELECT p.graph_id, p.entry, p.d1, r.dst, x.lock, x.acquired, x.timed, x.is_async, x.contexts, p.seeded FROM pe p JOIN calls e ON e.graph_id = p.graph_id AND e.src = p.node
            JOIN recurring.pe x ON x.graph_id = p.graph_id AND x.entry = e.dst AND x.d1 = {enc_p} JOIN rets r ON r.graph_id = p.graph_id AND r.src = x.node AND r.call = p.node
        UNION ALL SELECT p.graph_id, p.entry, p.d1, r.dst, x.lock, x.acquired, x.timed, x.is_async, x.contexts, p.seeded FROM pe x JOIN calls e ON e.graph_id = x.graph_id AND e.dst = x.entry
            JOIN recurring.pe p ON p.graph_id = x.graph_id AND p.node = e.src AND x.d1 = {enc_p} JOIN rets r ON r.graph_id = p.graph_id AND r.src = x.node AND r.call = p.node
        UNION ALL SELECT p.graph_id, r.dst, {enc_p}, r.dst, p.lock, p.acquired, p.timed, p.is_async, p.contexts, true FROM pe p JOIN rets r ON r.graph_id = p.graph_id AND r.src = p.node WHERE p.seeded
        ) z(graph_id, entry, d1, node, lock, acquired, timed, is_async, contexts, seeded) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9) n
      WHERE NOT EXISTS (SELECT 1 FROM recurring.pe o WHERE o.graph_id = n.graph_id AND o.entry = n.entry AND o.d1 = n.d1 AND o.node = n.node AND o.lock = n.lock AND o.acquired = n.acquired
          AND o.timed = n.timed AND o.is_async = n.is_async AND o.contexts = n.contexts AND NOT (o.seeded < n.seeded)))""".replace(
    "{enc_p}", "concat_ws('|', p.lock, p.acquired, p.timed, p.is_async, array_to_string(p.contexts, ','))")


@query("l11_resource_states", "SELECT DISTINCT graph_id, node, lock, acquired, timed, is_async, contexts FROM pe", RESOURCE_STATES)
def _(s):
    ops = s.lock_ops.select(G, "block", "lock", "op", F.array("ctx").alias("contexts"))
    entries = s.supp_nodes.select(G, F.col("id").alias("p")).select(G, (F.col("p") * 10 + 2).alias("node"), (F.col("p") * 10).alias("entry"))
    return resource.resource_states(s.super, ops, entries)


STATES = """SELECT user_id AS graph_id, event_type AS lock, value > 95 AS acquired, value < 99 AS timed, value < 1 AS is_async, concat('c', CAST(floor(value / 10) AS BIGINT)) AS ctx FROM events"""
DESCRIBED = """CASE WHEN acquired AND timed THEN concat(m, 'TIMED_ACQUIRED') WHEN acquired THEN concat(m, 'ACQUIRED') WHEN timed THEN 'UNDEFINED' ELSE concat(m, 'RELEASED') END AS state"""


@query("l12_merge_states", f"""
    SELECT graph_id, lock, acquired, timed, is_async, contexts, {DESCRIBED} FROM (
        SELECT *, CASE WHEN is_async THEN 'ASYNC_' ELSE '' END AS m FROM (
            SELECT graph_id, lock, bool_or(acquired) AS acquired, bool_and(timed) AS timed, bool_or(is_async) AS is_async, list_sort(list(DISTINCT ctx)) AS contexts FROM ({STATES}) GROUP BY 1, 2))""")
def _(s):
    return resource.merge_states(s.sql(STATES).withColumn("contexts", F.array("ctx")), [G, "lock"])


EXIT = f"""ex AS MATERIALIZED (SELECT graph_id, component, selector, lock, acquired, timed, is_async, contexts, {DESCRIBED} FROM (
    SELECT *, CASE WHEN is_async THEN 'ASYNC_' ELSE '' END AS m FROM (
        SELECT graph_id, component, selector, lock, bool_or(acquired) AS acquired, bool_and(timed) AS timed, bool_or(is_async) AS is_async, list_sort(list(DISTINCT ctx)) AS contexts
        FROM held GROUP BY 1, 2, 3, 4)))"""


def _at_exit(s):
    held = tables.materialize(s.held)
    node = F.concat("component", F.lit("/"), "selector").alias("node")
    exits = held.select(G, "component", "selector", node).distinct()
    return tables.materialize(resource.exit_states(exits, held.select(G, node, "lock", "acquired", "timed", "is_async", F.array("ctx").alias("contexts"))))


@query("l13_exit_states", "SELECT * FROM ex", EXIT)
def _(s):
    return _at_exit(s)


@query("l14_violations", """
    SELECT DISTINCT w.graph_id, w.component, w.violation, w.level, w.selector, e.lock FROM (
        SELECT p.graph_id, p.component, o.violation, o.level, o.selector, o.selector AS checked FROM pr p JOIN policy o ON o.kind = p.kind WHERE (p.component, o.selector) IN (SELECT (component, selector) FROM cb)
            AND (o.needs IS NULL OR (p.component, o.needs) IN (SELECT (component, selector) FROM cb))
        UNION ALL SELECT p.graph_id, p.component, o.violation, o.level, o.selector, n.near FROM pr p JOIN policy o ON o.kind = p.kind JOIN nr n ON n.component = p.component AND n.selector = o.selector
            WHERE (o.needs IS NULL OR (p.component, o.needs) IN (SELECT (component, selector) FROM cb))
              AND (p.component, o.selector) NOT IN (SELECT (component, selector) FROM cb) AND (n.component, n.near) IN (SELECT (component, selector) FROM cb)) w
    JOIN ex e ON e.component = w.component AND e.selector = w.checked WHERE e.acquired AND list_contains(e.contexts, w.component)""",
       ", ".join([near_sql(False), POLICY, EXIT]))
def _(s):
    callbacks = tables.materialize(s.callbacks)
    before = resource.neighbour_callbacks(callbacks, resource.lifecycle_rules(s.spark), forward=False)
    return resource.violations(_at_exit(s), callbacks, resource.policy_rules(s.spark), before)


@query("l15_warnings", """
    SELECT 1 AS level, c_custkey AS graph_id, 'NO_WAKELOCK_CALLS' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION SELECT 2, o_custkey, 'UNRESOLVED_WAKELOCK_CALLS' FROM orders WHERE o_orderstatus = 'P'
    UNION SELECT 2, o_custkey, 'UNRESOLVED_ASYNC_CALLS' FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 400000""")
def _(s):
    apps = s.customer.select(F.col("c_custkey").alias(G))
    ops = s.orders.select(F.col("o_custkey").alias(G))
    known = s.orders.select(F.col("o_custkey").alias(G), (F.col("o_orderstatus") == "P").alias("unresolved"))
    starts = s.orders.select(F.col("o_custkey").alias(G), F.col("o_orderkey").alias("op"), F.col("o_orderkey").alias("block"), (F.col("o_orderpriority") != "5-LOW").alias("resolved"))
    states = s.orders.select(F.col("o_custkey").alias(G), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") > 400000).alias("acquired"))
    return resource.warnings(apps, ops, known, starts, states)


CALLS = "SELECT DISTINCT graph_id, caller AS src, concat(declared_cls, '.', selector) AS dst FROM sites"
FRAMEWORK = ["P2", "P3", "Brand#4"]


@query("l16_worth_solving", """
    SELECT DISTINCT c.graph_id, c.cls FROM classes c WHERE c.cls IN (SELECT cls FROM an WHERE ancestor IN ('P2', 'P3', 'Brand#4'))
    AND c.cls IN (SELECT cls FROM methods WHERE method IN (SELECT id FROM r))""",
       TYPES + f""", cs AS MATERIALIZED (SELECT graph_id, dst AS src, src AS dst FROM ({CALLS})), tgs AS MATERIALIZED (SELECT DISTINCT graph_id, method AS id FROM methods WHERE is_abstract AND is_private), """ + reach("r", "cs", "tgs"))
def _(s):
    frameworks = s.spark.createDataFrame([(c,) for c in FRAMEWORK], "cls string")
    targets = s.methods.filter("is_abstract and is_private").select(G, "method")
    return resource.worth_solving(s.classes, up_types(s), frameworks, s.sql(CALLS), s.methods.select(G, "cls", "method"), targets)


@query("l17_nodes_leading_to", "SELECT graph_id, id, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY 1, 2",
       f"""r(graph_id, id, hop) AS (SELECT graph_id, id, 0 FROM supp_low UNION SELECT r.graph_id, e.dst, r.hop + 1 FROM r JOIN {inverse('succ')} e ON e.graph_id = r.graph_id AND e.src = r.id WHERE r.hop < 2)""")
def _(s):
    return resource.nodes_leading_to(s.succ, s.supp_low, 2)[0]


@query("l18_released_after", """
    SELECT a.graph_id, a.id AS block, a.lock, coalesce(bool_or(p.ok), false) AS released FROM (SELECT l.graph_id, l.id, n.region AS lock FROM supp_low l JOIN supp_nation n ON n.graph_id = l.graph_id AND n.id = l.id) a
    LEFT JOIN (SELECT q.graph_id, q.id, q.lock, (q.graph_id, q.by, q.id) NOT IN (SELECT (graph_id, d, id) FROM av) AS ok FROM
        (SELECT l.graph_id, l.id, n.region AS lock, h.id AS by FROM supp_low l JOIN supp_nation n ON n.graph_id = l.graph_id AND n.id = l.id
         JOIN (SELECT h.graph_id, h.id, m.region AS lock FROM supp_rich h JOIN supp_nation m ON m.graph_id = h.graph_id AND m.id = h.id) h ON h.graph_id = l.graph_id AND h.lock = n.region
         JOIN rr ON rr.graph_id = l.graph_id AND rr.id = l.id) q) p ON p.graph_id = a.graph_id AND p.id = a.id GROUP BY 1, 2, 3""",
       """rr(graph_id, id) AS (SELECT graph_id, id FROM supp_root UNION SELECT r.graph_id, e.src FROM rr r JOIN succ e ON e.graph_id = r.graph_id AND e.dst = r.id),
       av(graph_id, d, id) AS (SELECT l.graph_id, n.id, l.id FROM supp_root l JOIN supp_nodes n ON n.graph_id = l.graph_id WHERE n.id <> l.id UNION
          SELECT a.graph_id, a.d, e.src FROM av a JOIN succ e ON e.graph_id = a.graph_id AND e.dst = a.id WHERE e.src <> a.d)""")
def _(s):
    lock = s.supp_nation.select(G, "id", F.col("region").alias("lock"))
    op = lambda nodes, name: nodes.join(lock, [G, "id"]).select(G, F.col("id").alias("block"), "lock", F.lit(name).alias("op"))
    ops = tables.materialize(op(s.supp_low, "acquire").unionByName(op(s.supp_rich, "release")))
    return resource.released_after(tables.materialize(s.succ), s.supp_root, ops)


CONDITIONS = """SELECT d.graph_id, d.src, d.dst, concat(n.category, CASE WHEN n.size > 25 THEN '+' ELSE '-' END) AS condition FROM dag23_down d JOIN part_nodes n ON n.id = d.src"""
MINIMAL = "WHERE NOT EXISTS (SELECT 1 FROM cs o WHERE o.call = s.call AND len(o.conditions) < len(s.conditions) AND list_has_all(s.conditions, o.conditions))"


# every part is a call
@query("l19_call_conditions", f"SELECT 'part' AS graph_id, s.call, s.conditions FROM cs s {MINIMAL}",
       f"""cd AS MATERIALIZED ({CONDITIONS}),
       cs(call, conditions) AS (SELECT min(p_partkey), []::VARCHAR[] FROM part UNION
          SELECT c.dst, CASE WHEN c.src IN (SELECT id FROM part_promo) THEN list_sort(list_distinct(list_append(cs.conditions, c.condition))) ELSE cs.conditions END
          FROM cs JOIN cd c ON c.src = cs.call WHERE c.src <> c.dst)""")
def _(s):
    root = s.sql("SELECT 'part' AS graph_id, min(p_partkey) AS id FROM part")
    promo = s.part_promo.select(G, F.col("id").alias("src"))
    return resource.call_conditions(s.part_nodes.select(G, "id"), tables.materialize(s.dag23_down), root, s.part_nodes.select(G, "id"), promo, s.sql(CONDITIONS))


# a call is controlled by the parts of its own type
@query("l19_conditions_by_call", f"SELECT 'part' AS graph_id, s.call, s.conditions FROM cs s {MINIMAL}",
       f"""cd AS MATERIALIZED (SELECT d.*, n.category FROM ({CONDITIONS}) d JOIN part_nodes n ON n.id = d.src),
       w(call, category, cur, conditions) AS (SELECT id, category, id, []::VARCHAR[] FROM part_nodes UNION
          SELECT w.call, w.category, c.src, CASE WHEN c.category = w.category THEN list_sort(list_distinct(list_append(w.conditions, c.condition))) ELSE w.conditions END
          FROM w JOIN cd c ON c.dst = w.cur WHERE c.src <> c.dst),
       cs AS MATERIALIZED (SELECT DISTINCT call, conditions FROM w WHERE cur = (SELECT min(p_partkey) FROM part))""")
def _(s):
    root = s.sql("SELECT 'part' AS graph_id, min(p_partkey) AS id FROM part")
    # blocks that can lie on a way to the call
    above = graph.reachable_from_each(s.dag23, s.part_nodes.select(G, "id")).withColumnRenamed("source", "call")
    kind = s.part_nodes.select(G, "id", "category")
    control = above.join(kind.withColumnRenamed("id", "call"), [G, "call"]).join(
        kind.withColumnRenamed("category", "other"), [G, "id"]).filter("category = other").select(G, "call", F.col("id").alias("src"))
    return resource.call_conditions(s.part_nodes.select(G, "id"), tables.materialize(s.dag23_down), root, s.part_nodes.select(G, "id"), control, s.sql(CONDITIONS))


# --- event logs ----------------------------------------------------------------------------------------------
LOG = """SELECT user_id, event_id, op, coalesce(max(op) OVER (PARTITION BY user_id, grp), 'release') AS cur FROM (
    SELECT user_id, event_id, op, count(op) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM event_ops)"""
STATE = "CASE cur WHEN 'acquire' THEN 'ACQUIRED' WHEN 'timed_acquire' THEN 'TIMED_ACQUIRED' ELSE 'RELEASED' END AS state"


@query("l20_states_in_log", f"SELECT user_id, event_id, {STATE} FROM ({LOG})")
def _(s):
    return resource.states_in_log(s.event_ops, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "state")


@query("l20_open_at_end", """
    SELECT user_id, op, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM event_ops WHERE op IS NOT NULL)
    WHERE rn = 1 AND op IN ('acquire', 'timed_acquire')""")
def _(s):
    return resource.open_at_end(s.event_ops, ["user_id"], ["ts", "event_id"]).select("user_id", "op", "event_id")


@query("r1_resource_state_stream", f"SELECT user_id, event_id, {STATE} FROM ({LOG})")
def _(s):
    spark = s.spark
    out = f"{tables.work_dir(spark)}/graphfacts/{uuid.uuid4().hex}"
    op = F.when(F.col("event_type") == "click", "acquire").when(F.col("event_type") == "signup", "timed_acquire").when(F.col("event_type") == "purchase", "release")
    stream = spark.readStream.schema(s.events.schema).parquet(f"{s.folder}/event[s].parquet").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), op.alias("op"))
    # two runs from one checkpoint: all events, then the mark behind the last one
    marks = closing_mark(s.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "event_id")
    folder = f"{out}/marks"
    marks.limit(0).write.parquet(f"{folder}/none")
    closing = spark.readStream.schema(marks.schema).parquet(f"{folder}/*")
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for run in ("events", "end"):
            if run == "end":
                marks.write.parquet(f"{folder}/end")
            resource_state_stream(stream.unionByName(closing), "0 seconds").writeStream.format("parquet").option("path", f"{out}/rows").option(
                "checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, old)
    return spark.read.schema("user_id long, event_id long, state string").parquet(f"{out}/rows")

"""Graph operators on supplier, part, event and page graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphfacts.operators import dominance, graph, paths, program
from graphfacts.operators.graph import G
from graphfacts.plans import tables
from graphfacts.queries import query


def reach(name: str, edges: str, seeds: str) -> str:
    """Recursive table (graph_id, id) of what the seeds reach."""
    return (f"{name}(graph_id, id) AS (SELECT graph_id, id FROM {seeds} UNION "
            f"SELECT r.graph_id, e.dst FROM {name} r JOIN {edges} e ON e.graph_id = r.graph_id AND e.src = r.id)")


def closure(name: str, edges: str) -> str:
    """Recursive table (graph_id, src, dst): dst is reachable from src by at least one edge."""
    return (f"{name}(graph_id, src, dst) AS (SELECT graph_id, src, dst FROM {edges} UNION "
            f"SELECT r.graph_id, r.src, e.dst FROM {name} r JOIN {edges} e ON e.graph_id = r.graph_id AND e.src = r.dst)")


def inverse(edges: str) -> str:
    return f"(SELECT graph_id, dst AS src, src AS dst FROM {edges})"


def shortest(name: str, edges: str, start: str, cost: str = "1") -> str:
    """Recursive table (graph_id, src, dst, d) of shortest distances, keyed."""
    return f"""{name}(graph_id, src, dst, d) USING KEY (graph_id, src, dst) AS (
        SELECT graph_id, src, dst, min({cost}) FROM {edges} WHERE {start} GROUP BY 1, 2, 3 UNION
        SELECT n.graph_id, n.src, n.dst, n.d FROM (
            SELECT r.graph_id, r.src, e.dst, min(r.d + {cost}) AS d FROM {name} r JOIN {edges} e ON e.graph_id = r.graph_id AND e.src = r.dst GROUP BY 1, 2, 3) n
        LEFT JOIN recurring.{name} o ON o.graph_id = n.graph_id AND o.src = n.src AND o.dst = n.dst WHERE o.d IS NULL OR n.d < o.d)"""


COMPONENTS = ("comp AS (SELECT n.graph_id, n.id, least(n.id, coalesce(min(b.dst), n.id)) AS component FROM supp_nodes n "
              "LEFT JOIN (SELECT a.* FROM cl a JOIN cl z ON a.graph_id = z.graph_id AND a.src = z.dst AND a.dst = z.src) b "
              "ON b.graph_id = n.graph_id AND b.src = n.id GROUP BY 1, 2)")
DAG = ("dag AS (SELECT DISTINCT e.graph_id, a.component AS src, b.component AS dst FROM succ e JOIN comp a ON a.graph_id = e.graph_id AND a.id = e.src "
       "JOIN comp b ON b.graph_id = e.graph_id AND b.id = e.dst WHERE a.component <> b.component)")


@query("a1_g1_g3_flagship", """
    SELECT e.graph_id, n.nodes, e.edges, n.alarmed
    FROM (SELECT r.graph_id, count(*) AS nodes, count(b.id) AS alarmed FROM r LEFT JOIN b ON b.graph_id = r.graph_id AND b.id = r.id GROUP BY 1) n
    JOIN (SELECT e.graph_id, count(*) AS edges FROM succ e JOIN r ON r.graph_id = e.graph_id AND r.id = e.src GROUP BY 1) e ON n.graph_id = e.graph_id""",
       reach("r", "succ", "supp_rich") + ", " + reach("b", inverse("succ"), "supp_low"))
def _(s):
    edges = tables.materialize(s.succ)
    live = tables.materialize(graph.reachable(edges, s.supp_rich))
    alarmed = graph.backward_closure(edges, s.supp_low).withColumn("hit", F.lit(True))
    nodes = live.join(alarmed, [G, "id"], "left").groupBy(G).agg(F.count(F.lit(1)).alias("nodes"), F.count("hit").alias("alarmed"))
    kept = edges.join(live.withColumnRenamed("id", "src"), [G, "src"], "left_semi").groupBy(G).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(kept, G).select(G, "nodes", "edges", "alarmed")


@query("a1_call_graph_statistics", """
    SELECT m.graph_id, coalesce(n.nodes, 0) AS nodes, coalesce(e.edges, 0) AS edges, m.methods, m.bytes
    FROM (SELECT graph_id, count(*) AS methods, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT graph_id, key, max(id) AS b FROM supp_nation GROUP BY 1, 2) GROUP BY 1) m
    LEFT JOIN (SELECT graph_id, count(*) AS nodes FROM r GROUP BY 1) n ON n.graph_id = m.graph_id
    LEFT JOIN (SELECT e.graph_id, count(*) AS edges FROM succ e JOIN r ON r.graph_id = e.graph_id AND r.id = e.src GROUP BY 1) e ON e.graph_id = m.graph_id""",
       reach("r", "succ", "supp_high"))
def _(s):
    nodes = s.supp_nation.select(G, "id", F.col("key").alias("method"), F.col("id").alias("bytes"))
    return program.call_graph_statistics(nodes, s.succ, s.supp_high)


@query("g1_reachable", "SELECT * FROM r", reach("r", "succ", "supp_high"))
def _(s):
    return graph.reachable(s.succ, s.supp_high)


@query("g1_reachable_from_each", "SELECT graph_id, src AS source, dst AS id FROM r",
       """r(graph_id, src, dst) AS (SELECT graph_id, id, id FROM supp_high UNION
          SELECT r.graph_id, r.src, e.dst FROM r JOIN succ e ON e.graph_id = r.graph_id AND e.src = r.dst)""")
def _(s):
    return graph.reachable_from_each(s.succ, s.supp_high)


@query("g2_reachable_filtered", "SELECT * FROM r",
       reach("r", "(SELECT e.* FROM succ e JOIN supp_rich x ON x.graph_id = e.graph_id AND x.id = e.dst)", "supp_high"))
def _(s):
    return graph.reachable(s.succ, s.supp_high, accept=s.supp_rich)


@query("g3_reaches", "SELECT graph_id, dst AS id, src AS target FROM r",
       f"""r(graph_id, src, dst) AS (SELECT graph_id, id, id FROM supp_low UNION
           SELECT r.graph_id, r.src, e.dst FROM r JOIN {inverse('succ')} e ON e.graph_id = r.graph_id AND e.src = r.dst)""")
def _(s):
    return graph.reaches(s.succ, s.supp_low)


@query("g4_within_hops", "SELECT graph_id, id, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY 1, 2",
       """r(graph_id, id, hop) AS (SELECT graph_id, id, 0 FROM supp_high UNION
          SELECT r.graph_id, e.dst, r.hop + 1 FROM r JOIN succ e ON e.graph_id = r.graph_id AND e.src = r.id WHERE r.hop < 4)""")
def _(s):
    return graph.within_hops(s.succ, s.supp_high, 4).select(G, "id", "hop")


FARTHEST = "(SELECT graph_id, max(id) AS id FROM supp_low GROUP BY graph_id)"


@query("g5_shortest_path", """
    SELECT graph_id, CAST(count(*) - 1 AS INTEGER) AS length, bool_and(is_edge) AS valid FROM (
        SELECT n.graph_id, unnest(range(0, n.d + 1)) AS i, true AS is_edge
        FROM (SELECT h.graph_id, min(CASE WHEN h.id = l.id THEN 0 ELSE d END) AS d FROM supp_high h JOIN supp_low l ON l.graph_id = h.graph_id
              LEFT JOIN t ON t.graph_id = h.graph_id AND t.src = h.id AND t.dst = l.id GROUP BY 1) n WHERE n.d IS NOT NULL) GROUP BY 1""",
       shortest("t", "succ", "(graph_id, src) IN (SELECT (graph_id, id) FROM supp_high)"))
def _(s):
    edges = tables.materialize(s.succ)
    p = tables.materialize(paths.shortest_path(edges, s.supp_high, s.supp_low))
    nxt = p.select(G, (F.col("position") - 1).alias("position"), F.col("id").alias("src"))
    hop = p.join(nxt, [G, "position"], "left").select(G, "position", "src", F.col("id").alias("dst"))
    ok = hop.join(edges.withColumn("e", F.lit(True)), [G, "src", "dst"], "left")
    return ok.groupBy(G).agg(F.max("position").alias("length"), F.bool_and(F.col("src").isNull() | F.coalesce("e", F.lit(False))).alias("valid"))


@query("g6_distances", "SELECT graph_id, src, dst, CAST(d AS INTEGER) AS distance FROM t", shortest("t", "succ", "true"))
def _(s):
    return paths.distances(s.succ)


COSTED = "(SELECT graph_id, src, dst, src - dst * 2 + 1 AS cost FROM dag23 WHERE dst <> 0 UNION ALL SELECT graph_id, src, dst, 5 FROM dag23 WHERE dst = 0)"


@query("g6_v6_weighted_distances", "SELECT graph_id, src, dst, d AS distance FROM t", shortest("t", "costed", "src IN (SELECT id FROM part_promo)", "cost").replace("t(", f"costed AS {COSTED}, t(", 1))
def _(s):
    return paths.distances(s.sql(f"SELECT * FROM {COSTED} c"), s.part_promo)


@query("g6_all_shortest_paths", """
    WITH RECURSIVE x AS MATERIALIZED (SELECT * FROM t),
    p(graph_id, src, dst, cur, path) AS (
        SELECT e.graph_id, e.src, l.id, e.dst, CASE WHEN e.dst = l.id THEN [] ELSE [e.dst] END
        FROM succ e JOIN supp_low l ON l.graph_id = e.graph_id JOIN supp_high h ON h.graph_id = e.graph_id AND h.id = e.src
        LEFT JOIN x a ON a.graph_id = e.graph_id AND a.src = e.dst AND a.dst = l.id
        JOIN x b ON b.graph_id = e.graph_id AND b.src = e.src AND b.dst = l.id WHERE b.d = 1 AND e.dst = l.id OR (b.d > 1 AND a.d + 1 = b.d)
        UNION ALL
        SELECT p.graph_id, p.src, p.dst, e.dst, CASE WHEN e.dst = p.dst THEN p.path ELSE list_append(p.path, e.dst) END
        FROM p JOIN succ e ON e.graph_id = p.graph_id AND e.src = p.cur JOIN x b ON b.graph_id = p.graph_id AND b.src = p.cur AND b.dst = p.dst
        LEFT JOIN x a ON a.graph_id = e.graph_id AND a.src = e.dst AND a.dst = p.dst
        WHERE p.cur <> p.dst AND ((b.d = 1 AND e.dst = p.dst) OR (b.d > 1 AND a.d + 1 = b.d)))
    SELECT graph_id, src, dst, path FROM p WHERE cur = dst""", shortest("t", "succ", "true"))
def _(s):
    edges = tables.materialize(s.succ)
    pairs = s.supp_high.select(G, F.col("id").alias("src")).join(s.supp_low.select(G, F.col("id").alias("dst")), G)
    return paths.all_shortest_paths(edges, tables.materialize(paths.distances(edges, s.supp_high)), pairs)


@query("g7_simple_paths", "SELECT graph_id, path FROM p WHERE (graph_id, cur) IN (SELECT (graph_id, id) FROM supp_high)",
       """p(graph_id, cur, path) AS (SELECT graph_id, id, [id] FROM supp_low UNION ALL
           SELECT p.graph_id, e.dst, list_append(p.path, e.dst) FROM p JOIN succ e ON e.graph_id = p.graph_id AND e.src = p.cur
           WHERE NOT list_contains(p.path, e.dst) AND (p.graph_id, p.cur) NOT IN (SELECT (graph_id, id) FROM supp_high))""")
def _(s):
    return paths.simple_paths(s.succ, s.supp_low, s.supp_high)


@query("g7_one_path", "SELECT graph_id, CAST(min(d) + 1 AS INTEGER) AS nodes FROM t WHERE (graph_id, dst) IN (SELECT (graph_id, id) FROM supp_low) GROUP BY 1",
       shortest("t", "succ", "(graph_id, src) IN (SELECT (graph_id, id) FROM supp_root)"))
def _(s):
    targets = s.supp_low
    return paths.one_path(s.succ, s.supp_root, targets).select(G, F.size("path").alias("nodes"))


@query("g8_strong_components", "SELECT * FROM comp", closure("cl", "succ") + ", " + COMPONENTS)
def _(s):
    return graph.strong_components(s.supp_nodes, s.succ)


LINKS_SPARK = "SELECT 'web' AS graph_id, url AS src, explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages"
LINKS = "links AS MATERIALIZED (SELECT 'web' AS graph_id, url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages)"


@query("g9_weak_components", "SELECT graph_id, id, min(other) AS component FROM w GROUP BY 1, 2",
       LINKS + """, both_ways AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT * FROM links UNION ALL SELECT graph_id, dst, src FROM links)),
       ids AS (SELECT DISTINCT src AS id FROM both_ways),
       w(graph_id, id, other) USING KEY (graph_id, id) AS (SELECT 'web', id, id FROM ids UNION
          SELECT n.graph_id, n.id, n.other FROM (SELECT w.graph_id, b.dst AS id, min(w.other) AS other FROM w JOIN both_ways b ON b.src = w.id GROUP BY 1, 2) n
          JOIN recurring.w o ON o.graph_id = n.graph_id AND o.id = n.id WHERE n.other < o.other)""")
def _(s):
    links = tables.materialize(s.sql(LINKS_SPARK))
    return graph.weak_components(graph.endpoints(links), links)


@query("g10_condensation", "SELECT * FROM dag", closure("cl", "succ") + ", " + COMPONENTS + ", " + DAG)
def _(s):
    edges = tables.materialize(s.succ)
    return graph.condensation(tables.materialize(graph.strong_components(s.supp_nodes, edges)), edges)


LEVELS = ", ".join([closure("cl", "succ"), COMPONENTS, DAG,
                    "lv(graph_id, id, level) AS (SELECT DISTINCT graph_id, component, 0 FROM comp UNION "
                    "SELECT d.graph_id, d.dst, l.level + 1 FROM lv l JOIN dag d ON d.graph_id = l.graph_id AND d.src = l.id)"])


@query("g11_topological_levels", "SELECT c.graph_id, c.id, c.component, CAST(max(l.level) AS INTEGER) AS level FROM comp c JOIN lv l ON l.graph_id = c.graph_id AND l.id = c.component GROUP BY 1, 2, 3", LEVELS)
def _(s):
    return graph.topological_levels(s.supp_nodes, tables.materialize(s.succ))


@query("g11_dag_levels", "SELECT 'part' AS graph_id, id, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY 2",
       """lv(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT e.src, l.level + 1 FROM lv l JOIN dag23 e ON e.dst = l.id)""")
def _(s):
    return graph.dag_levels(s.part_nodes, s.dag23_down)


@query("g12_roots", "SELECT n.graph_id, n.id FROM supp_nodes n WHERE (n.graph_id, n.id) NOT IN (SELECT (graph_id, dst) FROM succ)")
def _(s):
    return graph.roots(s.supp_nodes, s.succ)


@query("g12_leaves", "SELECT 'part' AS graph_id, id FROM part_nodes WHERE id NOT IN (SELECT dst FROM heap2)")
def _(s):
    return graph.leaves(s.part_nodes, graph.invert(s.heap2))


@query("g13_invert", "SELECT graph_id, dst AS src, src AS dst FROM succ")
def _(s):
    return graph.invert(s.succ)


@query("g14_prune", "SELECT graph_id, src, dst FROM dag23 WHERE src IN (SELECT id FROM part_nodes WHERE category <> 'SMALL') AND dst IN (SELECT id FROM part_nodes WHERE category <> 'SMALL')")
def _(s):
    return graph.prune(s.part_nodes, s.dag23, F.col("category") != "SMALL")[1]


@query("g15_project", "SELECT DISTINCT graph_id, src, dst FROM p WHERE dst IN (SELECT id FROM part_promo)",
       """p(graph_id, src, dst) AS (SELECT graph_id, src, dst FROM dag23 WHERE src IN (SELECT id FROM part_promo) UNION
          SELECT p.graph_id, p.src, e.dst FROM p JOIN dag23 e ON e.src = p.dst WHERE p.dst NOT IN (SELECT id FROM part_promo))""")
def _(s):
    return graph.project(s.dag23, s.part_promo)


@query("g16_backward_closure", "SELECT * FROM r", reach("r", inverse("succ"), "supp_low"))
def _(s):
    return graph.backward_closure(s.succ, s.supp_low)


@query("g17_contract", "SELECT DISTINCT graph_id, src, dst FROM p WHERE (graph_id, dst) IN (SELECT (graph_id, id) FROM supp_rich)",
       """p(graph_id, src, dst) AS (SELECT graph_id, src, dst FROM succ WHERE (graph_id, src) IN (SELECT (graph_id, id) FROM supp_rich) UNION
          SELECT p.graph_id, p.src, e.dst FROM p JOIN succ e ON e.graph_id = p.graph_id AND e.src = p.dst
          WHERE (p.graph_id, p.dst) NOT IN (SELECT (graph_id, id) FROM supp_rich))""")
def _(s):
    poor = s.supp_nodes.join(s.supp_rich, [G, "id"], "left_anti")
    return graph.contract(s.supp_nodes, s.succ, poor)


@query("g18_acyclic", """
    SELECT n.graph_id, count(e.src) AS cycle_edges, count(e.src) = 0 AS acyclic FROM (SELECT DISTINCT graph_id FROM r) n
    LEFT JOIN (SELECT e.graph_id, e.src FROM succ e JOIN r ON r.graph_id = e.graph_id AND r.id = e.src
               WHERE (e.graph_id, e.dst, e.src) IN (SELECT (graph_id, src, dst) FROM cl)) e ON e.graph_id = n.graph_id GROUP BY 1""",
       reach("r", "succ", "supp_root") + ", " + closure("cl", "succ"))
def _(s):
    return graph.acyclic(s.supp_nodes, tables.materialize(s.succ), s.supp_root)


@query("g18_cycle_edges", "SELECT graph_id, src, dst FROM succ e WHERE (graph_id, dst, src) IN (SELECT (graph_id, src, dst) FROM cl)", closure("cl", "succ"))
def _(s):
    edges = tables.materialize(s.succ)
    return graph.cycle_edges(tables.materialize(graph.strong_components(s.supp_nodes, edges)), edges)


@query("g19_acyclic_paths", "SELECT graph_id, path FROM p WHERE (graph_id, cur) IN (SELECT (graph_id, id) FROM supp_low)",
       closure("cl", "succ") + """, fwd AS MATERIALIZED (SELECT * FROM succ WHERE (graph_id, dst, src) NOT IN (SELECT (graph_id, src, dst) FROM cl)),
       p(graph_id, cur, path) AS (SELECT graph_id, id, [id] FROM supp_nodes WHERE (graph_id, id) NOT IN (SELECT (graph_id, dst) FROM succ) UNION ALL
          SELECT p.graph_id, e.dst, list_append(p.path, e.dst) FROM p JOIN fwd e ON e.graph_id = p.graph_id AND e.src = p.cur
          WHERE (p.graph_id, p.cur) NOT IN (SELECT (graph_id, id) FROM supp_low))""")
def _(s):
    edges = tables.materialize(s.succ)
    return paths.acyclic_paths(s.supp_nodes, edges, graph.roots(s.supp_nodes, edges), s.supp_low)


AVOID = """av(graph_id, d, id) AS (
    SELECT n.graph_id, n.id, r.id FROM supp_nodes n JOIN supp_root r ON r.graph_id = n.graph_id WHERE r.id <> n.id UNION
    SELECT a.graph_id, a.d, e.dst FROM av a JOIN {edges} e ON e.graph_id = a.graph_id AND e.src = a.id WHERE e.dst <> a.d)"""
DOM = ("dom AS MATERIALIZED (SELECT r.graph_id, r.id, n.id AS dominator FROM r JOIN r n ON n.graph_id = r.graph_id "
       "WHERE (r.graph_id, n.id, r.id) NOT IN (SELECT (graph_id, d, id) FROM av))")
DOMINATORS = ", ".join([reach("r", "succ", "supp_root"), AVOID.format(edges="succ"), DOM])
IDOM = ("SELECT a.graph_id, a.id, max_by(a.dominator, c.n) AS idom FROM dom a JOIN (SELECT graph_id, id, count(*) AS n FROM dom GROUP BY 1, 2) c "
        "ON c.graph_id = a.graph_id AND c.id = a.dominator WHERE a.id <> a.dominator GROUP BY 1, 2")


def _tree(s):
    edges = tables.materialize(s.succ)
    return edges, dominance.dominator_tree(edges, s.supp_root)


@query("g20_dominators", "SELECT * FROM dom", DOMINATORS)
def _(s):
    return dominance.dominators(s.succ, s.supp_root)


@query("g20_dominators_layered", "SELECT 'part' AS graph_id, id, d AS dominator FROM c WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.d = c.d AND av.id = c.id)",
       """c(id, d) AS (SELECT src, src FROM dag23 UNION ALL SELECT 0, 0 UNION SELECT c.id, e.dst FROM c JOIN dag23 e ON e.src = c.d),
       av(d, id) AS (SELECT DISTINCT d, 0::BIGINT FROM c WHERE d <> 0 UNION SELECT a.d, e.src FROM av a JOIN dag23 e ON e.dst = a.id WHERE e.src <> a.d)""")
def _(s):
    root = s.sql("SELECT 'part' AS graph_id, min(p_partkey) AS id FROM part")
    return dominance.dominators(s.dag23_down, root)


@query("g20_immediate_dominators", IDOM, DOMINATORS)
def _(s):
    return _tree(s)[1].filter("idom is not null")


@query("g20_dominated_by", "SELECT e.graph_id, e.src AS id, e.dst AS dominator, (e.graph_id, e.src, e.dst) IN (SELECT (graph_id, id, dominator) FROM dom) AS holds FROM succ e", DOMINATORS)
def _(s):
    asked = s.succ.select(G, F.col("src").alias("id"), F.col("dst").alias("dominator"))
    return dominance.dominated_in_tree(_tree(s)[1], asked)


@query("g21_dominance_frontiers", """
    SELECT DISTINCT e.graph_id, d.dominator AS id, e.dst AS frontier FROM succ e JOIN dom d ON d.graph_id = e.graph_id AND d.id = e.src
    WHERE d.dominator = e.dst OR (e.graph_id, e.dst, d.dominator) NOT IN (SELECT (graph_id, id, dominator) FROM dom)""", DOMINATORS)
def _(s):
    return dominance.tree_frontiers(*_tree(s))


@query("g22_post_domination", """
    SELECT q.graph_id, q.id, q.by, bool_and((q.graph_id, q.exit, q.by, q.id) NOT IN (SELECT (graph_id, exit, d, id) FROM av)) AS holds
    FROM (SELECT e.graph_id, e.src AS id, e.dst AS by, r.exit FROM succ e JOIN rr r ON r.graph_id = e.graph_id AND r.id = e.src) q GROUP BY 1, 2, 3""",
       """rr(graph_id, exit, id) AS (SELECT graph_id, id, id FROM supp_low UNION SELECT r.graph_id, r.exit, e.src FROM rr r JOIN succ e ON e.graph_id = r.graph_id AND e.dst = r.id),
       av(graph_id, exit, d, id) AS (SELECT l.graph_id, l.id, n.id, l.id FROM supp_low l JOIN supp_nodes n ON n.graph_id = l.graph_id WHERE n.id <> l.id UNION
          SELECT a.graph_id, a.exit, a.d, e.src FROM av a JOIN succ e ON e.graph_id = a.graph_id AND e.dst = a.id WHERE e.src <> a.d)""")
def _(s):
    edges = tables.materialize(s.succ)
    return dominance.post_dominated(edges, s.supp_low, edges.select(G, F.col("src").alias("id"), F.col("dst").alias("by")))


@query("g23_control_dependence", """
    SELECT DISTINCT e.graph_id, e.src, d.dominator AS dst, e.dst AS label FROM succ e JOIN dom d ON d.graph_id = e.graph_id AND d.id = e.dst
    WHERE (e.graph_id, e.src) IN (SELECT (graph_id, id) FROM r)
      AND (d.dominator = e.src OR (e.graph_id, e.src, d.dominator) NOT IN (SELECT (graph_id, id, dominator) FROM dom))""",
       ", ".join([reach("r", inverse("succ"), "supp_root"), AVOID.format(edges=inverse("succ")), DOM]))
def _(s):
    return dominance.control_dependence(tables.materialize(s.succ), s.supp_root)


# one node of each graph per round, in the order (degree, id): the smallest colour its coloured neighbours leave free
FIRST_FIT = """
    pairs AS MATERIALIZED (SELECT graph_id, src, dst FROM succ UNION SELECT graph_id, dst, src FROM succ),
    ranked AS MATERIALIZED (SELECT n.graph_id, n.id, coalesce(d.degree, 0) AS degree, row_number() OVER (PARTITION BY n.graph_id ORDER BY coalesce(d.degree, 0), n.id) AS rk
        FROM supp_nodes n LEFT JOIN (SELECT graph_id, src AS id, count(*) AS degree FROM pairs GROUP BY 1, 2) d ON d.graph_id = n.graph_id AND d.id = n.id),
    paint(graph_id, id, rk, colour) USING KEY (graph_id, id) AS (
        SELECT graph_id, id, rk, 0::BIGINT FROM ranked WHERE rk = 1
        UNION SELECT n.graph_id, n.id, n.rk, list_min(list_filter(range(0, n.degree + 1), lambda c: NOT list_contains(coalesce(u.used, []), c)))
        FROM paint p JOIN ranked n ON n.graph_id = p.graph_id AND n.rk = p.rk + 1
        LEFT JOIN (SELECT e.graph_id, e.src AS id, list(x.colour) AS used FROM pairs e JOIN recurring.paint x ON x.graph_id = e.graph_id AND x.id = e.dst GROUP BY 1, 2) u
            ON u.graph_id = n.graph_id AND u.id = n.id)"""


@query("g24_colouring", "SELECT graph_id, id, CAST(colour AS INTEGER) AS colour FROM paint", FIRST_FIT)
def _(s):
    return graph.colour(s.supp_nodes, tables.materialize(s.succ))


STEPS = "SELECT graph_id, src, dst, label FROM step_pairs WHERE dst IS NOT NULL"


@query("g25_integrity", f"""
    WITH e AS ({STEPS}), n AS (SELECT graph_id, id FROM supp_rich)
    SELECT graph_id, 'dangling src' AS problem, src, src AS dst, count(*) AS n FROM e WHERE (graph_id, src) NOT IN (SELECT (graph_id, id) FROM n) GROUP BY 1, 3
    UNION ALL SELECT graph_id, 'dangling dst', dst, dst, count(*) FROM e WHERE (graph_id, dst) NOT IN (SELECT (graph_id, id) FROM n) GROUP BY 1, 3
    UNION ALL SELECT graph_id, 'repeated edge', src, dst, count(*) FROM e GROUP BY 1, 3, 4 HAVING count(*) > 1
    UNION ALL SELECT graph_id, 'no predecessor entry', src, dst, 1 FROM (SELECT graph_id, src, dst FROM e EXCEPT SELECT graph_id, src, dst FROM succ)
    UNION ALL SELECT graph_id, 'no successor entry', src, dst, 1 FROM (SELECT graph_id, src, dst FROM succ EXCEPT SELECT graph_id, src, dst FROM e)""")
def _(s):
    return graph.integrity(s.supp_rich, s.sql(STEPS), graph.invert(s.succ))


@query("g26_labelled_degrees", f"SELECT graph_id, src AS id, label, count(DISTINCT dst) AS n FROM ({STEPS}) GROUP BY 1, 2, 3")
def _(s):
    return graph.labelled_degrees(s.sql(STEPS))


@query("g26_edge_labels", f"SELECT graph_id, src, dst, list_sort(list(DISTINCT label)) AS labels FROM ({STEPS}) GROUP BY 1, 2, 3")
def _(s):
    return graph.edge_labels(s.sql(STEPS))


@query("g26_predecessors_by_label", f"SELECT DISTINCT graph_id, dst AS src, src AS dst FROM ({STEPS}) WHERE label = 'F'")
def _(s):
    return graph.predecessors_by_label(s.sql(STEPS), "F")


@query("g27_union_find", "SELECT graph_id, id, min(other) AS component FROM w GROUP BY 1, 2",
       """pr AS MATERIALIZED (SELECT graph_id, src, dst FROM succ UNION SELECT graph_id, dst, src FROM succ),
       w(graph_id, id, other) AS (SELECT DISTINCT graph_id, src, src FROM pr UNION SELECT w.graph_id, w.id, p.dst FROM w JOIN pr p ON p.graph_id = w.graph_id AND p.src = w.other)""")
def _(s):
    return graph.union_find(tables.materialize(s.succ))


@query("g28_normal_flow", """
    SELECT DISTINCT e.graph_id, e.src, e.dst FROM ev e WHERE (graph_id, src) IN (SELECT (graph_id, id) FROM r) AND (graph_id, dst) IN (SELECT (graph_id, id) FROM r)""",
       "ev AS MATERIALIZED (SELECT graph_id, src, dst FROM event_edges WHERE label <> 'error'), heads AS (SELECT graph_id, min(src) AS id FROM event_step GROUP BY 1), "
       + reach("r", "ev", "heads"))
def _(s):
    edges = s.event_edges.withColumn("label", F.when(F.col("label") == "error", "exceptional").otherwise("normal"))
    return graph.normal_flow(edges, s.sql("SELECT graph_id, min(src) AS id FROM event_step GROUP BY graph_id"))


EXITS = "SELECT graph_id, src, dst, CASE WHEN label = 'O' THEN 'exceptional' ELSE 'normal' END AS label, nr AS exception FROM step_pairs WHERE dst IS NOT NULL"
CAUGHT = "SELECT DISTINCT graph_id, l_suppkey AS src, l_linenumber AS exception FROM graph_lines WHERE l_discount > 0.09"


@query("g29_drop_caught_exits", f"""
    SELECT * FROM ({EXITS}) e WHERE NOT (label = 'exceptional' AND (graph_id, dst) IN (SELECT (graph_id, id) FROM supp_low)
        AND (graph_id, src, exception) IN (SELECT (graph_id, src, exception) FROM ({CAUGHT})))""")
def _(s):
    return graph.drop_caught_exits(s.sql(EXITS), s.supp_low, s.sql(CAUGHT))


@query("g30_quotient", """
    SELECT DISTINCT e.graph_id, a.key AS src, b.key AS dst FROM succ e JOIN supp_nation a ON a.graph_id = e.graph_id AND a.id = e.src
    JOIN supp_nation b ON b.graph_id = e.graph_id AND b.id = e.dst""")
def _(s):
    return graph.quotient(s.succ, s.supp_nation)


@query("g31_exploded_flow", """
    SELECT graph_id, id AS src, nxt AS dst FROM (SELECT graph_id, id, lead(id) OVER (PARTITION BY block ORDER BY idx) AS nxt FROM order_lines) WHERE nxt IS NOT NULL
    UNION SELECT f.graph_id, a.id, b.id FROM order_flow f JOIN (SELECT block, max_by(id, idx) AS id FROM order_lines GROUP BY 1) a ON a.block = f.src
    JOIN (SELECT block, min_by(id, idx) AS id FROM order_lines GROUP BY 1) b ON b.block = f.dst""")
def _(s):
    return graph.explode_blocks(s.order_lines, s.order_flow)


@query("w1_predecessor_position", "SELECT graph_id, src, dst, CAST(row_number() OVER (PARTITION BY graph_id, dst ORDER BY src) - 1 AS INTEGER) AS position FROM succ")
def _(s):
    return graph.predecessor_position(s.succ)


@query("a9_degrees", """
    SELECT n.graph_id, n.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM supp_nodes n
    LEFT JOIN (SELECT graph_id, src AS id, count(*) AS n FROM succ GROUP BY 1, 2) o ON o.graph_id = n.graph_id AND o.id = n.id
    LEFT JOIN (SELECT graph_id, dst AS id, count(*) AS n FROM succ GROUP BY 1, 2) i ON i.graph_id = n.graph_id AND i.id = n.id""")
def _(s):
    return graph.degrees(s.supp_nodes, s.succ)


@query("a12_component_composition", """
    SELECT c.graph_id, c.component, count(*) AS nodes, avg(CASE WHEN k.key < 10 THEN 1.0 ELSE 0.0 END) AS share_low, avg(CASE WHEN k.key >= 10 THEN 1.0 ELSE 0.0 END) AS share_high
    FROM comp c JOIN supp_nation k ON k.graph_id = c.graph_id AND k.id = c.id GROUP BY 1, 2""", closure("cl", "succ") + ", " + COMPONENTS)
def _(s):
    kind = s.supp_nation.select(G, "id", F.when(F.col("key") < 10, "low").otherwise("high").alias("category"))
    comp = graph.strong_components(s.supp_nodes, tables.materialize(s.succ))
    return program.component_composition(comp, kind, ["low", "high"])


@query("a11_size_by_root", """
    SELECT 'part' AS graph_id, r.root, count(*) AS instances, CAST(sum(p_size) AS BIGINT) AS bytes, CAST(sum(p_size) AS BIGINT) / count(*) AS mean
    FROM r JOIN part ON p_partkey = r.id GROUP BY 2""",
       "r(root, id) AS (SELECT id, id FROM part_promo UNION SELECT r.root, e.src FROM r JOIN heap2 e ON e.dst = r.id)")
def _(s):
    objects = s.part_nodes.select(G, "id", F.col("size").alias("bytes"))
    return program.size_by_root(graph.invert(s.heap2), objects, s.part_promo)


@query("o3_graph_union", "SELECT graph_id, src, dst FROM succ UNION SELECT graph_id, dst, src FROM succ")
def _(s):
    return graph.union_graphs((s.supp_nodes, s.succ), (s.supp_low, graph.invert(s.succ).select(G, "src", "dst")))[1]


@query("o4_subgraph_check", """
    SELECT graph_id, 'edge' AS kind, src, dst FROM (SELECT graph_id, src, dst FROM succ EXCEPT SELECT graph_id, src, dst FROM succ_open)
    UNION ALL SELECT graph_id, 'node', id, id FROM (SELECT graph_id, id FROM supp_nodes EXCEPT SELECT graph_id, id FROM supp_rich)""")
def _(s):
    return graph.not_subgraph((s.supp_nodes, s.succ), (s.supp_rich, s.succ_open))


@query("v7_paths_over_given_edges", "SELECT graph_id, id, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY 1, 2",
       """r(graph_id, id, hop) AS (SELECT graph_id, id, 0 FROM supp_high UNION
          SELECT r.graph_id, e.dst, r.hop + 1 FROM r JOIN succ e ON e.graph_id = r.graph_id AND e.src = r.id
          WHERE r.hop < 200 AND (e.graph_id, e.dst) NOT IN (SELECT (graph_id, id) FROM supp_low))""")
def _(s):
    allowed = s.succ.join(s.supp_low.withColumnRenamed("id", "dst"), [G, "dst"], "left_anti")
    return graph.within_hops(allowed, s.supp_high, None).select(G, "id", "hop")

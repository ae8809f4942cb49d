"""Graph and program views over the star-schema tables.

Each view is one SELECT that Spark and a second SQL engine read alike; views may use earlier ones. Program
facts (classes, methods, call sites, flow graphs, resource operations) are not among the given tables, so
they are derived from them: parts form a class tree, suppliers are procedures and variables, events are
operations. The derived facts grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


VIEWS: dict[str, str] = {
    # one graph for each customer and order status
    "graph_lines": """
        SELECT o_custkey * 4 + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS graph_id, l.*
        FROM lineitem l JOIN orders ON o_orderkey = l_orderkey""",
    # supplier src is followed by supplier dst within an order (null at its end)
    "step_pairs": """
        SELECT graph_id, l_suppkey AS src, l_linestatus AS label, l_linenumber AS nr,
               lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
        FROM graph_lines""",
    "succ": "SELECT DISTINCT graph_id, src, dst FROM step_pairs WHERE dst IS NOT NULL AND src <> dst",
    # the same by line status: two kinds of edges over one set of nodes
    "succ_open": "SELECT DISTINCT graph_id, src, dst FROM step_pairs WHERE dst IS NOT NULL AND src <> dst AND label = 'O'",
    "succ_filled": "SELECT DISTINCT graph_id, src, dst FROM step_pairs WHERE dst IS NOT NULL AND src <> dst AND label <> 'O'",
    # two call sites per supplier, one for each line status, each with any number of targets
    "call_edges": """SELECT graph_id, src * 10 + 1 AS site, src, dst FROM succ_open
                     UNION ALL SELECT graph_id, src * 10 + 3, src, dst FROM succ_filled""",
    "supp_nodes": "SELECT DISTINCT graph_id, l_suppkey AS id FROM graph_lines",
    "supp_low": """SELECT n.graph_id, n.id FROM supp_nodes n JOIN supplier ON n.id = s_suppkey WHERE s_acctbal < 0""",
    "supp_high": """SELECT n.graph_id, n.id FROM supp_nodes n JOIN supplier ON n.id = s_suppkey WHERE s_acctbal > 9000""",
    "supp_rich": """SELECT n.graph_id, n.id FROM supp_nodes n JOIN supplier ON n.id = s_suppkey WHERE s_acctbal > 3000""",
    "supp_root": "SELECT graph_id, min(id) AS id FROM supp_rich GROUP BY graph_id",
    "supp_nation": """SELECT n.graph_id, n.id, cast(s_nationkey AS bigint) AS key, n_regionkey AS region
                      FROM supp_nodes n JOIN supplier ON n.id = s_suppkey JOIN nation ON n_nationkey = s_nationkey""",
    # part trees and layered graphs, child to parent, root 0
    "heap2": """SELECT 'part' AS graph_id, p_partkey AS src, cast(floor(p_partkey / 2.0) AS bigint) AS dst FROM part WHERE p_partkey > 0""",
    "dag23": """SELECT graph_id, src, dst FROM heap2 UNION
                SELECT 'part' AS graph_id, p_partkey AS src, cast(floor(p_partkey / 3.0) AS bigint) AS dst FROM part WHERE p_partkey > 0""",
    "dag23_down": "SELECT graph_id, dst AS src, src AS dst FROM dag23",
    "part_nodes": "SELECT 'part' AS graph_id, p_partkey AS id, p_type AS category, p_size AS size FROM part",
    "part_promo": "SELECT 'part' AS graph_id, p_partkey AS id FROM part WHERE p_type = 'PROMO'",
    "geo": """SELECT 'geo' AS graph_id, concat('N', cast(n_nationkey AS string)) AS sub, concat('R', cast(n_regionkey AS string)) AS sup FROM nation
              UNION ALL SELECT 'geo', concat('C', cast(c_custkey AS string)), concat('N', cast(c_nationkey AS string)) FROM customer
              UNION ALL SELECT 'geo', concat('S', cast(s_suppkey AS string)), concat('N', cast(s_nationkey AS string)) FROM supplier""",
    "event_step": """SELECT user_id AS graph_id, event_id AS src,
                            lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, event_type AS label FROM events""",
    "event_edges": "SELECT graph_id, src, dst, label FROM event_step WHERE dst IS NOT NULL",
    "event_ops": """SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'acquire' WHEN 'signup' THEN 'timed_acquire'
                           WHEN 'purchase' THEN 'release' END AS op FROM events""",
    # links of pages; flow of instructions: lines of an order form a block, a customer's orders follow each other
    "order_lines": """SELECT 'lines' AS graph_id, l_orderkey AS block, rn AS idx, concat(cast(l_orderkey AS string), ':', cast(rn AS string)) AS id
                      FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) r""",
    "order_flow": """SELECT 'lines' AS graph_id, src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) f
                     WHERE dst IS NOT NULL""",
    # classes and methods: the part tree, brands as interfaces
    "classes": """SELECT 'part' AS graph_id, concat('P', cast(p_partkey AS string)) AS cls,
                         CASE WHEN p_type = 'STANDARD' THEN 'Primordial' ELSE 'Application' END AS loader,
                         false AS is_interface, p_size > 40 AS is_abstract FROM part
                  UNION ALL SELECT DISTINCT 'part', p_brand, 'Application', true, true FROM part""",
    "extends": """SELECT graph_id, concat('P', cast(src AS string)) AS sub, concat('P', cast(dst AS string)) AS sup FROM heap2""",
    "implements": """SELECT 'part' AS graph_id, concat('P', cast(p_partkey AS string)) AS cls, p_brand AS iface FROM part WHERE p_type = 'PROMO'""",
    "methods": """
        SELECT 'part' AS graph_id, concat('P', cast(p_partkey AS string), '.', regexp_extract(p_name, '[a-z]+$', 0)) AS method,
               concat('P', cast(p_partkey AS string)) AS cls, regexp_extract(p_name, '[a-z]+$', 0) AS selector,
               p_size > 40 AS is_abstract, false AS is_constructor, p_size < 6 AS is_static, p_type = 'SMALL' AS is_private,
               p_size > 35 AS is_initialiser, p_size AS bytes FROM part
        UNION ALL
        SELECT 'part', concat('P', cast(p_partkey AS string), '.<init>'), concat('P', cast(p_partkey AS string)), '<init>',
               false, true, false, p_size > 25, false, p_size FROM part WHERE p_type IN ('SMALL', 'LARGE')""",
    # one call per pair of consecutive lines of an order: the first part's method calls the second part's
    "sites": """
        SELECT 'part' AS graph_id, concat(cast(l_orderkey AS string), ':', cast(rn AS string)) AS site,
               concat('P', cast(l_partkey AS string), '.', regexp_extract(a.p_name, '[a-z]+$', 0)) AS caller,
               concat('P', cast(nxt AS string)) AS declared_cls,
               CASE WHEN b.p_type = 'SMALL' THEN '<init>' ELSE regexp_extract(b.p_name, '[a-z]+$', 0) END AS selector
        FROM (SELECT l_orderkey, l_partkey,
                     lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) l
        JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = nxt""",
    # instructions: one per line item, the order's part being the method
    "instructions": """
        SELECT 'part' AS graph_id, concat('P', cast(l_partkey AS string)) AS method,
               row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS idx,
               CASE l_linenumber WHEN 1 THEN 'invoke' WHEN 2 THEN 'getfield' WHEN 3 THEN 'putfield' WHEN 4 THEN 'new'
                                 WHEN 5 THEN 'arraystore' WHEN 6 THEN 'checkcast' ELSE 'catch' END AS kind,
               concat(CASE WHEN l_linestatus = 'F' THEN 'L' ELSE '' END, 's', cast(l_suppkey AS string)) AS operand,
               l_suppkey AS slot FROM lineitem""",
    # supergraph: procedure s has nodes 10 s (entry), +1 call, +2 return site, +3 call, +4 return site, +5 exit
    "super": """
        SELECT graph_id, id * 10 AS src, id * 10 + 1 AS dst, 'normal' AS label, cast(NULL AS bigint) AS call FROM supp_nodes
        UNION ALL SELECT graph_id, id * 10 + 2, id * 10 + 3, 'normal', NULL FROM supp_nodes
        UNION ALL SELECT graph_id, id * 10 + 4, id * 10 + 5, 'normal', NULL FROM supp_nodes
        UNION ALL SELECT DISTINCT c.graph_id, c.site, c.site + 1, 'call_to_return', cast(NULL AS bigint)
            FROM call_edges c JOIN supp_rich r ON r.graph_id = c.graph_id AND r.id = c.src
        UNION ALL SELECT n.graph_id, n.id, n.id + 1, 'call_none_to_return', NULL
            FROM (SELECT graph_id, id * 10 + 1 AS id FROM supp_nodes UNION ALL SELECT graph_id, id * 10 + 3 FROM supp_nodes) n
            LEFT JOIN call_edges c ON c.graph_id = n.graph_id AND c.site = n.id WHERE c.site IS NULL
        UNION ALL SELECT graph_id, site, dst * 10, 'call', NULL FROM call_edges
        UNION ALL SELECT graph_id, dst * 10 + 5, site + 1, 'return', site FROM call_edges""",
    # definitions at procedure entries of low-balance suppliers, one target per nation
    "defs": """SELECT n.graph_id, n.id * 10 AS node, cast(s_nationkey AS bigint) AS target, n.id AS definition
               FROM supp_low n JOIN supplier ON n.id = s_suppkey""",
    "super_gen": "SELECT graph_id, node AS src, definition AS fact FROM defs",
    "super_seeds": "SELECT graph_id, id * 10 AS entry, cast(-1 AS bigint) AS d1, id * 10 AS node, cast(-1 AS bigint) AS d2 FROM supp_high",
    # points-to facts: suppliers are variables, nations are methods
    "pt_allocs": """SELECT 'heap' AS graph_id, concat('n', cast(s_nationkey AS string)) AS method, concat('s', cast(s_suppkey AS string)) AS var,
                           concat('o', cast(s_suppkey AS string)) AS obj, concat('P', cast(s_suppkey AS string)) AS type FROM supplier WHERE s_acctbal < 0""",
    # the return flag of a line says what its step is: an assignment, a load or a store
    "pt_pairs": """SELECT DISTINCT flag, a, b, f FROM (
                       SELECT l_returnflag AS flag, l_suppkey AS a, l_linenumber AS f,
                              lead(l_suppkey) OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b
                       FROM lineitem) p WHERE b IS NOT NULL AND a <> b""",
    "pt_assigns": """SELECT DISTINCT 'heap' AS graph_id, concat('n', cast(s_nationkey AS string)) AS method, concat('s', cast(b AS string)) AS dst,
                            concat('s', cast(a AS string)) AS src, CASE WHEN s_acctbal > 5000 THEN 'P1' END AS cast_type
                     FROM pt_pairs JOIN supplier ON a = s_suppkey WHERE flag = 'R'""",
    "pt_loads": """SELECT 'heap' AS graph_id, concat('s', cast(b AS string)) AS dst, concat('s', cast(a AS string)) AS base, concat('f', cast(f AS string)) AS field
                   FROM pt_pairs WHERE flag = 'A'""",
    "pt_stores": """SELECT 'heap' AS graph_id, concat('s', cast(a AS string)) AS base, concat('f', cast(f AS string)) AS field, concat('s', cast(b AS string)) AS src
                    FROM pt_pairs WHERE flag = 'N'""",
    "pt_direct": """SELECT 'heap' AS graph_id, concat('n', cast(a.n_nationkey AS string)) AS method,
                           concat('d', cast(a.n_nationkey AS string), '_', cast(b.n_nationkey AS string)) AS site, concat('n', cast(b.n_nationkey AS string)) AS target
                    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "pt_virtual": """SELECT 'heap' AS graph_id, concat('n', cast(s_nationkey AS string)) AS method, concat('v', cast(s_suppkey AS string)) AS site,
                            concat('s', cast(s_suppkey AS string)) AS receiver, 'call' AS selector FROM supplier WHERE s_acctbal > 2000""",
    "pt_args": """SELECT 'heap' AS graph_id, concat('v', cast(s_suppkey AS string)) AS site, 1 AS pos, concat('s', cast(s_suppkey AS string)) AS var FROM supplier WHERE s_acctbal > 2000""",
    "pt_results": """SELECT graph_id, site, var FROM pt_args""",
    "pt_params": """SELECT 'heap' AS graph_id, concat('n', cast(n_nationkey AS string)) AS method, 0 AS pos, concat('t', cast(n_nationkey AS string)) AS var FROM nation
                    UNION ALL SELECT 'heap', concat('n', cast(n_nationkey AS string)), 1, concat('p', cast(n_nationkey AS string)) FROM nation""",
    "pt_returns": """SELECT 'heap' AS graph_id, concat('n', cast(n_nationkey AS string)) AS method, concat('p', cast(n_nationkey AS string)) AS var FROM nation""",
    "pt_dispatch": """SELECT 'heap' AS graph_id, concat('P', cast(s_suppkey AS string)) AS type, 'call' AS selector, concat('n', cast(s_nationkey AS string)) AS method FROM supplier""",
    "pt_entries": """SELECT 'heap' AS graph_id, concat('n', cast(min(n_nationkey) AS string)) AS method FROM nation GROUP BY n_regionkey""",
    # programs for contexts, one per region: nations are methods, their suppliers local variables, the last two statements share a static
    "cx_homes": """SELECT concat('r', cast(n_regionkey AS string)) AS graph_id, concat('n', cast(s_nationkey AS string)) AS method, s_suppkey, s_acctbal
                   FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "cx_ends": """SELECT graph_id, method, concat('s', cast(min(s_suppkey) AS string)) AS first_var, concat('s', cast(max(s_suppkey) AS string)) AS last_var
                  FROM cx_homes GROUP BY graph_id, method""",
    "cx_next": """SELECT concat('r', cast(n_regionkey AS string)) AS graph_id, concat('n', cast(n_nationkey AS string)) AS method,
                         concat('n', cast(coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS string)) AS target,
                         n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS is_first, n_nationkey = max(n_nationkey) OVER (PARTITION BY n_regionkey) AS is_last
                  FROM nation""",
    "cx_pairs": """SELECT x.graph_id, x.method, flag, a, b, f, x.s_acctbal FROM pt_pairs JOIN cx_homes x ON x.s_suppkey = a JOIN cx_homes y ON y.s_suppkey = b AND y.method = x.method""",
    "cx_locals": """SELECT graph_id, method, concat('s', cast(s_suppkey AS string)) AS var FROM cx_homes
                    UNION ALL SELECT graph_id, method, concat('p', method) FROM cx_next UNION ALL SELECT graph_id, method, concat('t', method) FROM cx_next""",
    "cx_allocs": """SELECT graph_id, method, concat('s', cast(s_suppkey AS string)) AS var, concat('a', cast(s_suppkey AS string)) AS site,
                           concat('P', cast(s_suppkey AS string)) AS type, s_acctbal < -900 AS is_string, s_acctbal < -800 AS is_throwable, s_acctbal < -750 AS only_primitives
                    FROM cx_homes WHERE s_acctbal < 0""",
    "cx_assigns": """SELECT DISTINCT graph_id, method, concat('s', cast(b AS string)) AS dst, concat('s', cast(a AS string)) AS src,
                            CASE WHEN s_acctbal > 5000 THEN 'P1' END AS cast_type FROM cx_pairs WHERE flag = 'R'
                     UNION ALL SELECT graph_id, method, first_var, concat('p', method), NULL FROM cx_ends
                     UNION ALL SELECT graph_id, method, last_var, concat('t', method), NULL FROM cx_ends
                     UNION ALL SELECT e.graph_id, e.method, concat('g', e.graph_id), first_var, NULL FROM cx_ends e JOIN cx_next n ON n.method = e.method WHERE is_first
                     UNION ALL SELECT e.graph_id, e.method, last_var, concat('g', e.graph_id), NULL FROM cx_ends e JOIN cx_next n ON n.method = e.method WHERE is_last""",
    "cx_loads": "SELECT DISTINCT graph_id, concat('s', cast(b AS string)) AS dst, concat('s', cast(a AS string)) AS base, concat('f', cast(f AS string)) AS field FROM cx_pairs WHERE flag = 'A'",
    "cx_stores": "SELECT DISTINCT graph_id, concat('s', cast(a AS string)) AS base, concat('f', cast(f AS string)) AS field, concat('s', cast(b AS string)) AS src FROM cx_pairs WHERE flag = 'N'",
    "cx_direct": """SELECT n.graph_id, d.method, d.site, d.target FROM pt_direct d JOIN cx_next n ON n.method = d.method""",
    "cx_virtual": """SELECT graph_id, method, concat('v', cast(s_suppkey AS string)) AS site, concat('s', cast(s_suppkey AS string)) AS receiver, 'call' AS selector
                     FROM cx_homes WHERE s_acctbal > 7000""",
    "cx_args": """SELECT graph_id, site, 1 AS pos, receiver AS var FROM cx_virtual
                  UNION ALL SELECT d.graph_id, d.site, 1, e.first_var FROM cx_direct d JOIN cx_ends e ON e.method = d.method""",
    "cx_results": """SELECT graph_id, site, receiver AS var FROM cx_virtual
                     UNION ALL SELECT d.graph_id, d.site, e.last_var FROM cx_direct d JOIN cx_ends e ON e.method = d.method""",
    "cx_params": """SELECT graph_id, method, 0 AS pos, concat('t', method) AS var FROM cx_next UNION ALL SELECT graph_id, method, 1, concat('p', method) FROM cx_next""",
    "cx_returns": "SELECT graph_id, method, last_var AS var FROM cx_ends",
    "cx_dispatch": """SELECT h.graph_id, concat('P', cast(s_suppkey AS string)) AS type, 'call' AS selector, n.target AS method FROM cx_homes h JOIN cx_next n ON n.method = h.method""",
    "cx_entries": "SELECT graph_id, method FROM cx_next WHERE is_first",
    "cx_boxes": "SELECT graph_id, method FROM cx_next WHERE is_last",
    # components: orders, their kind by priority; each line is a callback by its part, and what it holds at its exit
    "component_lines": """
        SELECT concat('O', cast(o_orderkey AS string)) AS component, l_suppkey, l_linestatus, l_discount, l_tax,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Activity' WHEN '2-HIGH' THEN 'Service' WHEN '3-MEDIUM' THEN 'IntentService'
                                    WHEN '5-LOW' THEN 'Application' ELSE 'BroadcastReceiver' END AS kind,
               l_partkey % 8 AS slot
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "component_calls": """
        SELECT component, kind, l_suppkey, l_linestatus, l_discount, l_tax,
               CASE kind
                 WHEN 'Application' THEN CASE WHEN slot < 5 THEN 'onCreate' ELSE 'onTerminate' END
                 WHEN 'Activity' THEN CASE slot WHEN 0 THEN '<init>' WHEN 1 THEN 'onCreate' WHEN 2 THEN 'onStart' WHEN 3 THEN 'onResume' WHEN 4 THEN 'onPause'
                                                WHEN 5 THEN 'onStop' WHEN 6 THEN 'onDestroy' ELSE 'onRestart' END
                 WHEN 'BroadcastReceiver' THEN 'onReceive'
                 ELSE CASE slot WHEN 0 THEN 'onCreate' WHEN 1 THEN 'onBind' WHEN 2 THEN 'onUnbind' WHEN 3 THEN 'onRebind' WHEN 4 THEN 'onDestroy'
                                WHEN 5 THEN 'onStart' WHEN 6 THEN 'onCreate' ELSE CASE WHEN kind = 'IntentService' THEN 'onHandleIntent' ELSE 'onStartCommand' END END
               END AS selector FROM component_lines""",
    "callbacks": "SELECT DISTINCT 'order' AS graph_id, component, kind, selector FROM component_calls",
    "held": """
        SELECT DISTINCT 'order' AS graph_id, component, selector, concat('lock', cast(l_suppkey AS string)) AS lock,
               l_linestatus = 'O' AS acquired, l_discount > 0.08 AS timed, l_tax > 0.06 AS is_async,
               CASE WHEN l_tax > 0.02 THEN component ELSE concat('S', cast(l_suppkey AS string)) END AS ctx
        FROM component_calls""",
    # operations in the supergraph, lock and component by region
    "lock_ops": """
        SELECT n.graph_id, n.id * 10 + 2 AS block, concat('L', cast(n_regionkey AS string)) AS lock,
               CASE WHEN s_acctbal < 0 THEN 'acquire' WHEN s_acctbal > 9500 THEN 'timed_acquire' ELSE 'release' END AS op, concat('N', cast(s_nationkey AS string)) AS ctx
        FROM supp_nodes n JOIN supplier ON n.id = s_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 0 OR s_acctbal > 8000""",
    # signatures and result reports as texts built from the tables
    "signatures": """SELECT p_type AS graph_id, p_partkey AS method, concat('Lcom/', lower(p_type), '/a/', regexp_extract(p_name, '^[a-z]+', 0)) AS cls,
                            p_size > 10 AS is_public,
                            concat('(I[Lcom/', lower(p_type), '/', regexp_extract(p_name, '[a-z]+$', 0), ';Lorg/', lower(p_brand), '/X;',
                                   CASE WHEN p_size > 30 THEN 'I' ELSE '' END, ')Lcom/', regexp_extract(p_name, '^[a-z]+', 0), '/Y;') AS descriptor FROM part""",
    "log_locks": """SELECT user_id AS graph_id, event_type AS lock, cast(floor(value) AS bigint) AS flags FROM events""",
}


def _needs(name: str) -> list[str]:
    """Views used by ``name``, in order of definition, itself last."""
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen:
            return
        seen.add(n)
        for word in set(re.findall(r"\w+", VIEWS[n])):
            if word in VIEWS and word != n:
                visit(word)

    visit(name)
    return [v for v in VIEWS if v in seen]


def with_views(body: str, recursive: str = "") -> str:
    """Oracle text: ``body`` (and an optional recursive table) over the views it mentions."""
    used: list[str] = []
    for word in re.findall(r"\w+", recursive + " " + body):
        if word in VIEWS:
            used += [v for v in _needs(word) if v not in used]
    used.sort(key=list(VIEWS).index)
    own = re.match(r"\s*WITH (?:RECURSIVE )?", body)
    if own:
        recursive, body = (recursive + ", " if recursive else "") + body[own.end():], ""
    parts = [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in used]
    if recursive:
        parts.append(recursive)
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


class Source:
    """The tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        """A SELECT over tables and views."""
        words = set(re.findall(r"\w+", body))
        used = [v for v in VIEWS if any(v in _needs(w) for w in words if w in VIEWS)]
        text = " ".join(VIEWS[v] for v in used) + " " + body
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                self.table(t).createOrReplaceTempView(t)
        parts = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
        return self.spark.sql((f"WITH {parts}\n" if parts else "") + body)

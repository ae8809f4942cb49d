"""Scans, selections, joins, aggregates, sets and scalar functions over the given tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from graphfacts.functions import names, scalars
from graphfacts.operators import hierarchy, program, relational
from graphfacts.plans import tables
from graphfacts.queries import query
from graphfacts.sources import results, text

# --- sources and sinks ------------------------------------------------------------------------------
LINES = "concat('  ', p_name, '   ', p_brand, ' ', cast(p_size AS string))"


@query("s1_delimited_cells", """
    SELECT p_partkey AS id, c[1] AS c1, c[2] AS c2, c[3] AS c3, c[4] AS c4, CAST(len(c) AS INTEGER) AS width
    FROM (SELECT p_partkey, regexp_split_to_array(trim(concat('  ', p_name, '   ', p_brand, ' ', cast(p_size AS varchar))), '\\s+') AS c FROM part)""")
def _(s):
    lines = s.part.select(F.col("p_partkey").alias("id"), F.expr(LINES).alias("value"))
    c = text.parse_cells(lines, "value")
    return c.select("id", *[F.element_at("cells", i).alias(f"c{i}") for i in (1, 2, 3, 4)], F.size("cells").alias("width"))


@query("s1_text_table_file", "SELECT 's' || s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS nation, '#' || s_name AS label FROM supplier")
def _(s):
    rows = s.supplier.select(F.concat(F.lit("s"), "s_suppkey", F.lit("   "), "s_nationkey", F.lit("  #"), "s_name").alias("value"))
    head = s.spark.createDataFrame([("# produced from suppliers",), ("",), ("id nation   label",)], "value string")
    path = f"{tables.work_dir(s.spark)}/{uuid.uuid4().hex}"
    head.coalesce(1).write.text(f"{path}/part=0")
    rows.write.text(f"{path}/part=1")
    return text.read_table(s.spark, path).select("id", "nation", "label")


@query("s2_add_remove_rows", """
    SELECT r_regionkey AS k, r_name AS name FROM region WHERE NOT (r_regionkey = 1 AND r_name = 'AMERICA')
    UNION ALL SELECT n_nationkey, n_name FROM nation""")
def _(s):
    t = s.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    t = relational.add_rows(t, s.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    return relational.remove_rows(t, s.region.filter("r_name = 'AMERICA'").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


# one report per customer: every order is a component, its priority the violation tag
def _reports(s):
    per_order = s.orders.groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.concat(F.lit("comp"), "o_orderkey"), F.array(F.create_map("o_orderpriority", "o_orderstatus"))))).alias("v"),
        F.collect_list(F.when(F.col("o_orderstatus") == "P", F.lit("PENDING"))).alias("w"),
        F.count_if(F.col("o_orderstatus") == "F").alias("ok"), F.count(F.lit(1)).alias("n"))
    calls = F.struct(F.col("ok").alias("successfully_resolved_calls"), F.col("n").alias("total_calls"))
    app = F.struct(
        F.lit("1").alias("version"), F.coalesce("v", F.create_map().cast("map<string,array<map<string,string>>>")).alias("Violation Report"),
        F.coalesce("w", F.array().cast("array<string>")).alias("Warning Report"), calls.alias("Intent"), calls.alias("Runnable"),
        F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit("m1.5s")).alias("elapsed"))
    return s.customer.join(per_order, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("app"), "c_custkey").alias("graph_id"), app.alias("app"))


def _report_texts(s):
    return _reports(s).select(F.to_json(F.create_map("graph_id", "app")).alias("value"))


@query("s3_s4_result_files", "SELECT 'app' || c_custkey AS graph_id, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS INTEGER) AS components FROM customer")
def _(s):
    path = f"{tables.work_dir(s.spark)}/{uuid.uuid4().hex}"
    results.write_results(_reports(s), f"{path}/run0_results")
    back = s.spark.read.text(f"{path}/run0_results")
    return results.parse_results(back).select("graph_id", F.size("app.`Violation Report`").alias("components"))


@query("s5_manifest", "SELECT o_orderkey AS id, o_orderpriority AS part FROM orders WHERE o_orderpriority LIKE '%U%'")
def _(s):
    manifest = s.orders.filter("o_orderpriority like '%U%'").select(F.col("o_orderpriority").alias("path"), F.lit("Application").alias("loader")).distinct()
    return text.in_manifest(s.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("part")), "part", manifest, "Application")


@query("s6_exclusions", "SELECT p_partkey AS id, p_name AS name FROM part WHERE NOT regexp_full_match(p_name, 'small .*|.* (ring|rod)')")
def _(s):
    return text.exclude(s.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "name", ["small .*", ".* (ring|rod)"])


@query("s7_target_list", "SELECT method, cls FROM methods WHERE method IN (SELECT caller FROM sites)")
def _(s):
    targets = s.sites.select(F.col("caller").alias("signature")).distinct()
    return text.of_targets(s.methods.select("method", "cls"), "method", targets)


@query("s8_graph_lines", "SELECT graph_id, concat('\"', src, '\" -> \"', dst, '\" [label=\"', label, '\"]') AS value FROM event_edges")
def _(s):
    return results.graph_lines(s.event_edges)


@query("s9_model_facts", """
    SELECT method, idx, kind FROM instructions WHERE method NOT IN (SELECT concat('P', p_partkey) FROM part WHERE p_type = 'PROMO')
    UNION ALL SELECT concat('P', p_partkey), 1, 'invoke' FROM part WHERE p_type = 'PROMO'""")
def _(s):
    model = s.sql("SELECT 'part' AS graph_id, concat('P', cast(p_partkey AS string)) AS method, 1 AS idx, 'invoke' AS kind FROM part WHERE p_type = 'PROMO'")
    return program.replace_with_models(s.instructions.select("graph_id", "method", "idx", "kind"), model).select(
        "method", F.col("idx").cast("long").alias("idx"), "kind")


# --- selections --------------------------------------------------------------------------------------
@query("f1_where_equals", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(s):
    return relational.where_equals(s.customer, "c_mktsegment", "BUILDING")


@query("f2_select_where_equals", "SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(s):
    return relational.select_where_equals(s.customer, "c_nationkey", "c_mktsegment", "BUILDING")


@query("f3_where_predicate", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
def _(s):
    return relational.where(s.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice")


def _sounds_right(texts: pd.Series) -> pd.Series:
    return texts.str.contains("ing", regex=False) | texts.str.startswith("h")


@query("f3_v1_user_predicate", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ing') OR starts_with(p_name, 'h')")
def _(s):
    return relational.where(s.part.select("p_partkey", "p_name"), F.pandas_udf(_sounds_right, "boolean")("p_name"))


@query("f4_view", "SELECT n_name, count(*) AS n FROM nation WHERE n_regionkey = 2 GROUP BY n_name")
def _(s):
    relational.view_where_equals(s.nation, "n_regionkey", 2, "asian_nations")
    return s.spark.sql("SELECT n_name, count(*) AS n FROM asian_nations GROUP BY n_name")


@query("f5_predicate_algebra", "SELECT s_suppkey FROM supplier WHERE (NOT (s_acctbal < 0) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) OR s_acctbal > 9000")
def _(s):
    nations = s.nation.filter("n_regionkey = 1")
    inside = relational.element_of(s.supplier, "s_nationkey", nations, "n_nationkey")
    kept = relational.where(inside, relational.negation(F.col("s_acctbal") < 0)).select("s_suppkey")
    rich = relational.where(s.supplier, relational.disjunction(F.col("s_acctbal") > 9000, F.lit(False))).select("s_suppkey")
    return relational.union_sets(kept, rich)


@query("f6_map_to_set", "SELECT DISTINCT upper(p_name) AS name FROM part")
def _(s):
    return relational.map_rows(s.part, F.upper("p_name"), "name", as_set=True)


@query("f7_quantifiers", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS for_some, bool_and(o_orderstatus = 'F') AS for_all FROM orders GROUP BY o_custkey")
def _(s):
    return relational.quantify(s.orders, ["o_custkey"], F.col("o_orderstatus") == "F")


@query("f7_find", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderdate, o_orderkey LIMIT 1")
def _(s):
    return relational.find(s.orders, F.col("o_totalprice") > 400000, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderdate")


@query("f8_concatenate", "SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def _(s):
    return relational.concatenate(
        s.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")),
        s.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")))


# --- joins -------------------------------------------------------------------------------------------
def _orders_of(s):
    return s.orders.select(F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("y"))


def _lines_of(s):
    return s.lineitem.select(F.col("l_orderkey").alias("x"), F.col("l_suppkey").alias("y"))


@query("j1_compose", "SELECT DISTINCT o_custkey AS x, l_suppkey AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(s):
    return relational.compose(_orders_of(s), _lines_of(s))


@query("j1_related", "SELECT o_custkey AS x, o_orderkey AS y FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(s):
    return relational.related(_orders_of(s), s.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("x")))


@query("j1_related_count", "SELECT l_orderkey AS x, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def _(s):
    return relational.related_count(_lines_of(s))


@query("j1_unrelate", "SELECT o_custkey AS x, o_orderkey AS y FROM orders WHERE o_orderstatus <> 'F'")
def _(s):
    gone = s.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("y"))
    return relational.unrelate(_orders_of(s), gone)


@query("j5_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s):
    return relational.difference(s.customer.select("c_custkey"), s.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j6_intersecting", "SELECT DISTINCT l_orderkey AS owner FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(s):
    members = s.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_suppkey").alias("member"))
    return relational.intersecting(members, s.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("member")))


# --- aggregates --------------------------------------------------------------------------------------
@query("a2_parameter_counts", """
    SELECT m.graph_id, m.classes, m.methods, p.parameters, p.parameters / m.methods AS mean
    FROM (SELECT graph_id, count(DISTINCT cls) AS classes, count(DISTINCT method) AS methods FROM methods GROUP BY 1) m
    JOIN (SELECT graph_id, count(*) AS parameters FROM instructions GROUP BY 1) p ON m.graph_id = p.graph_id""")
def _(s):
    return program.parameter_statistics(s.methods, s.instructions)


FIELDS = "SELECT graph_id, method, operand AS field FROM instructions WHERE kind = 'getfield'"


@query("a3_fields_read", f"SELECT DISTINCT * FROM ({FIELDS})")
def _(s):
    return program.fields_read(s.sql(FIELDS))


@query("a3_mean_fields_read", f"""
    SELECT m.graph_id, avg(coalesce(f.n, 0)) AS mean FROM (SELECT DISTINCT graph_id, cls AS method FROM methods) m
    LEFT JOIN (SELECT method, count(DISTINCT field) AS n FROM ({FIELDS}) GROUP BY 1) f ON m.method = f.method GROUP BY 1""")
def _(s):
    m = s.methods.select("graph_id", F.col("cls").alias("method"))
    return program.mean_fields_read(program.fields_read_counts(m, s.sql(FIELDS)))


@query("a4_interface_usage", r"""
    SELECT graph_id, type, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS methods,
           count(*) FILTER (pub) AS public_methods, count(*) FILTER (far) AS foreign_methods
    FROM (SELECT graph_id, method, type, count(*) AS n, bool_or(is_public) AS pub,
                 bool_or(is_public AND NOT regexp_full_match(type, '[BCDFIJSVZ]')
                         AND regexp_extract(type, '^L?((?:[^/;]+/){0,2})', 1) <> regexp_extract(cls, '^L?((?:[^/;]+/){0,2})', 1)) AS far
          FROM (SELECT graph_id, method, cls, is_public, rtrim(regexp_replace(t, '^\[+', ''), ';') AS type
                FROM (SELECT graph_id, method, cls, is_public, unnest(regexp_extract_all(descriptor, '\[*(?:[BCDFIJSVZ]|L[^;]+;)')) AS t FROM signatures)) u0
          GROUP BY graph_id, method, type) u
    GROUP BY 1, 2""")
def _(s):
    sig = s.signatures.withColumn("types", F.concat(names.parameter_types(F.col("descriptor")), F.array(names.return_type(F.col("descriptor")))))
    return program.interface_usage(sig)


@query("a5_instruction_histogram", """
    SELECT graph_id, method, count(*) FILTER (kind = 'invoke') AS invoke, count(*) FILTER (kind = 'new') AS "new",
           count(*) FILTER (kind = 'catch') AS "catch" FROM instructions GROUP BY 1, 2""")
def _(s):
    return program.instruction_histogram(s.instructions, ["invoke", "new", "catch"])


@query("a5_instruction_histogram_long", "SELECT graph_id, method, kind, count(*) AS n FROM instructions GROUP BY 1, 2, 3")
def _(s):
    return program.instruction_histogram(s.instructions)


@query("a6_restricted_creation", """
    SELECT graph_id, cls FROM methods GROUP BY graph_id, cls
    HAVING bool_and(is_private) FILTER (is_constructor) AND bool_or(is_initialiser)
       AND cls NOT IN (SELECT declared_cls FROM sites WHERE selector = '<init>' AND caller IN (SELECT method FROM methods WHERE NOT is_initialiser))""")
def _(s):
    made = s.sites.filter("selector = '<init>'").select("graph_id", F.col("caller").alias("method"), F.col("declared_cls").alias("cls"))
    return program.restricted_creation(s.methods, made)


@query("a7_class_references", "SELECT graph_id, site, declared_cls AS cls FROM sites WHERE declared_cls IN (SELECT cls FROM implements)")
def _(s):
    refs = s.sites.select("graph_id", "site", F.col("declared_cls").alias("cls"))
    return program.class_references(refs, s.implements).select("graph_id", "site", "cls")


@query("a8_fleet_histogram", """
    WITH o AS (SELECT o_custkey AS app, o_orderpriority AS tag, o_orderstatus AS st FROM orders),
         total AS (SELECT count(*) AS t FROM customer),
         rows AS (SELECT 'violation' AS kind, tag, count(DISTINCT app) AS n FROM o GROUP BY tag
                  UNION ALL SELECT 'warning', 'PENDING', count(*) FROM o WHERE st = 'P'
                  UNION ALL SELECT 'status', CASE WHEN c_custkey IN (SELECT app FROM o) THEN 'failed' ELSE 'verified' END, count(*) FROM customer GROUP BY 2)
    SELECT kind, tag, n, round(n * 100 / t, 4) AS percent FROM rows, total""")
def _(s):
    return results.histogram(results.parse_results(_report_texts(s)))


@query("a8_resolution", """
    SELECT count(*) FILTER (o_orderstatus = 'F') AS resolved_intents, count(*) AS total_intents,
           count(*) FILTER (o_orderstatus = 'F') AS resolved_runnables, count(*) AS total_runnables,
           count(*) * 60 + (SELECT count(*) FROM customer) * 1.5::DOUBLE AS elapsed FROM orders""")
def _(s):
    return results.resolution(results.parse_results(_report_texts(s)))


@query("a10_multimap", "SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS \"values\" FROM orders GROUP BY 1")
def _(s):
    return relational.multimap(s.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v")), "k", "v")


@query("a10_invert", "SELECT DISTINCT l_suppkey AS order_, l_orderkey AS supp FROM lineitem")
def _(s):
    return relational.invert(s.lineitem.select(F.col("l_orderkey").alias("order_"), F.col("l_suppkey").alias("supp")), "order_", "supp")


@query("a10_invert_one_to_one", "SELECT s_name, s_suppkey FROM supplier")
def _(s):
    return relational.invert_one_to_one(s.supplier, "s_suppkey", "s_name")


@query("a10_group_keys", "SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS keys FROM nation GROUP BY 1")
def _(s):
    return relational.group_keys_by_value(s.nation, "n_name", "n_regionkey")


@query("a13_method_scan", """
    SELECT graph_id, method, count(*) FILTER (kind = 'invoke') AS call_sites,
           count(DISTINCT operand) FILTER (kind = 'getfield') AS fields_read, count(DISTINCT operand) FILTER (kind = 'putfield') AS fields_written,
           count(DISTINCT operand) FILTER (kind = 'arraystore') AS array_types_written, count(*) FILTER (kind = 'new') AS allocations,
           count(DISTINCT operand) FILTER (kind = 'catch') AS caught_types, count(DISTINCT operand) FILTER (kind = 'checkcast') AS cast_types,
           bool_or(kind = 'arrayload' AND operand LIKE 'L%') AS object_array_load, bool_or(kind = 'arraystore' AND operand LIKE 'L%') AS object_array_store
    FROM instructions GROUP BY 1, 2""")
def _(s):
    return program.method_scan(s.instructions)


@query("a13_cast_types", "SELECT DISTINCT graph_id, method, operand FROM instructions WHERE kind = 'checkcast'")
def _(s):
    return program.scanned(s.instructions, "checkcast")


@query("a14_assigns_receiver", """
    SELECT graph_id, m.cls AS method, NOT is_static AND m.cls IN (SELECT method FROM instructions WHERE kind = 'putfield' AND slot = 0) AS assigns_this
    FROM methods m WHERE NOT is_constructor""")
def _(s):
    m = s.methods.filter("not is_constructor").select("graph_id", F.col("cls").alias("method"), "is_static")
    i = s.instructions.withColumn("kind", F.when(F.col("kind") == "putfield", "store").otherwise(F.col("kind")))
    return program.assigns_receiver(m, i)


@query("a15_hierarchy_size", """
    SELECT c.graph_id, classes, interfaces, methods
    FROM (SELECT graph_id, count(DISTINCT cls) AS classes, count(*) FILTER (is_interface) AS interfaces FROM classes GROUP BY 1) c
    JOIN (SELECT graph_id, count(DISTINCT method) AS methods FROM methods GROUP BY 1) m ON c.graph_id = m.graph_id""")
def _(s):
    return hierarchy.hierarchy_size(s.classes, s.methods)


@query("a15_category_share", """
    SELECT graph_id, size, count(*) AS nodes, avg(CASE WHEN category = 'PROMO' THEN 1.0 ELSE 0.0 END) AS "share_PROMO",
           avg(CASE WHEN category = 'SMALL' THEN 1.0 ELSE 0.0 END) AS "share_SMALL" FROM part_nodes GROUP BY 1, 2""")
def _(s):
    return program.share_by_category(s.part_nodes, ["size"], "category", ["PROMO", "SMALL"])


@query("a16_warnings", """
    SELECT DISTINCT o_orderstatus AS graph_id, 1 AS level, o_orderpriority AS message FROM orders
    UNION SELECT DISTINCT l_returnflag, 2, l_linestatus FROM lineitem""")
def _(s):
    a = s.orders.select(F.col("o_orderstatus").alias("graph_id"), F.lit(1).alias("level"), F.col("o_orderpriority").alias("message"))
    b = s.lineitem.select(F.col("l_returnflag").alias("graph_id"), F.lit(2).alias("level"), F.col("l_linestatus").alias("message"))
    return program.collect_warnings(a, b)


# --- order ---------------------------------------------------------------------------------------------
@query("w2_by_size", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1")
def _(s):
    return relational.by_size_descending(s.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), "n", ["c_nationkey"])


@query("w2_by_name", "SELECT s_name, s_suppkey FROM supplier ORDER BY s_name, s_suppkey")
def _(s):
    return relational.by_name(s.supplier.select("s_name", "s_suppkey"), "s_name", ["s_suppkey"])


@query("w3_bounded_report", "SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, l_suppkey, l_orderkey LIMIT 100")
def _(s):
    t = s.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return relational.first_rows(t, [F.desc("n"), "l_suppkey", "l_orderkey"], 100)


# --- sets ------------------------------------------------------------------------------------------------
SETS = {f: f"SELECT l_suppkey AS owner, l_partkey AS member FROM lineitem WHERE l_returnflag = '{f}'" for f in "AN"}


def _sets(s):
    return s.sql(SETS["A"]), s.sql(SETS["N"])


@query("o1_union", f"{SETS['A']} UNION {SETS['N']}")
def _(s):
    return relational.union_sets(*_sets(s))


@query("o1_intersect", f"{SETS['A']} INTERSECT {SETS['N']}")
def _(s):
    return relational.intersect_sets(*_sets(s))


@query("o1_difference", f"{SETS['A']} EXCEPT {SETS['N']}")
def _(s):
    return relational.subtract_sets(*_sets(s))


@query("o2_compare", f"""
    WITH a AS (SELECT DISTINCT * FROM ({SETS['A']})), b AS (SELECT DISTINCT * FROM ({SETS['N']})),
         u AS (SELECT coalesce(a.owner, b.owner) AS owner, a.member AS ma, b.member AS mb FROM a FULL JOIN b ON a.owner = b.owner AND a.member = b.member)
    SELECT owner, count(ma) AS size_a, count(mb) AS size_b, max(ma) AS max_a, max(mb) AS max_b, bool_and(ma IS NULL OR mb IS NOT NULL) AS a_in_b,
           bool_and(mb IS NULL OR ma IS NOT NULL) AS b_in_a, bool_and(ma IS NOT NULL AND mb IS NOT NULL) AS equal FROM u GROUP BY owner""")
def _(s):
    return relational.compare_sets(*_sets(s))


@query("o2_contains", f"""
    SELECT DISTINCT l_suppkey AS owner, l_partkey AS member, (l_suppkey, l_partkey) IN (SELECT (owner, member) FROM ({SETS['A']})) AS present FROM lineitem""")
def _(s):
    asked = s.lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("member")).distinct()
    return relational.contains(_sets(s)[0], asked)


@query("o5_runs_compared", """
    SELECT 'app' || c_custkey AS graph_id FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
      AND c_custkey IN (SELECT o_custkey FROM orders)""")
def _(s):
    full = results.parse_results(_report_texts(s))
    urgent = F.map_filter("app.`Violation Report`", lambda k, v: F.exists(v, lambda m: F.map_contains_key(m, "1-URGENT")))
    loose = full.withColumn("app", F.col("app").withField("`Violation Report`", urgent))
    return results.newly_verified(loose, full)


# --- scalar functions ------------------------------------------------------------------------------------
@query("x1_type_names", r"""
    SELECT method, 'L' || replace(src, '.', '/') AS machine, src AS source, 'I' AS prim, '[[L' || replace(src, '.', '/') AS arr
    FROM (SELECT method, replace(substr(cls, 2), '/', '.') AS src FROM signatures)""")
def _(s):
    t = s.signatures.select("method", names.to_source(F.col("cls")).alias("src"))
    return t.select("method", names.to_machine(F.col("src")).alias("machine"), names.to_source(names.to_machine(F.col("src"))).alias("source"),
                    names.to_machine(F.lit("int")).alias("prim"), names.to_machine(F.concat("src", F.lit("[][]"))).alias("arr"))


@query("x2_descriptors", r"""
    SELECT method, rtrim(regexp_extract(descriptor, '\)(.*)$', 1), ';') AS ret,
           list_transform(regexp_extract_all(regexp_extract(descriptor, '^\(([^)]*)\)', 1), '\[*(?:[BCDFIJSVZ]|L[^;]+;)'), lambda t: rtrim(t, ';')) AS params
    FROM signatures""")
def _(s):
    d = F.col("descriptor")
    return s.signatures.select("method", names.return_type(d).alias("ret"), names.parameter_types(d).alias("params"))


@query("x3_type_parts", r"""
    SELECT method, regexp_extract(cls, '^L(.*)/[^/]*$', 1) AS pkg, regexp_extract(cls, '[^/]+$', 0) AS short, 2 AS dims,
           cls AS element, false AS prim FROM signatures""")
def _(s):
    c = F.col("cls")
    arr = F.concat(F.lit("[["), c)
    return s.signatures.select("method", names.package(c).alias("pkg"), names.class_name(c).alias("short"), names.dimension(arr).alias("dims"),
                               names.innermost(arr).alias("element"), names.is_primitive(c).alias("prim"))


@query("x4_signatures", r"""
    SELECT method, replace(substr(cls, 2), '/', '.') AS cls, 'run' AS name, descriptor, replace(substr(cls, 2), '/', '.') || '.Inner' AS readable FROM signatures""")
def _(s):
    sig = F.concat(names.slash_to_dot(F.expr("substr(cls, 2)")), F.lit(".run"), "descriptor")
    t = s.signatures.select("method", sig.alias("sig"))
    c = names.signature_class(F.col("sig"))
    return t.select("method", c.alias("cls"), names.signature_name(F.col("sig")).alias("name"), names.signature_descriptor(F.col("sig")).alias("descriptor"),
                    names.dollar_to_dot(F.concat(c, F.lit("$Inner"))).alias("readable"))


@query("x5_flag_types", """
    SELECT event_id, list_filter(['ACQUIRE_CAUSES_WAKEUP', 'FULL_WAKE_LOCK', 'ON_AFTER_RELEASE', 'PARTIAL_WAKE_LOCK', 'SCREEN_BRIGHT_WAKE_LOCK', 'SCREEN_DIM_WAKE_LOCK', 'UNKNOWN'],
             lambda n, i: (f & [268435456, 26, 536870912, 1, 10, 6, 4294967295][i]) = [268435456, 26, 536870912, 1, 10, 6, 4294967295][i]) AS types
    FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS f FROM events)""")
def _(s):
    return s.events.select("event_id", scalars.flag_types(F.floor("value")).alias("types"))


@query("x6_elapsed", "SELECT event_id, user_id * 60.0::DOUBLE + event_id + 0.5::DOUBLE AS seconds FROM events")
def _(s):
    txt = F.concat(F.col("user_id").cast("string"), F.lit("m"), F.col("event_id").cast("string"), F.lit(".5s"))
    return s.events.select("event_id", scalars.elapsed_seconds(txt).alias("seconds"))


@query("x7_integer_math", """
    SELECT p_partkey, CASE WHEN p_size <= 20 THEN CAST(factorial(p_size) AS BIGINT) END AS fact,
           CASE WHEN p_partkey > 0 THEN len(bin(p_partkey)) - 1 END AS low, p_partkey > 0 AND bit_count(p_partkey) = 1 AS pow2,
           CASE WHEN p_partkey > 0 THEN len(bin(p_partkey)) - CASE WHEN bit_count(p_partkey) = 1 THEN 1 ELSE 0 END END AS high,
           CAST(p_partkey AS BIGINT) * 4294967296 + p_size AS packed FROM part""")
def _(s):
    k = F.col("p_partkey")
    return s.part.select("p_partkey", scalars.factorial(F.col("p_size")).alias("fact"), scalars.floor_log2(k).cast("long").alias("low"), scalars.is_power_of_2(k).alias("pow2"),
                         scalars.ceil_log2(k).cast("long").alias("high"), scalars.pack_ints(k, F.col("p_size")).alias("packed"))


@query("x8_qualified_names", r"""
    SELECT method, regexp_extract(n, '[^.]+$', 0) AS plain, n AS top FROM (SELECT method, replace(substr(cls, 2), '/', '.') AS n FROM signatures)""")
def _(s):
    n = names.slash_to_dot(F.expr("substr(cls, 2)"))
    return s.signatures.select("method", names.remove_package(n).alias("plain"), names.top_level_type(F.concat(n, F.lit("$1$b"))).alias("top"))


@query("x9_json_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_keys(props) AS keys FROM events")
def _(s):
    return s.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_object_keys("props").alias("keys"))


@query("x10_branches", """
    SELECT graph_id, block, op, CASE op WHEN 'eq' THEN l = r WHEN 'ne' THEN l <> r WHEN 'lt' THEN l < r WHEN 'ge' THEN l >= r END AS taken,
           CASE WHEN op = 'switch' THEN CASE WHEN l <= 25 THEN 'case' || l ELSE 'default' END END AS target
    FROM (SELECT p_type AS graph_id, p_partkey AS block, p_size AS l, 25 AS r,
                 CASE p_type WHEN 'SMALL' THEN 'eq' WHEN 'LARGE' THEN 'ne' WHEN 'PROMO' THEN 'lt' WHEN 'MEDIUM' THEN 'ge' ELSE 'switch' END AS op FROM part)""")
def _(s):
    b = s.sql("""SELECT p_type AS graph_id, p_partkey AS block, p_size AS left, 25 AS right,
        CASE p_type WHEN 'SMALL' THEN 'eq' WHEN 'LARGE' THEN 'ne' WHEN 'PROMO' THEN 'lt' WHEN 'MEDIUM' THEN 'ge' ELSE 'switch' END AS op FROM part""")
    cases = b.filter("op = 'switch'").select("graph_id", "block", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("label"))
    cases = cases.withColumn("target", F.concat(F.lit("case"), "label"))
    default = b.filter("op = 'switch'").select("graph_id", "block", F.lit(None).cast("int").alias("label"), F.lit("default").alias("target"))
    return program.branch_taken(b, cases.unionByName(default)).select("graph_id", "block", "op", "taken", "target")

"""Result files (one JSON object per app), their histograms, and graph text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfacts.functions.scalars import elapsed_seconds

FILE_PATTERN = "0.*results.*"  # searched for anywhere in the file name
CALLS = "struct<successfully_resolved_calls:bigint,total_calls:bigint>"
APP = (
    "struct<version:string,"
    "`Violation Report`:map<string,array<map<string,string>>>,"
    "`Warning Report`:array<string>,"
    f"Intent:{CALLS},Runnable:{CALLS},elapsed:string>"
)


def parse_results(texts: DataFrame, column: str = "value") -> DataFrame:
    """``(graph_id, app struct)`` from JSON texts ``{app: {...}}``; apps without a violation report failed
    and are left out."""
    apps = texts.select(F.explode(F.from_json(column, f"map<string,{APP}>")).alias("graph_id", "app"))
    return apps.filter(F.col("app.`Violation Report`").isNotNull())


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All matching result files of a folder."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return parse_results(files.filter(F.col("name").rlike(FILE_PATTERN)))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per app and line: ``{"app": {...}}``; ``results`` as from :func:`parse_results`."""
    results.select(F.to_json(F.create_map("graph_id", "app")).alias("value")).write.text(path)


def verified(results: DataFrame) -> DataFrame:
    """``(graph_id, verified)``: no component has a violation."""
    return results.select("graph_id", (F.size("app.`Violation Report`") == 0).alias("verified"))


def violation_tags(results: DataFrame) -> DataFrame:
    """``(graph_id, component, tag, message)``, one row per reported violation."""
    parts = results.select("graph_id", F.explode("app.`Violation Report`").alias("component", "items"))
    parts = parts.select("graph_id", "component", F.explode("items").alias("item"))
    return parts.select("graph_id", "component", F.explode("item").alias("tag", "message"))


def histogram(results: DataFrame) -> DataFrame:
    """``(kind, tag, n, percent)``: apps per violation tag (an app counts once), occurrences per warning,
    verified and failed apps; percentages of all apps."""
    total = results.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("total"))
    tags = violation_tags(results).groupBy("tag").agg(F.count_distinct("graph_id").alias("n")).select(F.lit("violation").alias("kind"), "tag", "n")
    warned = results.select(F.explode("app.`Warning Report`").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    status = verified(results).groupBy(F.when(F.col("verified"), "verified").otherwise("failed").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    rows = tags.unionByName(warned.select(F.lit("warning").alias("kind"), "tag", "n")).unionByName(
        status.select(F.lit("status").alias("kind"), "tag", "n"))
    # total is exactly one row
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("kind", "tag", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"))


def resolution(results: DataFrame) -> DataFrame:
    """Resolved and total asynchronous starts over all apps, and the summed elapsed seconds."""
    get = lambda k, f: F.coalesce(F.sum(f"app.{k}.{f}"), F.lit(0))
    return results.agg(
        get("Intent", "successfully_resolved_calls").alias("resolved_intents"), get("Intent", "total_calls").alias("total_intents"),
        get("Runnable", "successfully_resolved_calls").alias("resolved_runnables"), get("Runnable", "total_calls").alias("total_runnables"),
        F.sum(elapsed_seconds(F.col("app.elapsed"))).alias("elapsed"))


def newly_verified(results: DataFrame, other: DataFrame) -> DataFrame:
    """Apps verified in one run but not in the other."""
    return verified(results).filter("verified").select("graph_id").join(
        verified(other).filter("verified").select("graph_id"), "graph_id", "left_anti")


def graph_lines(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """DOT statements as text rows: labelled (and coloured) nodes when given, then edges.
    ``nodes(graph_id, id, label, colour)``; ``edges`` may have a ``label``."""
    label = F.format_string(' [label="%s"]', F.col("label")) if "label" in edges.columns else F.lit("")
    lines = edges.select("graph_id", F.concat(F.format_string('"%s" -> "%s"', F.col("src").cast("string"), F.col("dst").cast("string")), label).alias("value"))
    if nodes is None:
        return lines
    style = F.format_string('"%s" [label="%s" color=%s]', F.col("id").cast("string"), F.col("label"), F.col("colour"))
    return nodes.select("graph_id", style.alias("value")).unionByName(lines)


def write_graph(lines: DataFrame, path: str) -> None:
    """One folder per graph."""
    lines.write.partitionBy("graph_id").text(path)

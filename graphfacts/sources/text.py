"""Tables and lists kept in text files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _split(line: Column, delimiter: str | None) -> Column:
    """Tokens between runs of white space, or of one delimiter character; no empty tokens."""
    runs = r"\s+" if delimiter is None else f"[{re.escape(delimiter)}]+"
    return F.filter(F.split(line, runs), lambda t: t != "")


def _kept(lines: DataFrame, comment: str | None) -> DataFrame:
    out = lines.filter(F.trim("value") != "")
    return out if comment is None else out.filter(~F.ltrim("value").startswith(comment))


def read_table(spark: SparkSession, path: str, comment: str | None = "#", delimiter: str | None = None) -> DataFrame:
    """A string table: the first line that is neither blank nor a comment names the columns, runs of the
    delimiter count once. A comment begins in the line's first place. A row of another width raises while it is read.

    The heading is the first kept line of the first file (by name). Further files may begin with the same heading, which
    is then left out; lines that merely look like it are rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    kept = lines.filter(F.trim("value") != "")
    if comment is not None:
        kept = kept.filter(~F.col("value").startswith(comment))
    # within one block the lines keep their order, so the smallest (block, row) is a file's first line
    kept = kept.withColumn("row", F.monotonically_increasing_id())
    place = F.struct("at", "row")
    firsts = kept.groupBy("file").agg(F.min_by(F.struct("value", "row"), place).alias("first")).select("file", "first.value", "first.row")
    head = firsts.agg(F.min_by("value", "file").alias("value")).first()
    if head.value is None:
        raise ValueError(f"no heading line in {path}")
    heading = [t for t in re.split(r"\s+" if delimiter is None else f"[{re.escape(delimiter)}]+", head.value) if t]
    headings = firsts.filter(F.col("value") == head.value).select("file", "row")
    cells = kept.join(headings, ["file", "row"], "left_anti").select(_split(F.col("value"), delimiter).alias("c"))
    width = len(heading)
    checked = F.when(F.size("c") == width, F.col("c")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {width} cells, got "), F.size("c").cast("string"))))
    return cells.select(checked.alias("c")).select(*[F.col("c")[i].alias(h) for i, h in enumerate(heading)])


def parse_cells(lines: DataFrame, column: str, delimiter: str | None = None) -> DataFrame:
    """The tokens of a text column as an array column ``cells``."""
    return lines.withColumn("cells", _split(F.col(column), delimiter))


def empty_table(spark: SparkSession, headings: list[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{h}` string" for h in headings))


def exclusion_pattern(patterns: list[str]) -> str:
    """One expression that matches a name in full when one of the patterns does."""
    return "^(?:" + "|".join(p.strip() for p in patterns if p.strip()) + ")$"


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """The lines of an exclusion list, a small configuration file."""
    return [r.value for r in spark.read.text(path).filter(F.trim("value") != "").collect()]


def exclude(table: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Rows whose ``name`` matches none of the patterns in full."""
    kept = [p for p in patterns if p.strip()]
    return table.filter(~F.col(name).rlike(exclusion_pattern(kept))) if kept else table


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """One method signature per line."""
    return _kept(spark.read.text(path), "#").select(F.trim("value").alias("signature")).distinct()


def of_targets(table: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    return table.join(targets.select(F.col("signature").alias(column)), column, "left_semi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``loader, language, entry_type, path`` lines naming what belongs to a program."""
    return spark.read.csv(path, schema="loader string, language string, entry_type string, path string", comment="#",
                          ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def in_manifest(facts: DataFrame, column: str, manifest: DataFrame, loader: str | None = None) -> DataFrame:
    """Facts whose partition column is listed (for one loader)."""
    kept = manifest if loader is None else manifest.filter(F.col("loader") == loader)
    return facts.join(kept.select(F.col("path").alias(column)), column, "left_semi")

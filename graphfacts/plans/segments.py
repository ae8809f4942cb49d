"""Ordered work inside groups of any size.

A window over a group sorts the whole group in one task. When one group may hold a third of all rows, the rows
are range-partitioned by (group, order) instead: a large group spans several segments, each is handled on its
own, and what a segment needs from the earlier ones comes from a summary of one row per group and segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphfacts.plans import tables

SEGMENT = "_segment"


def split(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the number of its range partition; written, so that the numbers stay what they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.materialize(df.repartitionByRange(parts, *by, *order).withColumn(SEGMENT, F.spark_partition_id()))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Position, from 0, of every row within its group."""
    cut = split(df, by, order)
    within = F.row_number().over(Window.partitionBy(*by, SEGMENT).orderBy(*order))
    sizes = cut.groupBy(*by, SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, SEGMENT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return cut.withColumn("_row", within).join(offsets, [*by, SEGMENT]).select(
        *df.columns, (F.col("_row") + F.col("_before") - 1).cast("int").alias(name))


def last_known(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` at or before every row of its group."""
    cut = split(df.withColumn("_value", value), by, order)
    within = F.last("_value", ignorenulls=True).over(
        Window.partitionBy(*by, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = cut.groupBy(*by, SEGMENT).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, SEGMENT, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return cut.withColumn("_here", within).join(carried, [*by, SEGMENT]).select(
        *df.columns, F.coalesce("_here", "_carried").alias(name))

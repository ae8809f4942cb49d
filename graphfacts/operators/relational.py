"""Selections, set algebra and relations over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- selection -------------------------------------------------------------------------------
def where_equals(table: DataFrame, column: str, value) -> DataFrame:
    """All columns of the rows whose ``column`` equals ``value`` (a bag; null never matches)."""
    return table.filter(F.col(column) == F.lit(value))


def select_where_equals(table: DataFrame, attribute: str, column: str, value) -> DataFrame:
    """The set of ``attribute`` values among the rows whose ``column`` equals ``value``."""
    return where_equals(table, column, value).select(attribute).distinct()


def where(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows satisfying any boolean expression, a pandas UDF included."""
    return table.filter(predicate)


def view_where_equals(table: DataFrame, column: str, value, name: str) -> DataFrame:
    """The selection registered as a named view; nothing is computed until it is read."""
    view = where_equals(table, column, value)
    view.createOrReplaceTempView(name)
    return view


def negation(p: Column) -> Column:
    return ~p


def conjunction(p: Column, q: Column) -> Column:
    return p & q


def disjunction(p: Column, q: Column) -> Column:
    return p | q


def element_of(table: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose ``column`` occurs in another relation."""
    return table.join(members.select(F.col(member).alias(column)), column, "left_semi")


def map_rows(table: DataFrame, expression: Column, name: str, as_set: bool = False) -> DataFrame:
    mapped = table.select(expression.alias(name))
    return mapped.distinct() if as_set else mapped


def quantify(table: DataFrame, by: Sequence[str], predicate: Column) -> DataFrame:
    """Per group: does the predicate hold for some row, for all rows?"""
    return table.groupBy(*by).agg(
        F.coalesce(F.bool_or(predicate), F.lit(False)).alias("for_some"),
        F.coalesce(F.bool_and(predicate), F.lit(True)).alias("for_all"),
    )


def find(table: DataFrame, predicate: Column, order: Sequence[str]) -> DataFrame:
    """The first matching row in a total order, or no row."""
    return table.filter(predicate).orderBy(*order).limit(1)


def concatenate(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


# --- rows ------------------------------------------------------------------------------------
def add_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def remove_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Drop every row equal to a given one (nulls equal nulls)."""
    match = F.lit(True)
    for c in table.columns:
        match = match & table[c].eqNullSafe(rows[c])
    return table.join(rows, match, "left_anti")


# --- binary relations R(x, y) ----------------------------------------------------------------
def related(relation: DataFrame, keys: DataFrame) -> DataFrame:
    """All pairs whose ``x`` is asked for."""
    return relation.join(keys, "x", "left_semi")


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """{(x, z) | left(x, y), right(y, z)}."""
    inner = right.select(F.col("x").alias("y"), F.col("y").alias("z"))
    return left.join(inner, "y").select("x", F.col("z").alias("y")).distinct()


def related_count(relation: DataFrame) -> DataFrame:
    return relation.groupBy("x").agg(F.count_distinct("y").alias("n"))


def unrelate(relation: DataFrame, pairs: DataFrame) -> DataFrame:
    return relation.join(pairs, ["x", "y"], "left_anti")


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def intersecting(members: DataFrame, others: DataFrame) -> DataFrame:
    """Owners in ``members(owner, member)`` that share a member with ``others(member)``."""
    return members.join(others, "member", "left_semi").select("owner").distinct()


# --- sets in long form: (owner, member) --------------------------------------------------------
def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def subtract_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per owner: sizes, maxima, and whether a ⊆ b, b ⊆ a, a = b. One shuffle on (owner, member)."""
    tagged = a.select("owner", "member", F.lit(1).alias("side")).unionByName(
        b.select("owner", "member", F.lit(2).alias("side"))
    )
    sides = tagged.groupBy("owner", "member").agg(F.bit_or("side").alias("sides"))
    in_a, in_b = F.col("sides").bitwiseAND(1) > 0, F.col("sides").bitwiseAND(2) > 0
    return sides.groupBy("owner").agg(
        F.count(F.when(in_a, 1)).alias("size_a"),
        F.count(F.when(in_b, 1)).alias("size_b"),
        F.max(F.when(in_a, F.col("member"))).alias("max_a"),
        F.max(F.when(in_b, F.col("member"))).alias("max_b"),
        F.bool_and(in_b | ~in_a).alias("a_in_b"),
        F.bool_and(in_a | ~in_b).alias("b_in_a"),
        F.bool_and(in_a & in_b).alias("equal"),
    )


def contains(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each asked pair with a flag telling whether it is in the relation."""
    known = sets.select("owner", "member").distinct().withColumn("present", F.lit(True))
    return pairs.join(known, ["owner", "member"], "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


# --- multimaps ---------------------------------------------------------------------------------
def multimap(pairs: DataFrame, key: str, value: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def invert(pairs: DataFrame, key: str, value: str) -> DataFrame:
    return pairs.select(F.col(value).alias(key), F.col(key).alias(value)).distinct()


def invert_one_to_one(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Inverse of a map; a value reached from two keys raises while the query runs."""
    return pairs.groupBy(value).agg(
        F.min(key).alias(key), F.count_distinct(key).alias("_n")
    ).select(
        value,
        F.when(F.col("_n") == 1, F.col(key))
        .otherwise(F.raise_error(F.concat(F.lit("not one-to-one: "), F.col(value).cast("string"))))
        .alias(key),
    )


def group_keys_by_value(pairs: DataFrame, key: str, value: str) -> DataFrame:
    return pairs.groupBy(value).agg(F.sort_array(F.collect_set(key)).alias("keys"))


# --- order and bounds ----------------------------------------------------------------------------
def by_size_descending(table: DataFrame, size: str, ties: Sequence[str]) -> DataFrame:
    return table.orderBy(F.desc(size), *ties)


def by_name(table: DataFrame, name: str, ties: Sequence[str] = ()) -> DataFrame:
    return table.orderBy(F.col(name).cast("string"), *ties)


def first_rows(table: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of a total order: a bounded report."""
    return table.orderBy(*order).limit(n)

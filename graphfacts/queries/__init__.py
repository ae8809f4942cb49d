"""Registered queries: every operator applied to the given tables, each with an SQL counterpart where SQL can
express it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphfacts.plans.views import Source, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: str = ""):
    """Register a function of a :class:`Source` under ``name``; ``sql`` (with its recursive table) is the oracle."""

    def register(build):
        QUERIES[name] = lambda spark, folder: build(Source(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, recursive)
        return build

    return register


def load() -> None:
    from graphfacts.queries import classes, flows, graphs, programs, relations, resources  # noqa: F401

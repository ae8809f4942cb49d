import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("graphfacts-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Small graphs: ``make.edges({"g": [(1, 2)]})``, ``make.nodes({"g": [1, 2]})``."""

    class Make:
        def edges(self, graphs, kind="long", more="", cols=("src", "dst")):
            rows = [(g, *e) for g, es in graphs.items() for e in es]
            return spark.createDataFrame(rows, f"graph_id string, {cols[0]} {kind}, {cols[1]} {kind}" + more)

        def nodes(self, graphs, kind="long", name="id"):
            return spark.createDataFrame([(g, n) for g, ns in graphs.items() for n in ns], f"graph_id string, {name} {kind}")

        def table(self, rows, schema):
            return spark.createDataFrame(rows, schema)

    return Make()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())

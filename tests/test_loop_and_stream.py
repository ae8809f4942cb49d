import datetime as dt
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphfacts.operators import graph
from graphfacts.plans import fixpoint, tables
from graphfacts.streaming.resource_state import resource_state_stream


def test_long_chain_and_tiers(spark, make, monkeypatch):
    chain = spark.range(60).selectExpr("'c' as graph_id", "id as src", "id + 1 as dst")
    monkeypatch.setattr(graph, "HOPS", 1)  # one step per round, so that the log grows tiers
    got = graph.reachable(chain, make.nodes({"c": [0]}))
    assert got.count() == 61


def test_guards_raise(spark, make):
    seed = spark.range(1).selectExpr("id as n")
    grow = lambda new, _: new.selectExpr("n + 1 as n")
    with pytest.raises(fixpoint.LimitExceeded):
        fixpoint.fixpoint(seed, grow, max_rounds=3)
    with pytest.raises(fixpoint.LimitExceeded):
        fixpoint.fixpoint(seed, grow, max_rows=3)
    bounded = fixpoint.solve(seed, grow, rounds=2)
    assert not bounded.complete and bounded.df.count() == 3
    with pytest.raises(fixpoint.LimitExceeded):
        graph.dag_levels(make.nodes({"g": [1, 2]}), make.edges({"g": [(1, 2), (2, 1)]}))


def test_work_dir_follows_the_session(spark):
    named = spark.conf.get(tables.SETTING, None)
    where = tables.work_dir(spark)
    assert where == named.rstrip("/") if named else where
    assert tables.write(spark.range(3)).path.startswith(where)


def test_stream_orders_events_and_expires_timed_acquires(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    events = [(1, 1, at(0), "acquire"), (1, 3, at(20), "release"), (1, 2, at(10), None), (2, 4, at(5), "timed_acquire"), (2, 5, at(100), None), (9, 9, at(500), None)]
    base = f"{tables.work_dir(spark)}/{uuid.uuid4().hex}"
    schema = "user_id long, event_id long, ts timestamp, op string"
    spark.createDataFrame(events, schema).write.parquet(f"{base}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = resource_state_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), "0 seconds", timeout_ms=30_000)
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = spark.read.parquet(f"{base}/out").withColumn("s", F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00")))
    assert rows(got.filter("user_id = 1"), "event_id", "s", "state") == [(1, 0, "ACQUIRED"), (2, 10, "ACQUIRED"), (3, 20, "RELEASED")]
    assert sorted((r.s, r.state) for r in got.filter("user_id = 2").collect()) == [(5, "TIMED_ACQUIRED"), (35, "RELEASED"), (100, "RELEASED")]


def test_a_hot_group_spans_segments(spark):
    from graphfacts.plans import segments

    data = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 600, i, "x" + str(i) if i % 5 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(data, "k string, t int, i int, v string")
    want_pos, want_last = [], []
    for key in {d[0] for d in data}:
        last = None
        for n, (k, t, i, v) in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]))):
            last = v or last
            want_pos.append((k, i, n))
            want_last.append((k, i, last or ""))
    assert rows(segments.positions(df, ["k"], ["t", "i"], "n"), "k", "i", "n") == sorted(want_pos)
    got = segments.last_known(df, ["k"], ["t", "i"], F.col("v"), "last").fillna("", ["last"])
    assert rows(got, "k", "i", "last") == sorted(want_last)
    assert segments.split(df, ["k"], ["t", "i"]).filter("k = 'hot'").select("_segment").distinct().count() > 1

"""Antichains of conditions, common supertypes with interfaces, the stream's slices and its end."""

import datetime as dt
import itertools
import random
import uuid

from pyspark.sql import functions as F

from conftest import rows
from graphfacts.operators import dataflow, hierarchy, resource
from graphfacts.plans import tables
from graphfacts.streaming.resource_state import closing_mark, resource_state_stream


def minimal(sets):
    return {s for s in sets if not any(o < s for o in sets)}


def ways(edges, start, end):
    out, stack = [], [[start]]
    while stack:
        p = stack.pop()
        if p[-1] == end:
            out.append(p)
        stack += [p + [d] for s, d in edges if s == p[-1]]
    return out


def test_call_conditions_equal_listed_ways(spark, make):
    rnd = random.Random(5)
    edges = sorted({(a, b) for a, b in itertools.combinations(range(1, 10), 2) if rnd.random() < 0.4} | {(1, 2)})
    named = {(a, b): f"c{a % 3}{b % 2}" for a, b in edges}
    calls, control = [4, 7, 9], {4: {1, 2}, 7: {2, 3, 5}, 9: {1, 4, 6, 8}}
    table = make.table([("g", a, b, c) for (a, b), c in named.items()], "graph_id string, src long, dst long, condition string")
    nodes, arcs = make.nodes({"g": range(1, 10)}), make.edges({"g": edges})

    def expected(owns):
        return sorted((c, tuple(sorted(s))) for c in calls for s in minimal(
            {frozenset(named[e] for e in zip(p, p[1:]) if e[0] in owns(c)) for p in ways(edges, 1, c)}))

    owners = make.table([("g", c, s) for c, ss in control.items() for s in ss], "graph_id string, call long, src long")
    args = (nodes, arcs, make.nodes({"g": [1]}), make.nodes({"g": calls}))
    got = resource.call_conditions(*args, owners, table)
    assert sorted((r.call, tuple(r.conditions)) for r in got.collect()) == expected(control.__getitem__)
    got = resource.call_conditions(*args, make.table([("g", s) for s in (1, 2, 5)], "graph_id string, src long"), table)
    assert sorted((r.call, tuple(r.conditions)) for r in got.collect()) == expected(lambda c: {1, 2, 5})


def test_call_conditions_ignore_cycles_and_unreached_calls(make):
    arcs = make.edges({"g": [(1, 2), (2, 3), (3, 2), (3, 4), (6, 5)]})
    table = make.table([("g", 1, 2, "a"), ("g", 3, 2, "b"), ("g", 3, 4, "c"), ("g", 3, 4, "d")], "graph_id string, src long, dst long, condition string")
    everywhere = make.table([("g", i) for i in range(1, 7)], "graph_id string, src long")
    got = resource.call_conditions(make.nodes({"g": range(1, 7)}), arcs, make.nodes({"g": [1]}), make.nodes({"g": [1, 4, 5]}), everywhere, table)
    # the edges inside the component {2, 3} are no way: 4 is not reached without them
    assert sorted((r.call, tuple(r.conditions)) for r in got.collect()) == [(1, ())]


def test_many_ways_keep_few_sets(make):
    # 2^40 ways through forty diamonds, one minimal set
    edges = [e for i in range(0, 120, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))]
    table = make.table([("g", i, i + 1, "left") for i in range(0, 120, 3)], "graph_id string, src long, dst long, condition string")
    got = resource.call_conditions(make.nodes({"g": range(121)}), make.edges({"g": edges}), make.nodes({"g": [0]}), make.nodes({"g": [120]}),
                                   make.table([("g", i) for i in range(120)], "graph_id string, src long"), table)
    assert [(r.call, r.conditions) for r in got.collect()] == [(120, [])]


def test_common_supertypes_with_interfaces(make):
    # A and B extend Base and implement I and J; I extends K; C implements J only; D shares nothing
    extends = make.edges({"g": [("A", "Base"), ("B", "Base"), ("I", "K")]}, "string", cols=("sub", "sup"))
    implements = make.edges({"g": [("A", "I"), ("B", "I"), ("A", "J"), ("B", "J"), ("C", "J"), ("D", "L")]}, "string", cols=("cls", "iface"))
    closure = hierarchy.ancestors(hierarchy.supertypes(extends, implements))
    pairs = make.table([("g", "A", "B"), ("g", "A", "C"), ("g", "A", "A"), ("g", "A", "D"), ("g", "A", "K")], "graph_id string, a string, b string")
    found = hierarchy.least_common_supertypes(closure, pairs)
    assert rows(found, "a", "b", "supertype") == [
        ("A", "A", "A"), ("A", "B", "Base"), ("A", "B", "I"), ("A", "B", "J"), ("A", "C", "J"), ("A", "K", "K")]
    classes = make.table([("g", "Base", False), ("g", "I", True), ("g", "J", True), ("g", "K", True), ("g", "A", False)], "graph_id string, cls string, is_interface boolean")
    assert rows(hierarchy.one_supertype(found, ["a", "b"], classes), "a", "b", "supertype") == [
        ("A", "A", "A"), ("A", "B", "Base"), ("A", "C", "J"), ("A", "K", "K")]
    # values: x gets A and C, y a copy of x and B
    flow = make.edges({"g": [("x", "y")]}, "string")
    known = make.table([("g", "x", "A"), ("g", "x", "C"), ("g", "y", "B"), ("g", "z", "A"), ("g", "z", "B")], "graph_id string, value string, type string")
    assert rows(dataflow.infer_type_sets(flow, known, closure), "value", "type") == [
        ("x", "J"), ("y", "J"), ("z", "Base"), ("z", "I"), ("z", "J")]
    assert hierarchy.common_supertypes(closure, known.filter("false").select("graph_id", F.col("value").alias("set"), F.col("type").alias("member"))).count() == 0


def run_stream(spark, events, marks, base, **options):
    """All events, then the marks, from one checkpoint."""
    schema = "user_id long, event_id long, ts timestamp, op string"
    spark.createDataFrame(events, schema).write.parquet(f"{base}/in/0")
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for last in (False, True):
            if last:
                marks(spark.read.schema(schema).parquet(f"{base}/in/0")).write.parquet(f"{base}/in/1")
            out = resource_state_stream(spark.readStream.schema(schema).parquet(f"{base}/in/*"), "0 seconds", **options)
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, old)
    return spark.read.parquet(f"{base}/out")


def test_stream_of_many_slices_ends_whole(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    events = [(u, 1000 * u + i, start + dt.timedelta(milliseconds=rnd.randrange(20_000)), rnd.choice(["acquire", "release", "timed_acquire", None]))
              for u in range(3) for i in range(120)]
    # several rows of one key at the very end
    events += [(1, 1900 + i, start + dt.timedelta(milliseconds=20_000), op) for i, op in enumerate(["acquire", None, "release"])]
    rnd.shuffle(events)
    got = run_stream(spark, events, lambda e: closing_mark(e, "user_id", "event_id"), f"{tables.work_dir(spark)}/{uuid.uuid4().hex}", slice_ms=700)
    batch = resource.states_in_log(spark.createDataFrame(events, "user_id long, event_id long, ts timestamp, op string"), ["user_id"], ["ts", "event_id"])
    assert rows(got, "user_id", "event_id", "state") == rows(batch, "user_id", "event_id", "state")


def test_timed_acquires_end_across_slices(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    # 1: released before the timeout; 2: runs out inside a later slice, before an event of that slice; 3: runs out at the end
    events = [(1, 1, at(0), "timed_acquire"), (1, 2, at(2900), "release"), (2, 3, at(100), "timed_acquire"), (2, 4, at(3900), None),
              (3, 5, at(4000), "timed_acquire")]
    got = run_stream(spark, events, lambda e: closing_mark(e, "user_id", "event_id"), f"{tables.work_dir(spark)}/{uuid.uuid4().hex}", timeout_ms=3000)
    got = got.withColumn("ms", F.unix_millis("ts") - F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"))).fillna("", ["op"])
    assert rows(got, "user_id", "ms", "op", "state") == [
        (1, 0, "timed_acquire", "TIMED_ACQUIRED"), (1, 2900, "release", "RELEASED"),
        (2, 100, "timed_acquire", "TIMED_ACQUIRED"), (2, 3100, "expire", "RELEASED"), (2, 3900, "", "RELEASED"),
        (3, 4000, "timed_acquire", "TIMED_ACQUIRED"), (3, 7000, "expire", "RELEASED")]

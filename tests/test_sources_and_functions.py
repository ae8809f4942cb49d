import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphfacts.functions import names, scalars
from graphfacts.plans import tables
from graphfacts.sources import results, text


def lines(path, *content):
    path.write_text("\n".join(content) + "\n")
    return str(path)


def test_text_table(spark, tmp_path):
    p = lines(tmp_path / "t.txt", "# comment", "", "name   size", "a  1", "  b    2 ", "# more", "c 3")
    assert rows(text.read_table(spark, p), "name", "size") == [("a", "1"), ("b", "2"), ("c", "3")]
    p = lines(tmp_path / "u.txt", "name,size", "a,,1")
    assert rows(text.read_table(spark, p, delimiter=","), "name", "size") == [("a", "1")]
    with pytest.raises(Exception, match="expected 2 cells"):
        text.read_table(spark, lines(tmp_path / "v.txt", "a b", "1 2 3")).collect()


def test_lists(spark, tmp_path):
    rx = text.read_patterns(spark, lines(tmp_path / "x.txt", r"java\/awt\/.*", r"sun\/.*"))
    t = spark.createDataFrame([("java/awt/Box",), ("x/java/awt/Box",), ("sun/a",)], "cls string")
    assert rows(text.exclude(t, "cls", rx), "cls") == [("x/java/awt/Box",)]
    m = text.read_manifest(spark, lines(tmp_path / "m.txt", "Application,Java,classFile,hello/Hello.class", "Primordial,Java,stdlib,none"))
    assert rows(m.filter("loader = 'Application'"), "entry_type", "path") == [("classFile", "hello/Hello.class")]
    assert text.read_targets(spark, lines(tmp_path / "s.txt", "a.b()V", "", "a.b()V")).count() == 1


def test_result_files(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "run0_results.json").write_text(
        '{"a": {"version": "1", "Violation Report": {"C": [{"ACTIVITY_ONSTOP": "m"}, {"ACTIVITY_ONSTOP": "n"}]}, "Warning Report": ["W", "W"],'
        ' "Intent": {"successfully_resolved_calls": 1, "total_calls": 2}, "elapsed": "1m2.5s"}, "b": {"version": "1", "Violation Report": {}}, "c": {"version": "1"}}')
    (folder / "other.json").write_text('{"z": {"Violation Report": {}}}')
    got = results.read_results(spark, str(folder))
    assert rows(results.verified(got), "graph_id", "verified") == [("a", False), ("b", True)]
    assert rows(results.histogram(got), "kind", "tag", "n", "percent") == [
        ("status", "failed", 1, 50.0), ("status", "verified", 1, 50.0), ("violation", "ACTIVITY_ONSTOP", 1, 50.0), ("warning", "W", 2, 100.0)]
    r = results.resolution(got).first()
    assert (r.resolved_intents, r.total_intents, r.resolved_runnables, r.elapsed) == (1, 2, 0, 62.5)
    path = f"{tables.work_dir(spark)}/{uuid.uuid4().hex}"
    results.write_results(got, path)
    assert results.parse_results(spark.read.text(path)).count() == 2


def test_graph_text(spark):
    e = spark.createDataFrame([("g", 1, 2, "x")], "graph_id string, src int, dst int, label string")
    n = spark.createDataFrame([("g", 1, "one", "red")], "graph_id string, id int, label string, colour string")
    assert rows(results.graph_lines(e, n), "value") == [('"1" -> "2" [label="x"]',), ('"1" [label="one" color=red]',)]


def test_names(spark):
    t = spark.range(1)
    ask = lambda f, v: t.select(f(F.lit(v)).alias("v")).first().v
    assert ask(names.to_machine, "java.lang.String") == "Ljava/lang/String"
    assert ask(names.to_machine, "int[][]") == "[[I"
    assert ask(names.to_source, "[Ljava/lang/String;") == "java.lang.String[]"
    assert ask(names.return_type, "(ILjava/lang/String;)Ljava/lang/Object;") == "Ljava/lang/Object"
    assert ask(names.parameter_types, "(I[Ljava/lang/String;[[J)V") == ["I", "[Ljava/lang/String", "[[J"]
    assert ask(names.parameter_types, "()V") == []
    assert ask(names.package, "Ljava/lang/String") == "java/lang" and ask(names.package, "LFoo") is None and ask(names.package, "I") is None
    assert ask(names.class_name, "[Ljava/lang/String") == "String" and ask(names.class_name, "LFoo") == "Foo"
    assert ask(names.dimension, "[[I") == 2 and ask(names.innermost, "[[I") == "I" and ask(names.is_primitive, "I")
    sig = "a.b.C.m(ILx/Y;)V"
    assert (ask(names.signature_class, sig), ask(names.signature_name, sig), ask(names.signature_descriptor, sig)) == ("a.b.C", "m", "(ILx/Y;)V")
    assert ask(names.remove_package, "a.b.C") == "C" and ask(names.top_level_type, "a.B$C$1") == "a.B"


def test_scalars(spark):
    t = spark.range(1)
    ask = lambda c: t.select(c.alias("v")).first().v
    assert ask(scalars.flag_types(F.lit(0x1A))) == ["FULL_WAKE_LOCK", "SCREEN_BRIGHT_WAKE_LOCK"]
    assert ask(scalars.flag_types(F.lit(0x10000001))) == ["ACQUIRE_CAUSES_WAKEUP", "PARTIAL_WAKE_LOCK"]
    assert ask(scalars.elapsed_seconds(F.lit("2m3.5s"))) == 123.5 and ask(scalars.elapsed_seconds(F.lit("soon"))) is None
    assert ask(scalars.factorial(F.lit(5))) == 120
    assert [ask(scalars.floor_log2(F.lit(n))) for n in (1, 2, 3, 1024)] == [0, 1, 1, 10]
    assert [ask(scalars.ceil_log2(F.lit(n))) for n in (1, 2, 3, 1024)] == [0, 1, 2, 10]
    assert [ask(scalars.is_power_of_2(F.lit(n))) for n in (0, 1, 6, 8)] == [False, True, False, True]
    assert ask(scalars.pack_ints(F.lit(1), F.lit(-1))) == (1 << 32) | 0xFFFFFFFF

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphfacts.llm import bpe, exact, licences, neighbours, packing, passages, quality, sharding, simhash, warc

TOKENIZER = corpus_pipeline.TOKENIZER
LONG = "one two three four five six seven eight nine ten. " * 4000
# names that the operators use themselves, in another case or as they are
EXTRA = ", kept string, keep_id string, label string, words string, class string, `KEY` string, ids string, n_chars long, _id string, fp string"
LABELS = [(1, 1, 0), (2, 0, 0), (3, 1, 0), (5, None, 0), (None, 1, 1), (6, 0, 1), (6, 1, 1)]


def table(spark, rows, extra=True):
    padded = [(i, t, *(["x"] * 7), 1, "x", "y") for i, t in rows] if extra else rows
    return spark.createDataFrame(padded, "doc_id long, text string" + (EXTRA if extra else ""))


ROWS = [(1, "A text."), (2, None), (3, ""), (None, "A text."), (None, None), (4, " \t\n"), (5, LONG), (1, "A text."), (6, "a  TEXT. \x00 é")]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "licences": lambda spark, d: licences.scan(d),
    "packing": lambda spark, d: packing.packed_documents(d, TOKENIZER),
    "quality": lambda spark, d: quality.quality(d, labels(spark)),
    "exact": lambda spark, d: exact.exact_duplicates(d),
    "sharding": lambda spark, d: sharding.assign(d),
    "bpe": lambda spark, d: bpe.round_trip_digests(d, TOKENIZER),
    "passages": lambda spark, d: passages.repeated_passages(d),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    found = OPERATORS[name](spark, table(spark, ROWS)).collect()
    if name == "passages":
        assert {r["doc_id"] for r in found} == {5}  # the long text repeats itself; rows without identifier take no part
    elif name == "packing":
        assert sorted(str(r["doc_id"]) for r in found if r["start"] == 0) == sorted(str(i) for i, _ in ROWS)
    else:
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_null_values(spark):
    d = table(spark, ROWS, extra=False)
    assert {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) for r in licences.scan(d).collect() if r["doc_id"] in (2, 3, 4)} == {
        (i, 0, 0, None, "", 0.0) for i in (2, 3, 4)}
    same = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(d).collect()}
    assert (2, 2, 3, True) in same and (3, 2, 3, False) in same and (None, 2, 3, False) in same and (None, 1, 3, False) in same and (4, 4, 1, True) in same
    near = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(d).collect()}
    assert {(2, "0" * 16, 2), (3, "0" * 16, 2), (4, "0" * 16, 2)} <= near
    alone = exact.exact_duplicates(table(spark, [(None, "x"), (None, "x")], extra=False)).collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in alone] == [(None, 2, True)] * 2
    scores = {r["doc_id"]: r["score"] for r in quality.quality(d, labels(spark).limit(0)).collect()}
    assert set(scores.values()) == {0.5}
    packed = packing.packed_documents(d, TOKENIZER).filter("doc_id = 2").collect()
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in packed] == [(0, 1, 1)]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_cases(spark, tmp_path, stage):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    d = table(spark, ROWS)
    out = f(spark, d, str(tmp_path))
    if stage != "packing":
        assert out.columns == d.columns and out.schema["n_chars"].dataType == d.schema["n_chars"].dataType
    out.collect()
    assert f(spark, d.limit(0), str(tmp_path)).collect() == []
    if stage in ("exact_dedup", "simhash"):
        left = [r["doc_id"] for r in out.collect()]
        assert left.count(1) == 1 and left.count(5) == 1 and left.count(2) == 1 and left.count(3) == 0


PASSAGE = " ".join(f"again{i}" for i in range(60)) + "."
OTHERS = [" ".join(f"{name}{i}" for i in range(70)) + "." for name in ("one", "two", "three", "four", "five", "six")]


@pytest.mark.parametrize("stage", ["exact_dedup", "simhash", "passages"])
def test_stages_lose_no_distinct_text(spark, tmp_path, stage):
    """Distinct texts without identifier, or under one, all stay as they are."""
    rows = [(None, OTHERS[0]), (None, OTHERS[1]), (None, OTHERS[2]), (1, OTHERS[3]), (1, OTHERS[4]), (2, OTHERS[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)[stage](spark, d, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted((i or 0, t) for i, t in rows)


@pytest.mark.parametrize("stage", ["exact_dedup", "simhash"])
def test_copies_go_whatever_their_identifier(spark, tmp_path, stage):
    rows = [(None, OTHERS[0]), (None, OTHERS[0]), (7, OTHERS[1]), (7, OTHERS[1]), (7, OTHERS[2]), (3, OTHERS[2]), (None, OTHERS[2]), (9, OTHERS[1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)[stage](spark, d, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted([(0, OTHERS[0]), (7, OTHERS[1]), (3, OTHERS[2])])


def test_passages_of_texts_that_share_an_identifier(spark, tmp_path):
    """One text of an identifier takes part, the other stays whole; neither is cut at the other's places."""
    rows = [(1, PASSAGE + " " + OTHERS[0]), (2, PASSAGE + " " + OTHERS[1]), (2, OTHERS[2] + " " + OTHERS[3])]
    out = dict(corpus_pipeline.STAGES)["passages"](spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    got = {(r["doc_id"], r["text"].strip()) for r in out}
    assert (1, rows[0][1]) in got and (2, rows[2][1]) in got and len(out) == 3
    assert got - {rows[0], rows[2]} in ({(2, OTHERS[1])}, {rows[1]})


def test_neighbours_of_each_length(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(60, [1.0, 2.0, 3.0, 4.0])]
    found = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40} and len(found) == 9
    for r in found:
        assert r["score"] == sum(a * b for a, b in zip(rows[r["query_id"]][1], rows[r["vec_id"]][1]))
    best = sorted(((-sum(a * b for a, b in zip(rows[20][1], v)), i) for i, v in rows[:60] if i != 20))[:3]
    assert sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 20) == [(k + 1, i) for k, (_, i) in enumerate(best)]


def test_words_of_any_length_are_scored_whole():
    long = "ab" * 5000
    assert set(quality.indicators(long)) != set(quality.indicators(long + "XY9" * 400))


def test_pages(spark):
    big = "é" * 700  # 1400 bytes
    rows = [(1, "http://a b/", big, "x"), (2, None, big, "x"), (3, "u", None, "x"), (4, "u", "", "x"), (None, "u", big, "x"), (5, "u", "small", "x"), (6, "u", "small", "x"), (2, None, big, "x"),
            (7, "u", "WARC/1.0\r\n\r\n" + "\n" * 1200 + "filedesc: 1\n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    found = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert found == {(1, 1400, "revisit", 2), (2, 1400, "response", None), (3, 0, "response", None), (4, 0, "response", None), (None, 1400, "revisit", 2),
                     (5, 5, "response", None), (6, 5, "response", None), (7, 1224, "response", None)}
    assert warc.round_trip(pages).count() == len(rows)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1),
            (7, [1.0, 0.0], 1), (8, [-1.0, 0.0], 1), (9, [2.0], 1), (0, [1.0, 0.0], 1), (10, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").withColumn("score", F.lit("x"))
    found = neighbours.neighbours(vectors, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 7, 1.0), (0, 2, 1, 0.5), (0, 3, 8, -1.0)]
    assert neighbours.neighbours(vectors.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert neighbours.neighbours(vectors.filter("vec_id = 0"), F.col("vec_id") % 5 == 0).collect() == []

"""Passages found and cut whole, against plain Python that does not use the operator's own paragraphs."""

import random

from graphfacts.llm import passages


def words(n, rnd):
    return " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_unique_short_lines_between_repeats_stay(spark):
    rnd = random.Random(21)
    head, foot, menu = words(15, rnd) + ".\n", words(15, rnd) + ".\n", "home\nabout us\n"
    long_head, long_foot = words(40, rnd) + ".\n", words(40, rnd) + ".\n"
    other, last = words(40, rnd) + ".\n", words(40, rnd) + ".\n"
    unique = ["".join(words(3, rnd) + "\n" for _ in range(200)) for _ in range(4)]
    texts = [head + unique[0] + foot, head + unique[1] + foot, long_head + unique[2] + long_foot, long_head + unique[3] + long_foot,
             other + menu + last, other + menu + last]
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs_of(spark, texts)).collect()}
    assert left[1] == texts[1] and left[3] == unique[3]
    assert left[4] == texts[4] and 5 not in left  # short lines that stand in the copy that stays as well go with the run


def covered(texts, exact=50):
    """By document, the words that stand in a run of ``exact`` words found before, in an earlier document or place."""
    seen, out = set(), {}
    for i, text in texts.items():
        w, hit = text.lower().split(), set()
        for k in range(len(w) - exact + 1):
            if (g := tuple(w[k:k + exact])) in seen:
                hit.update(range(k, k + exact))
            seen.add(g)
        out[i] = hit
    return out


def assert_found(spark, texts):
    texts = dict(enumerate(texts))
    rows = passages.repeated_passages(docs_of(spark, texts.values())).collect()
    for i, hit in covered(texts).items():
        words_, at, marked = texts[i].split(), 0, set()
        for k, w in enumerate(words_):
            at = texts[i].index(w, at)
            if any(r["doc_id"] == i and r["removed"] and r["start"] <= at and at + len(w) <= r["stop"] for r in rows):
                marked.add(k)
            at += len(w)
        stretch = 0  # what stays of a repeated stretch is shorter than a run
        for k in range(len(words_) + 1):
            stretch = stretch + 1 if k in hit and k not in marked else 0
            assert stretch < passages.RUN, (i, k)
        assert marked <= hit
        assert not hit or marked
    return rows


def test_passages_of_short_lines_and_glued_sentences(spark):
    rnd = random.Random(22)
    lines = "".join(words(7, rnd) + ".\n" for _ in range(8))  # 56 words, none in a sentence of eight
    glued = " ".join(words(n, rnd) + "." for n in (18, 19, 18))
    least = words(50, rnd)
    texts = []
    for p in (lines, glued, least):
        texts += [words(rnd.randrange(5, 40), rnd) + " " + p + " " + words(rnd.randrange(5, 40), rnd) for _ in range(3)]
    texts.append(words(49, rnd) + " " + " ".join(words(49, rnd) for _ in range(2)))
    rows = assert_found(spark, texts)
    assert {r["doc_id"] for r in rows if r["removed"]} == {1, 2, 4, 5, 7, 8} and {r["doc_id"] for r in rows if not r["removed"]} >= {0, 3, 6}
    assert {r["keep_doc_id"] for r in rows} == {0, 3, 6}


def test_windows_share_a_sample():
    rnd = random.Random(23)
    passage = words(50, rnd)
    for _ in range(200):
        a, b = (passages.sampled(passages.hashed(words(rnd.randrange(60), rnd) + " " + passage + " " + words(rnd.randrange(60), rnd)))[1] for _ in "ab")
        assert set(a.tolist()) & set(b.tolist())


def test_passages_in_stretches_without_sentence_end(spark):
    rnd = random.Random(24)
    texts = []
    for n in (50, 51, 60, 80, 100, 300):
        p = words(n, rnd)
        texts += [words(rnd.randrange(90, 200), rnd) + " " + p + " " + words(rnd.randrange(90, 200), rnd) for _ in range(2)]
    rows = assert_found(spark, texts)
    assert {r["doc_id"] for r in rows if r["removed"]} == {1, 3, 5, 7, 9, 11}
    assert {r["keep_doc_id"] for r in rows} == {0, 2, 4, 6, 8, 10}

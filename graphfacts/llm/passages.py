"""Repeated passages found by MinHash banding of short paragraphs.

A passage may stand anywhere in a text, so paragraphs are cut finer than at line ends: at sentence ends too, and where
a stretch has neither, at words picked by their hash, which are the same in every copy. Equal paragraphs are one class;
classes that collide in a band of their MinHash signatures are compared by exact Jaccard similarity of word shingles,
and linked classes form components of which the first paragraph stays. What repeats is reported in runs of neighbouring
paragraphs, so a passage of several sentences is one row; short runs are left alone.

Passages of EXACT words and more are found wherever they begin and end: each document names, for every EXACT words in a
row, the least hash of its GRAM-word windows, so equal passages share one at the same place. Around those that recur,
all windows of EXACT words are compared; what of them lies outside the runs of paragraphs is reported too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from graphfacts.llm.shared import classes, remembers, sieved, text_key, text_of, unused, working
from graphfacts.plans import tables

SHINGLE, SIMILAR, RECALL, ROWS = 5, 0.8, 0.99, 2
#: Words of the shortest paragraph compared, words above which a paragraph is cut further, and about how many words
#: such a cut leaves together.
LEAST, LONG, EVERY = 8, 64, 24
#: Words of the shortest run that is reported and removed. Single lines that many pages share are shorter.
RUN = 30
#: Words from which an identical passage is found wherever it stands, and words of the windows that are sampled.
EXACT, GRAM = 50, 26

# A single mark ends a sentence; where every word bears several, they end nothing.
END = re.compile(r"(?<![.!?])[.!?][\"')\]»”]*\s+|\n\s*")
WORD = re.compile(r"\S+")
KEEP_WORDS, FLUSH = 120_000, 50_000


def bands(similar: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` hashes by which two sets of the given similarity collide with the given probability."""
    return ceil(log(1 - recall) / log(1 - similar ** rows))


class Hashes(dict):
    """64-bit hashes of words, kept for the words that recur."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = Hashes()
remembers("passages", _hashes.clear)


def pieces(text: str, long: int = LONG, every: int = EVERY) -> list[tuple[int, int, list[str]]]:
    """``(start, stop, words)`` of all paragraphs, short ones too: every word is in one. Words are lower-cased."""
    if len(_hashes) > KEEP_WORDS:
        _hashes.clear()
    out, start = [], 0
    for stop in [*(m.end() for m in END.finditer(text)), len(text)]:
        words = text[start:stop].lower().split()
        if len(words) > long:
            first, held = None, []
            for m in WORD.finditer(text, start, stop):
                first = m.start() if first is None else first
                held += m[0].lower().split()
                if _hashes[m[0].lower()] % every == 0:
                    out.append((first, m.end(), held))
                    first, held = None, []
            if held:
                out.append((first, stop, held))
        elif words:
            out.append((start, stop, words))
        start = stop
    return out


def paragraphs(text: str, least: int = LEAST, long: int = LONG, every: int = EVERY) -> list[tuple[int, int, list[str]]]:
    """``(start, stop, words)`` of the paragraphs of at least ``least`` words; words are lower-cased."""
    return [p for p in pieces(text, long, every) if len(p[2]) >= least]


def signatures(sizes: np.ndarray, words: np.ndarray, n_bands: int, rows: int = ROWS, shingle: int = SHINGLE) -> np.ndarray:
    """The band keys of word lists of at least ``shingle`` hashed words each, given one after the other, one row per list."""
    mixed = np.zeros(len(words) - shingle + 1, np.uint64)
    for k in range(shingle):  # polynomial in the words, so that order counts
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k:len(words) - shingle + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words from here to the end of the unit
    kept = mixed[left[:len(mixed)] >= shingle]
    starts = begins - np.arange(len(sizes)) * (shingle - 1)
    draw = np.random.default_rng(1)
    keys = np.zeros((len(sizes), n_bands), np.uint64)
    for b in range(n_bands):
        for _ in range(rows):
            a, c = (int(x) for x in draw.integers(1, 1 << 63, 2))
            turned = kept * np.uint64(2 * a + 1 & (1 << 64) - 1) + np.uint64(c)
            turned ^= turned >> np.uint64(31)
            turned *= np.uint64(0x94D049BB133111EB)
            least = np.minimum.reduceat(turned, starts)
            keys[:, b] = (keys[:, b] ^ (keys[:, b] >> np.uint64(30))) * np.uint64(0x9E3779B97F4A7C15) + least
        keys[:, b] += np.uint64(b)
    return keys.view(np.int64)


PLACES = ("unit", "start", "stop", "word", "n_words", "n_short", "short", "class")


def read(docs: DataFrame, n_bands: int) -> DataFrame:
    """One row for each of :func:`own_texts`, read once: as parallel arrays its compared paragraphs and its sampled windows.

    ``unit`` counts the compared paragraphs of a document, ``word`` the words before, ``class`` hashes the normalised
    ``body``, ``short`` the ``n_short`` words between the compared paragraph before and this one; ``b0``... are its band keys.
    ``at``, ``end`` and ``gram`` are :func:`sampled` windows.
    """
    ints, longs = ["unit", "start", "stop", "word", "n_words", "n_short"], ["short", "class", *[f"b{b}" for b in range(n_bands)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("passages")
        rows: list[tuple] = []
        words: list[np.ndarray] = []
        bodies: list[str] = []
        grams: list[tuple[np.ndarray, ...]] = []
        ids, counts, held = [], [], 0

        def lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)

        def made() -> pa.RecordBatch:
            table = np.array(rows, np.uint64).reshape(-1, 6)
            sizes = np.array([len(w) for w in words], np.int64)
            keys = signatures(sizes, np.concatenate(words), n_bands) if words else np.zeros((0, n_bands), np.int64)
            name = np.array([xxhash.xxh64_intdigest(b.encode("utf-8", "surrogatepass")) for b in bodies], np.uint64).view(np.int64)
            columns_ = [*(pa.array(table[:, c].astype(np.int32)) for c in range(4)), pa.array(sizes.astype(np.int32)), pa.array(table[:, 4].astype(np.int32)),
                        pa.array(table[:, 5].copy().view(np.int64)), pa.array(name), *[pa.array(k) for k in np.ascontiguousarray(keys.T)], pa.array(bodies, pa.string())]
            at = [len(g[0]) for g in grams]
            found = [pa.array(np.concatenate(c)) for c in zip(*grams)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *[lists(c, counts) for c in columns_], *[lists(c, at) for c in found]],
                ["doc_id", *ints, *longs, "body", "at", "end", "gram"])

        for batch in batches:
            docs_, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            for i in range(batch.num_rows):
                n, word, between = 0, 0, []
                own = pieces(texts[i].as_py())
                hashes = np.array([_hashes[w] for _, _, ws in own for w in ws], np.uint64)
                for start, stop, ws in own:
                    first, word = word, word + len(ws)
                    if len(ws) < LEAST:
                        between += ws
                        continue
                    rows.append((n, start, stop, first, len(between), xxhash.xxh64_intdigest(" ".join(between).encode("utf-8", "surrogatepass"))))
                    n, between = n + 1, []
                    words.append(hashes[first:word])
                    bodies.append(" ".join(ws))
                places, keys = sampled(hashes)
                if n or len(places):
                    ids.append(docs_[i].as_py())
                    counts.append(n)
                    grams.append((places.astype(np.int32), np.minimum(places + EXACT, len(hashes)).astype(np.int32), keys.view(np.int64)))
                    held += word
                if held >= FLUSH:
                    yield made()
                    rows, words, bodies, grams, ids, counts, held = [], [], [], [], [], [], 0
        if ids:
            yield made()

    rows_ = own_texts(docs)
    kind = to_arrow_type(rows_.schema["doc_id"].dataType)
    types = [*[f"{c} array<int>" for c in ints], *[f"{c} array<long>" for c in longs], "body array<string>", "at array<int>", "end array<int>", "gram array<long>"]
    return rows_.mapInArrow(run, f"doc_id {rows_.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{t.split()[0]}` {t.split()[1]}" for t in types))


def shared_ids(docs: DataFrame) -> tables.Written:
    """``(id, own)`` of the identifiers that several texts share: the key of the text that takes part under it."""
    keys = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"))
    return tables.write(keys.groupBy("id").agg(F.min("key").alias("own"), F.max("key").alias("last")).filter("own < last").drop("last"))


def own_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the rows that take part: those with an identifier, and of texts that share one the first by
    their key."""
    rows, shared = text_of(docs).filter("doc_id IS NOT NULL"), shared_ids(docs)
    if not shared.rows:
        return rows
    return rows.join(shared.df, F.col("doc_id") == F.col("id"), "left").filter(
        F.col("own").isNull() | (F.col("own") == text_key(F.col("text")))).select("doc_id", "text")


def listed(read_: DataFrame, *names: str) -> DataFrame:
    """``doc_id`` and the named arrays of :func:`read`, one row for each place in them; no other array is scanned."""
    return read_.select("doc_id", F.inline(F.arrays_zip(*names)))


def shingles(body: Column, shingle: int = SHINGLE) -> Column:
    """The distinct hashed word shingles of a normalised paragraph."""
    words = F.split(body, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - shingle + 1),
                                        lambda i: F.xxhash64(F.array_join(F.slice(words, i, shingle), " "))))


def links(read_: DataFrame, n_bands: int, similar: float = SIMILAR) -> DataFrame:
    """``(a, b)``: classes of :func:`read` paragraphs whose shingle sets have at least the given Jaccard similarity, of those that collide in a band.

    Equal paragraphs were made one class before, so copies do not meet here; the similarity is part of the join's
    condition, so only linked pairs leave a bucket.
    """
    names = [f"b{b}" for b in range(n_bands)]
    distinct = listed(read_, "class", *names).groupBy("class").agg(*[F.min(b).alias(b) for b in names])
    keyed = distinct.select("class", F.explode(F.array(*names)).alias("key"))
    bucket = Window.partitionBy("key")
    met = (keyed.withColumn("low", F.min("class").over(bucket)).withColumn("high", F.max("class").over(bucket))
           .filter("low <> high").select("key", F.col("class").alias("id")))
    met = tables.materialize(met)
    asked = met.select("id").distinct()
    maybe, _ = sieved(listed(read_, "class", "body").drop("doc_id"), "class", asked)
    bodies = maybe.distinct().join(asked, F.col("class") == F.col("id"), "left_semi").groupBy("class").agg(F.min("body").alias("body"))
    sets = tables.materialize(met.join(bodies.select(F.col("class").alias("id"), shingles(F.col("body")).alias("set")), "id"))
    a, b = (sets.select("key", F.col("id").alias(n), F.col("set").alias(f"set_{n}")) for n in "ab")
    both, together = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    near = (F.least(F.size("set_a"), F.size("set_b")) >= similar * F.greatest(F.size("set_a"), F.size("set_b"))) & (both >= similar * (together - both))
    return a.join(b, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def members(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """``(doc_id, unit, start, stop, word, n_words, n_short, class_id, keep_doc_id, removed, joined)``: every paragraph that has
    an equal or similar one. The first of a component, by identifier and place, stays. ``joined`` says that nothing, or
    the same short text as in the first and a further one, stands between the compared paragraph before and this one."""
    with tables.scope() as own:
        return own.keep(_members(tables.materialize(read(docs, bands(similar, recall))), similar, recall))


def _members(read_: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    near = classes(links(read_, bands(similar, recall), similar)).select(F.col("id").alias("class"), F.col("component").alias("class_id"))
    near = tables.materialize(near)
    places = listed(read_, *PLACES)
    counts = listed(read_, "class").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    repeated = (counts.filter("n > 1").join(near, "class", "full_outer")
                .select("class", F.coalesce("class_id", "class").alias("class_id")))
    found = tables.materialize(places.join(tables.materialize(repeated), "class").drop("class"))
    alike = found.groupBy("class_id", "short").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.count(F.lit(1)).alias("n"))
    first = alike.groupBy("class_id").agg(F.min(F.struct("at.doc_id", "at.start", "short", "n")).alias("first"))
    return (found.join(tables.materialize(first), "class_id")
            .select("doc_id", "unit", "start", "stop", "word", "n_words", "n_short", "class_id", F.col("first.doc_id").alias("keep_doc_id"),
                    (~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))).alias("removed"),
                    ((F.col("n_short") == 0) | (F.col("short") == F.col("first.short")) & (F.col("first.n") > 1)).alias("joined")))


BASE = 0x9E3779B97F4A7C13
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` word hashes, from prefix sums of a polynomial modulo 2 ** 64."""
    n = len(hashes)
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 15), base, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers[0][:n], dtype=np.uint64)])
    out = (sums[size:] - sums[:-size]) * _powers[1][:n - size + 1]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(29)


def hashed(text: str) -> np.ndarray:
    """The hashes of the text's lower-cased words."""
    if len(_hashes) > KEEP_WORDS:
        _hashes.clear()
    return np.array([_hashes[w] for w in text.lower().split()], np.uint64)


def sampled(hashes: np.ndarray, exact: int = EXACT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of windows of ``gram`` words, one at least in every ``exact`` words in a row, where equal words
    choose equal places."""
    if len(hashes) < exact:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, span = windows(hashes, gram), exact - gram + 1
    least = _rolled(np.minimum, grams, span)
    edge = np.zeros(span - 1, np.uint64)
    places = np.flatnonzero(_rolled(np.maximum, np.concatenate([edge, least, edge]), span) == grams)
    return places, grams[places]


def _rolled(best: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    """``best`` of every ``size`` values in a row, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = best(values[step:], values[:-step])
        have += step
    return values


def _mapped(rows: DataFrame, each, extra: str, flush: int = FLUSH) -> DataFrame:
    """Rows ``doc_id`` and the columns that ``each(row)`` gives as arrays, for every row of a table with identifiers."""
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    names = ["doc_id", *[c.split()[0] for c in extra.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("passages")
        docs, held, n = [], [], 0

        def made() -> pa.RecordBatch:
            ids = [i for i, a in zip(docs, held) for _ in range(len(a[0]))]
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(np.concatenate(c)) for c in zip(*held)]], names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                arrays = each(row)
                if len(arrays[0]):
                    docs.append(row["doc_id"])
                    held.append(arrays)
                    n += len(arrays[0])
                if n >= flush:
                    yield made()
                    docs, held, n = [], [], 0
        if n:
            yield made()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {extra}")


def _repeats(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose long ``name`` occurs at two places, with the first of these by identifier and place."""
    first = (rows.groupBy(name).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max(F.struct("doc_id", "at")).alias("last"))
             .filter("first <> last").select(name, "first"))
    return rows.join(tables.materialize(first), name)


def exact_passages(docs: DataFrame, read_: DataFrame, runs: DataFrame, run: int = RUN, exact: int = EXACT) -> DataFrame:
    """What of the passages of at least ``exact`` words that occur word for word at two places lies outside the given
    ``runs``, in stretches of at least ``run`` words and with the columns of ``runs``; of a copy that goes, outside the
    runs that go. Words are compared in lower case and without regard to white space."""
    texts = own_texts(docs)

    def around(row: dict) -> tuple:
        hashes = hashed(row["text"])
        spans = [m.span() for m in WORD.finditer(row["text"])]
        at = np.unique(np.concatenate([np.arange(max(0, p - exact + GRAM), min(p, len(hashes) - exact) + 1) for p in row["places"]]))
        starts, stops = np.array(spans, np.int32).T
        return at.astype(np.int32), starts[at], stops[at + exact - 1], windows(hashes, exact)[at].view(np.int64)

    again = tables.materialize(listed(read_, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    maybe, _ = sieved(listed(read_, "at", "end", "gram"), "gram", again)
    grams = tables.materialize(maybe)
    later = tables.materialize(_repeats(grams, "gram").filter(F.struct("doc_id", "at") != F.col("first")).select("doc_id", "at", "end", "gram"))
    # Where less than a run lies between two runs that go, or before the first or after the last, nothing can be left.
    order = Window.partitionBy("doc_id").orderBy("word")
    ends = runs.filter("removed").select("doc_id", "word", (F.col("word") + F.col("n_words")).alias("last"))
    apart = F.coalesce(F.col("word") - F.lag("last").over(order) >= run, F.lit(True))
    gone = (ends.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order))
            .groupBy("doc_id", "island").agg(F.min("word").alias("word"), F.max("last").alias("last")))
    gone = tables.materialize(gone.groupBy("doc_id").agg(F.collect_list(F.struct("word", "last")).alias("gone")))
    at_end = F.col("end") < F.col("at") + exact
    inside = F.exists("gone", lambda r: ((r["word"] < run) | (r["word"] <= F.col("at") - (exact - GRAM))) & (
        (F.col("end") <= r["last"]) | at_end & (F.col("end") < r["last"] + run)))
    open_ = later.join(gone, "doc_id", "left").filter(~F.coalesce(inside, F.lit(False))).select("gram").distinct()
    places = grams.join(tables.materialize(open_), "gram", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    places = tables.materialize(places)
    maybe, _ = sieved(texts, "doc_id", places.select("doc_id"))
    full = tables.materialize(_mapped(
        maybe.join(places, "doc_id"), around, "at int, start int, stop int, class_id long"))
    found = (_repeats(full, "class_id").withColumn("removed", F.struct("doc_id", "at") != F.col("first"))
             .groupBy("doc_id").agg(F.collect_list(F.struct("at", "start", "stop", "removed", F.col("first.doc_id").alias("keep"), "class_id")).alias("found")))
    every = runs.groupBy("doc_id").agg(F.collect_list(F.struct("word", "n_words", "start", "stop", "removed")).alias("runs"))
    kind, names = to_arrow_type(runs.schema["keep_doc_id"].dataType), ["doc_id", "start", "stop", "n_words", "keep_doc_id", "class_id", "removed"]
    types = [kind, pa.int32(), pa.int32(), pa.int64(), kind, pa.int64(), pa.bool_()]

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("passages")
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc, found_, runs_ = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("doc_id", "found", "runs"))
                out += [(doc, *r) for r in outside(found_, runs_ or [], run, exact)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    plain = runs.drop("word")
    return found.join(every, "doc_id", "left").mapInArrow(left, plain.select(*names).schema)


def outside(found: list[dict], runs: list[dict], run: int, exact: int) -> list[tuple]:
    """``(start, stop, n_words, keep, class_id, removed)``: the stretches that a document's repeated windows cover
    outside its runs. Those that go are cut first; those that stay lie outside these as well."""
    out, taken = [], []
    for removed in (True, False):
        stretches = []  # [first word, word after the last, first character, character after the last]
        own = sorted((w for w in found if w["removed"] == removed), key=lambda w: w["at"])
        for w in own:
            if stretches and w["at"] <= stretches[-1][1]:
                stretches[-1][1::2] = w["at"] + exact, w["stop"]
            else:
                stretches.append([w["at"], w["at"] + exact, w["start"], w["stop"]])
        blocks = sorted(taken + [(r["word"], r["word"] + r["n_words"], r["start"], r["stop"]) for r in runs if r["removed"] or not removed])
        taken, k, low = [tuple(x) for x in stretches], 0, 0
        for first, last, start, stop in stretches:
            while low < len(blocks) and blocks[low][1] <= first:
                low += 1
            free = []
            for b in blocks[low:]:
                if b[0] >= last:
                    break
                if b[1] <= first:
                    continue
                if b[0] > first:
                    free.append((first, b[0], start, b[2]))
                first, start = b[1], b[3]
                if first >= last:
                    break
            if first < last:
                free.append((first, last, start, stop))
            for a, z, begin, end in free:
                while k + 1 < len(own) and own[k + 1]["at"] <= a:
                    k += 1
                if z - a >= run:
                    out.append((begin, end, z - a, own[k]["keep"], own[k]["class_id"], removed))
    return out


def repeated_passages(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, start, stop, n_words, keep_doc_id, class_id, removed)``: every run of at least ``run`` words of
    neighbouring repeated paragraphs, and what lies outside them of passages that are repeated word for word and
    have EXACT words or more; places in characters.

    ``removed`` says whether the run is to go; the run that stays is a row as well. ``keep_doc_id`` is the document
    that keeps the run's first paragraph, ``class_id`` that paragraph's component. Paragraphs too short to compare are
    part of a run that stands on both sides of them only if the same words stand there in the copy that stays; otherwise
    the run ends there. Null and empty texts have no paragraphs; rows that repeat an identifier and its text count as
    one document; of distinct texts under one identifier the first by its key takes part; rows without identifier
    take no part. Other columns are ignored; an empty table gives an empty result.
    """
    with tables.scope() as own:
        read_ = tables.materialize(read(docs, bands()))
        with tables.scope() as inner:
            runs = inner.keep(_runs(_members(read_), run))
        more = own.keep(exact_passages(docs, read_, runs, run))
        return own.keep(runs.drop("word")).unionByName(more)


def _runs(members_: DataFrame, run: int) -> DataFrame:
    found = members_.dropDuplicates(["doc_id", "start", "unit"])
    order = Window.partitionBy("doc_id", "removed").orderBy("unit", "start")
    goes_on = F.coalesce((F.lag("unit").over(order) == F.col("unit") - 1) & F.col("joined"), F.lit(False))
    found = found.withColumn("goes_on", goes_on).withColumn("island", F.sum((~F.col("goes_on")).cast("int")).over(order))
    runs = found.groupBy("doc_id", "removed", "island").agg(
        F.min(F.struct("unit", "start", "word", "keep_doc_id", "class_id")).alias("head"), F.max("stop").alias("stop"),
        F.sum(F.col("n_words") + F.when(F.col("goes_on"), F.col("n_short")).otherwise(0)).alias("n_words"))
    return runs.filter(F.col("n_words") >= run).select(
        "doc_id", F.col("head.start").alias("start"), "stop", "n_words", F.col("head.keep_doc_id").alias("keep_doc_id"),
        F.col("head.class_id").alias("class_id"), "removed", F.col("head.word").alias("word"))


def without_repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents without the runs that are to go, with all their columns; ``n_chars``, if there is one, is counted
    anew for texts that were cut. Documents of which nothing but white space is left go. Texts that took no part, being
    without identifier or not the first under theirs, stay whole."""
    name, runs, new, own = unused(docs, "_id", "_runs", "_cut", "_own")
    with tables.scope() as written:
        shared = shared_ids(docs)
        cuts = (repeated_passages(docs, run).filter("removed").groupBy(F.col("doc_id").alias(name))
                .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(runs)))  # bounded by the document
        cuts = cuts.join(shared.df, F.col(name) == F.col("id"), "left").select(name, runs, F.col("own").alias(own))
        gone = written.keep(cuts)

    # what lies between the runs, one after the other; places count characters on both sides
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["stop"])
    end = lambda i: F.when(i == F.size(runs), F.length("text")).otherwise(F.get(runs, i)["start"])
    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.substring(F.col("text"), begin(i) + 1, end(i) - begin(i))), "")

    whole = F.col(runs).isNull() | F.coalesce(F.col(own) != text_key(F.col("text")), F.lit(False))
    maybe, untouched = sieved(docs, "doc_id", gone.select(name))
    cleaned = (maybe.join(gone, F.col("doc_id") == F.col(name), "left")
               .withColumn(new, F.when(whole, F.col("text")).otherwise(cut)))
    cleaned = cleaned.filter(whole | (F.trim(F.regexp_replace(new, r"\s+", " ")) != ""))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(new))
    cleaned = cleaned.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in docs.columns])
    return untouched.unionByName(cleaned)

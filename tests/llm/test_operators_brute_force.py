"""Results against plain Python, the tokenizers library, and SQL."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphfacts.llm import bpe, exact, licences, neighbours, packing, passages, quality, queries, sharding, simhash, warc

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = corpus_pipeline.TOKENIZER
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, rnd, pool=4000):
    return " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))


def sentences(n, rnd, least=8, most=16):
    return " ".join(words(rnd.randint(least, most), rnd).capitalize() + "." for _ in range(n))


def signed(units):
    """Five band keys of each word list."""
    return passages.signatures(np.array([len(u) for u in units]), passages.hashed(" ".join(w for u in units for w in u)), 5)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def varied(rnd):
    """Clean texts, exact copies, near copies and shared passages, a third of all in one group of copies."""
    texts = [sentences(rnd.randint(3, 12), rnd) for _ in range(40)]
    texts += [texts[0]] * 30 + [texts[1].replace(" ", "\n ", 2), texts[1]]
    for _ in range(12):
        w = texts[2].split()
        w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    passage = sentences(6, rnd)
    for k in range(5):
        texts.append(words(20, rnd) + " " + passage + " " + sentences(4, rnd))
    rnd.shuffle(texts)
    return texts


def components(n, linked):
    name = list(range(n))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        name[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def simhash_plain(text):
    w = re.findall("[^\x20\x09-\x0D]+", text.translate(ASCII))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_classes(texts):
    fps = [simhash_plain(t) for t in texts]
    return fps, components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])


def test_simhash(spark):
    texts = varied(random.Random(1)) + ["", "one", "one two", "One TWO"]
    fps, part = simhash_classes(texts)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert found == {i: (f"{fps[i]:016x}", part[i]) for i in range(len(texts))}


def test_simhash_links_are_complete(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    expected = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    assert {(r["a"], r["b"]) for r in simhash.links(table).collect()} == expected and len(expected) > 300


def test_exact(spark):
    texts = varied(random.Random(2))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub("[\x20\x09-\x0D]+", " ", t)].append(i)
    expected = {i: (g[0], len(g), i == g[0], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for heavy, tracked in ((1000, 8192), (1, 64)):  # also with nearly everything on the shuffled side
        found = {r["doc_id"]: tuple(r)[1:] for r in exact.exact_duplicates(docs_of(spark, texts), heavy, tracked).collect()}
        assert found == expected


def test_frequent_values_are_found(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")).alias("k"))
    assert -7 in exact.frequent(keys, "k", 5, 64)


def test_lookup_table():
    names = [f"shard-{i:02d}" for i in range(64)]
    table = sharding.lookup_table(names)
    share = Counter(table)
    assert len(table) == sharding.SLOTS and max(share.values()) - min(share.values()) <= 1
    less = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, less) if a != names[-1])
    assert moved < 0.1 * len(table)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 6554)


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(3)
    pool = "thaeingrsou éß'ſ!1?#ΣİḰ­中한ᄀ가²½ \t\n\x1c\x1f\x85\xa0 　\U0001F600"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(60))) for _ in range(1500)] + ["ab" * 5000, "it's we'll<|endoftext|>end", None]
    codec = bpe.Codec(TOKENIZER, lambda ids: ids)
    for t in texts[:-1]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert [i for part in codec.encode(t) for i in part] == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for r in bpe.round_trip_digests(docs_of(spark, texts), TOKENIZER).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    few = docs_of(spark, texts[:50])
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(few, TOKENIZER), TOKENIZER).collect()}
    assert back == {i: library.decode(library.encode(texts[i], add_special_tokens=False).ids, skip_special_tokens=False) for i in range(50)}


def check_packed(rows, texts):
    """Every id once, sequences gapless, little padding; ``texts`` by identifier."""
    library = Tokenizer.from_file(TOKENIZER)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        piece = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(piece) > 0
    for i, own in ids.items():
        pieces = sorted((r["start"], r["length"]) for r in by_doc[i])
        assert [s for s, _ in pieces] == list(np.cumsum([0, *[n for _, n in pieces]])[:-1]) and sum(n for _, n in pieces) == len(own)
    padding = 0
    for own in by_sequence.values():
        placed = sorted((r["offset"], r["length"]) for r in own)
        total = sum(n for _, n in placed)
        assert [o for o, _ in placed] == list(np.cumsum([0, *[n for _, n in placed]])[:-1]) and total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    return padding / sum(map(len, ids.values()))


def test_packing(spark):
    rnd = random.Random(4)
    texts = [sentences(int(rnd.lognormvariate(2.3, 1)) + 1, rnd) for _ in range(400)] + ["", None, words(9000, rnd)]
    for pool in (packing.POOL, 20_000):
        rows = packing.packed_documents(docs_of(spark, texts).coalesce(1), TOKENIZER, pool).collect()
        assert check_packed(rows, dict(enumerate(texts))) < (0.01 if pool > 20_000 else 0.1)
    steps = defaultdict(lambda: defaultdict(int))
    for r in rows:
        steps[r["step_id"]][r["tier"]] += r["length"]
    assert all(len(s) == 1 and sum(s.values()) <= packing.STEP for s in steps.values())


def test_archives():
    rows = [("http://x/ y", b"HTTP/1.1 200 OK\r\n\r\n<p>\n\n1 0 x\n"), ("u", b""), ("v", b"\n\n\n")]
    for version in (1, 2):
        data = warc.arc_version(version, "a.arc") + b"\n" + b"".join(warc.arc_record(version, u, "20010203040506", "text/html", b, "a.arc") + b"\n" for u, b in rows)
        read = list(warc.read_arc(data))
        assert [r.body for r in read] == [b for _, b in rows] and read[0].url == "http://x/%20y" and read[1].date == "20010203040506"
        with pytest.raises(ValueError):
            list(warc.read_arc(data[:-5]))
        with pytest.raises(ValueError):
            list(warc.read_arc(data.replace(b"0.0.0.0", b"0.0.0.0 x")))
    with pytest.raises(ValueError):
        list(warc.read_arc(rows[0][1]))
    record = warc.warc_record("response", "u", "20010203040506", "<urn:uuid:1>", b"a\r\n\r\nb", b"\0" * 20, None) + b"\n"
    (head, block), (_, again) = warc.read_warc(record + record)
    assert block == again == b"a\r\n\r\nb" and head["warc-date"] == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(warc.read_warc(record[:-2]))


def licence_plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(ASCII))
    places, labels, score = [], set(), 0.0
    for t in licences.TEMPLATES:
        full, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(full)) if full[i:i + len(key)] == key)
        for p in range(len(w)):
            if w[p:p + len(key)] == key:
                share = sum(0 <= p - at + i < len(w) and w[p - at + i] == x for i, x in enumerate(full)) / len(full)
                score = max(score, share)
                labels |= {t.label} if share >= licences.COVERAGE else set()
                places += [p] if t.base else []
    base = {t.label for t in licences.TEMPLATES if t.base} & labels
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_licences(spark):
    rnd = random.Random(6)
    parts = [t.words for t in licences.TEMPLATES] + ["CC BY-NC 4.0.", "All rights reserved.", "ALL\nRIGHTS-RESERVED cc", "BY", "liKKense", "mit license", "été général", "Apache License"]
    texts = [" ".join(rnd.choice([rnd.choice(parts), words(3, rnd), "all rights", "general public"]) for _ in range(rnd.randrange(12))) for _ in range(200)]
    found = {r["doc_id"]: tuple(r)[1:] for r in licences.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        expected = licence_plain(t)
        assert found[i][:-1] == expected[:-1] and found[i][-1] == pytest.approx(expected[-1])


def passage_plain(texts):
    """Documents (by identifier) that hold, and those that should lose, a run of repeated paragraphs."""
    units = [(i, k, s, e, tuple(w)) for i, t in texts.items() for k, (s, e, w) in enumerate(passages.paragraphs(t or ""))]
    sets = [{w[i:i + 5] for i in range(len(w) - 4)} for *_, w in units]
    linked = [(a, b) for a in range(len(units)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    part = components(len(units), linked)
    size = Counter(part)
    marked = {(u[0], u[1]): (u[2], u[3], len(u[4]), n != part[n]) for n, u in enumerate(units) if size[part[n]] > 1}
    runs = []
    for i in texts:
        for removed in (False, True):
            run = []
            for k in range(10_000):
                m = marked.get((i, k))
                if m and m[3] == removed:
                    run.append(m)
                else:
                    if sum(x[2] for x in run) >= passages.RUN:
                        runs.append((i, run[0][0], run[-1][1], sum(x[2] for x in run), removed))
                    run = []
                    if k > 200:
                        break
    return sorted(runs)


def test_passages(spark):
    texts = dict(enumerate(varied(random.Random(7))))
    found = sorted((r["doc_id"], r["start"], r["stop"], r["n_words"], r["removed"]) for r in passages.repeated_passages(docs_of(spark, list(texts.values()))).collect())
    assert found == passage_plain(texts)


def test_sieve(spark):
    from graphfacts.llm.shared import sieved

    table = spark.range(20_000).selectExpr("id as k", "concat('v', id) as _bits")
    maybe, surely_not = sieved(table, "k", spark.range(0, 20_000, 50).selectExpr("id as other"))
    assert maybe.columns == table.columns and maybe.count() + surely_not.count() == 20_000
    assert maybe.filter("k % 50 = 0").count() == 400 and maybe.count() < 600
    assert sieved(table, "k", spark.range(0).selectExpr("id as other"))[0].count() == 0


def test_bands():
    assert passages.bands(0.8, 0.99, 2) == 5 and 1 - (1 - 0.8 ** 2) ** 5 >= 0.99
    rnd = random.Random(8)
    hit = 0
    for _ in range(300):
        w = words(40, rnd).split()
        other = [*w[:-4], *words(4, rnd).split()]  # 32 of 40 shingles
        a, b = signed([w, other])
        hit += bool((a == b).any())
        assert (signed([other, w])[1] == a).all()
    assert hit >= 290


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    d, l = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(d, l).join(l, "doc_id").filter("held_out").select("score", "predicted", F.col("quality").alias("y")).collect()
    y, s = np.array([r["y"] for r in rows]), np.array([r["score"] for r in rows])
    order = s.argsort().argsort() + 1
    up = y.sum()
    auc = (order[y == 1].sum() - up * (up + 1) / 2) / (up * (len(y) - up))
    assert auc > 0.97 and np.mean([r["predicted"] == r["y"] for r in rows]) > 0.95
    assert ((s >= 0) & (s <= 1)).all()


def test_labels_of_held_out_rows_are_not_read(spark):
    d = docs_of(spark, [f"good text {i}" if i % 2 else f"### BAD!! {i}" for i in range(60)])
    l = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = l.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.quality(d, l).collect() == quality.quality(d, turned).collect()
    assert {r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in quality.quality(d, l).collect()} == {True}


def test_dual_coordinate_descent_reaches_the_optimum():
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.integers(0, 30, 6)) for _ in range(80)]
    y = np.where([0 in r or 1 in r for r in rows], 1.0, -1.0)
    scale, cost = rnd.normal(size=30), np.full(80, 0.5)
    w, b = quality.fit_dual(rows, y, scale, cost, epochs=400)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = scale[r] / np.sqrt(len(r)), 1
    v = np.append(w, b)
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(loss(v) <= loss(v + 0.01 * rnd.normal(size=31)) + 1e-6 for _ in range(300))


def test_neighbours(spark):
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(12, 16))
    x = (centres[rnd.integers(0, 12, 1500)] + 0.6 * rnd.normal(size=(1500, 16))) * rnd.uniform(0.5, 2, (1500, 1))
    x[::3] = x[0]  # a third of all rows
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    small = neighbours.CELL
    neighbours.CELL = 100
    try:
        found = neighbours.neighbours(vectors, F.col("vec_id") % 20 == 0).collect()
    finally:
        neighbours.CELL = small
    mine = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        mine[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), rel=1e-12)
    right = 0
    for q in range(0, 1500, 20):
        score = (x * x[q]).sum(1)
        best = [i for i in sorted(range(1500), key=lambda i: (-score[i], i)) if i != q][:20]
        right += len(set(best) & set(mine[q]))
        assert len(mine[q]) == 20
        if q % 3 == 0:
            assert mine[q] == best  # ties of equal vectors go to the smaller identifier
    assert right / (75 * 20) >= 0.9


def test_chi_square():
    rnd = np.random.default_rng(2)
    for degrees in (2, 8, 10):
        point = neighbours.chi_square_point(0.9, degrees)
        assert ((rnd.normal(size=(40_000, degrees)) ** 2).sum(1) <= point).mean() == pytest.approx(0.9, abs=0.01)


def test_pipeline(spark, tmp_path):
    rnd = random.Random(10)
    good, bad = varied(rnd), ["#### " + words(30, rnd).upper().replace(" ", "!! ") for _ in range(25)]
    texts = dict(enumerate(rnd.sample(good + bad, len(good) + len(bad))))
    label = {i: int(not t.startswith("####")) for i, t in texts.items()}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in label.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {i: t for i, t in texts.items() if label[i]}
    seen = set()
    for i, t in sorted(left.items()):
        if (t := re.sub("[\x20\x09-\x0D]+", " ", t)) in seen:
            del left[i]
        seen.add(t)
    ids = sorted(left)
    _, part = simhash_classes([left[i] for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if part[k] == k}
    for i, start, stop, _, removed in sorted(passage_plain(left), reverse=True):
        if removed:
            left[i] = left[i][:start] + left[i][stop:]
    left = {i: t for i, t in left.items() if t.strip()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(left)
    check_packed(rows, left)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    r = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in r.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, r.fetchall()))

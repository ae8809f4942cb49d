"""Personal data against the contract's patterns, and the label model against votes of known reliability."""

import hashlib
import random
import re

import numpy as np

from graphfacts.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    each = [int(c) for c in digits[::-1]]
    return (sum(each[::2]) + sum(sum(divmod(2 * v, 10)) for v in each[1::2])) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_plain_patterns_on_random_text():
    rnd = random.Random(1)
    pieces = ["a", "Z9", "@", ".", "..", "-", "+", "1", "23", "255", "300", " ", "  ", "(", ")", "é", "\n", "4111111111111111", "+1 (407) 555-7710", "x@y.z", "10.0.0.1", "_", "%", "٣", "a.b@c-d.e"]
    for _ in range(20_000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert pii.certain(text) == plain(text), text


def test_wider_proposals_touch_nothing():
    rnd = random.Random(2)
    pieces = ["4111111111111111", "+1 (407) 555-7710", "(407) 555-7710", " ", " ", "a (at) b.com", "a [at] b [dot] org", "1:2:3:4:5:6:7:8", "10.0.0.1", "x", "12", "407-555-7710", "4111-1111-1111-1111"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))
        spans = sorted([(s, e) for s, _, e in pii.certain(text)])
        more = [(s, e) for s, _, e in pii.wider(text, pii.certain(text))]
        for s, e in more:
            assert all(e <= a or b <= s for a, b in spans) and text[s:e].strip()
        assert all(a[1] <= b[0] for a, b in zip(more, more[1:]))


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "1 " * 200_000, "@" * 100_000, "a@" * 100_000, "(at)" * 50_000, "1:" * 200_000, "a.b" * 100_000 + "@"):
        pii.proposals(text)


def test_label_model_finds_reliable_labelers():
    rnd = np.random.default_rng(3)
    truth = rnd.random(20_000) < 0.4
    right = (0.95, 0.9, 0.55, 0.8, 0.7, 0.85)
    counts = {}
    for y in truth:
        v = "".join("+" if (rnd.random() < p) == y else "-" for p in right)
        counts[v] = counts.get(v, 0) + 1
    labels = pii.aggregate([(2, v, n) for v, n in counts.items()])
    assert np.abs(np.array(labels.reliability[2]) - right).max() < 0.03
    assert pii.aggregate([]).likely == {}


def test_classifier_learns_soft_labels():
    weights = pii.train([([1, 5], 0.95)] * 50 + [([2, 5], 0.05)] * 50)
    score = lambda f: weights[f].sum() + weights[-1]
    assert score([1, 5]) > 1 and score([2, 5]) < -1
    assert not pii.train([]).any()


def test_spans_of_documents(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("etaoins") for _ in range(rnd.randint(2, 8)))
    filler = lambda: " ".join(word() for _ in range(rnd.randint(3, 20)))
    card = lambda: next(c for c in (f"4{rnd.randrange(10 ** 15):015d}" for _ in range(999)) if luhn(c))
    phone = lambda: f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randrange(10 ** 4):04d}"
    texts = [f"{filler()} {rnd.choice([card, phone, lambda: f'{word()}@mail.com', lambda: f'81.{rnd.randint(1, 255)}.7.9'])()} {filler()}" for _ in range(300)]
    texts += [f'token = "{"".join(rnd.choice("0123456789abcdef") for _ in range(12))}{rnd.randrange(10 ** 15):015d}ab"' for _ in range(60)]
    near = [f"{filler()} {phone()} {card()} {filler()}" for _ in range(20)]  # the plain patterns see one number too long
    special = ["", None, "é " * 60_000 + "a@b.c 10.0.0.1", near[0], near[0]]
    rows = list(enumerate(texts + near + special)) + [(None, "x@y.zz"), (5, "10.1.1.1"), (5, "10.1.1.1")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.personal_data(docs).collect()
    want = []
    for i, t in rows:
        base = plain(t or "")
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        want.append((i, *(sum(b[1] == k for b in base) for k in range(4)), hashlib.sha256(",".join(shown).encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    spans = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in got}
    for i, t in rows[:len(texts)]:
        assert [tuple(x.split(":")) for x in spans[i]] == [(pii.KINDS[k], str(s), str(e)) for s, k, e in plain(t)] or i == 5
    for i in range(len(texts), len(texts) + len(near)):
        assert [x.split(":")[0] for x in spans[i]] == ["phone", "card"]
    assert pii.personal_data(docs.limit(0)).collect() == []
    assert {r["spans"] for r in pii.personal_data(docs.filter("text = ''")).collect()} == {""}

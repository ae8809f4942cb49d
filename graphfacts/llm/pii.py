"""Personal data found by weak supervision.

Plain patterns find what certainly counts. Wider ones propose further spans: numbers that a neighbouring number ran into, national
telephone numbers, addresses written with "(at)", version 6 addresses. Labelers vote on every proposal: the plain pattern, its check
digits, gazetteers, the words before it, its neighbours, its layout. How often each combination of votes occurs is
counted over all documents; expectation-maximisation over these counts estimates how reliable each labeler is and how
likely each combination means personal data. A logistic classifier of the spans' own features learns those likelihoods
and decides about the wider proposals.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfacts.llm.shared import columns, text_of, working
from graphfacts.plans import tables

KINDS = ("email", "ip", "card", "phone")
#: The bound of the classifier's sample: proposals of the smallest hashes.
SAMPLE, FEATURES, ACCEPT = 20_000, 1 << 12, 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A dotted quad can only begin where a run of digits does: one that fails there fails at its later digits, too.
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider proposals, all of bounded length.
LONG = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
CALL = re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|(?<![(0-9])[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SIX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
AT = re.compile(r"[ ]?[\[(][ ]?at[ ]?[\])][ ]?", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:[ ]?[\[(][ ]?dot[ ]?[\])][ ]?|\.)[A-Za-z0-9-]{1,63})+", re.I)

# Endings of mail domains, first digits and lengths of card numbers, calling codes, words that announce.
ENDINGS = frozenset("com org net edu gov mil int info biz name io co uk de fr es it nl be ch at pl pt se no dk fi ie eu us ca mx br ar cl au nz jp cn in ru example".split())
CARDS = {"4": (13, 16, 19), "5": (16,), "2": (16,), "34": (15,), "37": (15,), "6": (16, 17, 18, 19), "30": (14,), "36": (14,), "38": (14,)}
CALLING = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
           "351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 852 880 886 966 971 972").split()
ANNOUNCE = {
    "email": frozenset("mail email e-mail contact contacto kontakt courriel correo write schreiben reach from to cc".split()),
    "ip": frozenset("ip address host server client login connected adresse dirección serveur".split()),
    "card": frozenset("card visa mastercard amex credit debit payment carte tarjeta karte kreditkarte".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono handy".split()),
}
DENY = frozenset("token sha md5 hash uuid isbn issn doi version release build id commit checksum serial order invoice ticket key secret".split())


def runs_of(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with an ``@``, leftmost first: what precedes the sign up to the last match, and a dotted domain."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(span: str) -> str:
    return "".join(c for c in span if c in "0123456789")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def certain(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain patterns' matches that pass their checks, in order."""
    out = [(s, 0, e) for s, e in runs_of(text)]
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end()) for m in QUAD.finditer(text) if all(map(small, m.group().split(".")))]
        for m in DIGITS.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


def wider(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further proposals that touch no span of ``taken`` and, the longest first where they meet, not each other."""
    found = []
    for m in AT.finditer(text):
        before = BEFORE_AT.search(text[max(0, m.start() - 64):m.start()])
        after = AFTER_AT.match(text, m.end())
        if before and after:
            found.append((m.start() - len(before.group()), 0, after.end()))
    if any(c in text for c in "0123456789"):
        found += [(m.start(), 1, m.end()) for m in SIX.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in LONG.finditer(text)]
        found += [(m.start(), 3, m.end()) for m in CALL.finditer(text)]
    if not found:
        return []
    # sweep in order: of proposals that meet, the longer one stays
    free: list[tuple[int, int, int]] = []
    held, at = sorted((s, e) for s, _, e in taken), 0
    for s, kind, e in sorted(found):
        while at < len(held) and held[at][1] <= s:
            at += 1
        if at < len(held) and held[at][0] < e:
            continue
        if free and free[-1][2] > s:
            if e - s <= free[-1][2] - free[-1][0]:
                continue
            free.pop()
        free.append((s, kind, e))
    return free


WORD = re.compile(r"[^\W\d_](?:[^\W_]|-)*")


def context(text: str, start: int) -> list[str]:
    """The words of the 40 characters before a span, the nearest first."""
    return [w.lower() for w in WORD.findall(text[max(0, start - 40):start])][::-1]


def sign(good: bool, bad: bool) -> int:
    return int(good) - int(bad)


def votes(text: str, start: int, kind: int, end: int, base: bool) -> str:
    """One of ``+``, ``-`` and ``0`` by each labeler: plain pattern, check digits, gazetteer, context, neighbours, layout."""
    span, digits = text[start:end], digits_of(text[start:end])
    words = context(text, start)[:4]
    left, right = text[start - 1:start] if start else " ", text[end:end + 1] or " "
    six = kind == 1 and ":" in span
    parts = span.split(".")
    if kind == 0:
        ending = span[span.rfind(".") + 1:].lower() if "." in span else re.split(r"[^a-z0-9-]+", span.lower())[-1]
        check, place = ending.isalpha() and len(ending) >= 2, sign(ending in ENDINGS, not ending.isalpha())
        layout = sign(span[0] not in ".-%+", ".." in span)
    elif kind == 1:
        check = six or all(p == str(int(p)) for p in parts)
        place = 0 if six else sign(parts[0] not in ("0", "127", "255"), parts[0] == "0")
        layout = 0 if six else sign(True, right == "." and text[end + 1:end + 2].isdigit())
    elif kind == 2:
        check = luhn(digits)
        known = any(digits.startswith(p) and len(digits) in n for p, n in CARDS.items())
        place, layout = sign(known, not known), sign(len(set(digits)) > 3, len(set(digits)) <= 2)
    else:
        check = 10 <= len(digits) <= 15
        place = sign(any(digits.startswith(c) for c in CALLING), False) if span[0] == "+" else sign(digits[0] in "23456789", digits[:3] == "000")
        layout = sign("(" in span or "-" in span or " " in span, "." in span and span.count(".") == 1)
    near = sign(any(w in ANNOUNCE[KINDS[kind]] for w in words), any(w in DENY for w in words))
    edge = sign(left in " \t\n\r([<,;:\"'" and right in " \t\n\r)]>,;:\"'.!?", left.isalnum() or right.isalnum() or left in "_=/#" or right in "_=/#")
    return "".join("-0+"[v + 1] for v in (1 if base else 0, 1 if check else -1, place, near, edge, layout))


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Hashed features of a span and its surroundings."""
    span, digits = text[start:end], digits_of(text[start:end])
    form = re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", span[:128])))
    kind_of = lambda c: "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c or "$"
    name = KINDS[kind]
    found = [f"{name}", f"form {name} {form}", f"digits {name} {len(digits)}", f"length {name} {(end - start) // 4}",
             f"left {name} {kind_of(text[start - 1:start] if start else '')}", f"right {name} {kind_of(text[end:end + 1])}",
             f"first {name} {digits[:1]}", f"check {name} {luhn(digits) if kind == 2 else len(span.split('.'))}"]
    found += [f"word {name} {w}" for w in context(text, start)[:3]]
    return sorted({crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in found})


FOUND = "proposals array<struct<start:int, kind:int, stop:int, base:boolean, votes:string, features:array<int>>>"
_PROPOSAL = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def proposals(text: str) -> list[dict]:
    base = certain(text)
    every = sorted([(*x, True) for x in base] + [(*x, False) for x in wider(text, base)])
    return [{"start": s, "kind": k, "stop": e, "base": b, "votes": votes(text, s, k, e, b), "features": features(text, s, k, e)} for s, k, e, b in every]


def proposed(docs: DataFrame) -> DataFrame:
    """``(doc_id, proposals)``, one row per input row; a null text is empty."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = text_of(docs)
    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pii")
        for doc, texts in columns(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array([proposals(t) for t in texts], _PROPOSAL)], ["doc_id", "proposals"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


class Labels(NamedTuple):
    """How likely each combination of votes means personal data, and each labeler's share of right votes by kind."""

    likely: dict[tuple[int, str], float]
    reliability: dict[int, list[float]]


def aggregate(counts: list[tuple[int, str, int]], steps: int = 100) -> Labels:
    """Expectation-maximisation over ``(kind, votes, rows)``: labelers vote independently given the truth, each kind with
    its own rates. Begins with the majority of votes; a kind without proposals has no entry."""
    likely: dict[tuple[int, str], float] = {}
    reliability: dict[int, list[float]] = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = sorted((v, n) for k, v, n in counts if k == kind)
        ballots = np.array([["-0+".index(c) for c in v] for v, _ in own])
        rows = np.array([n for _, n in own], float)
        score = (ballots - 1).sum(1)
        truth = 1 / (1 + np.exp(-1.5 * score))
        for _ in range(steps):
            before = truth
            share = np.clip((rows @ truth + 1) / (rows.sum() + 2), 0.01, 0.99)
            log = np.log(share) - np.log(1 - share) + np.zeros(len(own))
            for j in range(ballots.shape[1]):
                # smoothed towards labelers that are right more often than not
                yes, no = np.array([0.5, 1.0, 2.0]), np.array([2.0, 1.0, 0.5])
                for v in range(3):
                    yes[v] += rows[ballots[:, j] == v] @ truth[ballots[:, j] == v]
                    no[v] += rows[ballots[:, j] == v] @ (1 - truth[ballots[:, j] == v])
                log += np.log(yes / yes.sum())[ballots[:, j]] - np.log(no / no.sum())[ballots[:, j]]
            truth = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            if np.abs(truth - before).max() < 1e-9:
                break
        right = np.where(ballots == 2, truth[:, None], 1 - truth[:, None]) * (ballots != 1) * rows[:, None]
        voted = ((ballots != 1) * rows[:, None]).sum(0)
        reliability[kind] = [float(a / b) if b else 0.5 for a, b in zip(right.sum(0), voted)]
        likely.update({(kind, v): float(t) for (v, _), t in zip(own, truth)})
    return Labels(likely, reliability)


def train(examples: list[tuple[list[int], float]], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier by gradient descent on soft labels; the last one is the constant."""
    weights = np.zeros(FEATURES + 1)
    if not examples:
        return weights
    row = np.repeat(np.arange(len(examples)), [len(f) + 1 for f, _ in examples])
    column = np.concatenate([[*f, FEATURES] for f, _ in examples])
    wanted = np.array([y for _, y in examples])
    speed = np.full(FEATURES + 1, 1e-8)
    for _ in range(steps):
        margin = np.bincount(row, weights[column], len(examples))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - wanted
        gradient = np.bincount(column, error[row], FEATURES + 1) / len(examples) + decay * weights
        speed += gradient ** 2
        weights -= rate * gradient / np.sqrt(speed)
    return weights


def decided(found: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Labels]:
    """The classifier of the written :func:`proposed` rows, and the labels it was trained on: votes are counted over all documents; at
    most ``sample`` proposals, those of the smallest hashes, train the weights."""
    each = found.select("doc_id", F.explode("proposals").alias("p"))
    counted = each.groupBy(F.col("p.kind").alias("kind"), F.col("p.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 3^6 rows
    labels = aggregate([(r["kind"], r["votes"], r["n"]) for r in counted])
    place = F.xxhash64(F.col("doc_id").cast("string"), "p.start", "p.kind", "p.stop")
    rows = each.select(place.alias("place"), "p.kind", "p.votes", "p.features").orderBy("place", "kind", "votes", "features").limit(sample).collect()
    return train([(r["features"], labels.likely[r["kind"], r["votes"]]) for r in rows]), labels


def personal_data(docs: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per input row.

    The counts and the digest are those of the plain patterns; ``spans`` has, besides them, the wider proposals that the
    classifier accepts, none of which overlaps another span. Offsets are code points. Null and empty texts have no spans; rows that
    repeat an identifier, and null ones, are judged one by one. Other columns are ignored; an empty table gives an
    empty result.
    """
    found = tables.materialize(proposed(docs))
    weights, _ = decided(found, sample)
    limit = float(np.log(accept / (1 - accept)))
    kind = found.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for ids, own in columns(batches, "doc_id", "proposals"):
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for some in own:
                name = lambda p: f"{KINDS[p['kind']]}:{p['start']}:{p['stop']}"
                base = [p for p in some if p["base"]]
                for k in range(4):
                    counts[k].append(sum(p["kind"] == k for p in base))
                digests.append(hashlib.sha256(",".join(map(name, base)).encode()).hexdigest())
                spans.append(",".join(name(p) for p in some if p["base"] or weights[p["features"]].sum() + weights[-1] >= limit))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, to_arrow_type(kind)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(run, f"doc_id {kind.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")

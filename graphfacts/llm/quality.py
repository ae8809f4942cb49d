"""Quality scores by Naive Bayes support vectors.

Each text becomes a set of n-gram indicators: its words, the written shapes of its words (case, digits, marks,
length class) alone and in pairs and triples, repeated neighbours, and how much of the text each shape makes up. The
indicators are scaled by their class log-count ratios, and a linear hinge-loss model is fitted to the scaled indicators
by dual coordinate descent. Ratios and model come from a bounded sample of the labelled rows; scoring covers all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.llm.shared import remembers, text_of, working

#: Hashed indicators; the model is two arrays of this size whatever the corpus.
FEATURES = 1 << 18
#: The bound of the sample: the training rows are those labelled rows whose doc_id has the smallest hashes.
SAMPLE = 12_000
ALPHA, COST, EPOCHS = 1.0, 0.1, 8
ACCEPT = 0.7

KEEP_WORDS = 120_000
#: Longer words, such as a text without white space, are cut into consecutive pieces, each a word of its own.
LONGEST = 200
RUNS = re.compile(r"(.)\1+")


class Kinds(dict):
    """Characters by their kind: A upper, a other letters, 9 digits, marks as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return value


class Shapes(dict):
    """The hash of each written form; runs count as one, however long."""

    def __missing__(self, key: tuple[str, int]) -> int:
        kinds, length = key
        return crc32(f"shape {RUNS.sub(r'\1+', kinds)}{length}".encode("utf-8", "surrogatepass"))


class Codes(dict):
    """The hashes of words and of their shapes, kept for the words that recur."""

    def __missing__(self, word: str) -> int:
        key = (word.translate(_kinds), min(len(word), 24) // 8)
        form = _shapes[key]
        if len(word) <= 24:
            _shapes[key] = form
        value = self[word] = crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | form
        return value


_kinds, _shapes = Kinds(), Shapes()
_codes = Codes()
remembers("quality", lambda: (_codes.clear(), _shapes.clear()))


def indicators(text: str) -> np.ndarray:
    """The sorted distinct feature numbers of a whole text. An empty text has one feature of its own."""
    words = text.split()
    if not words:
        return np.array([crc32(b"no words") % FEATURES], np.int32)
    if len(text) > LONGEST and any(len(w) > LONGEST for w in words):
        words = [w[at:at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]
    n = len(words)
    if len(_codes) > KEEP_WORDS:
        _codes.clear()
        _shapes.clear()
    codes = np.array([_codes[w] for w in words], np.uint64)
    word, form = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    mix = np.uint64(0x9E3779B97F4A7C15)
    parts = [word * mix, form * mix + np.uint64(1), (form[:-1] * np.uint64(31) + form[1:]) * mix + np.uint64(2),
             ((form[:-2] * np.uint64(31) + form[1:-1]) * np.uint64(31) + form[2:]) * mix + np.uint64(3)]
    shapes, counts = np.unique(form, return_counts=True)
    share = (-np.log2(counts / n)).astype(np.uint64)  # half, a quarter, ... of the words
    parts.append((shapes * np.uint64(64) + share) * mix + np.uint64(4))
    repeats = int((word[1:] == word[:-1]).sum())
    parts.append(np.array([int(np.log2(repeats / n * 1024 + 1)), n.bit_length() + 32], np.uint64) * mix + np.uint64(5))
    distinct = int(8 * len(np.unique(word)) / n)
    parts.append(np.array([distinct * 64 + n.bit_length()], np.uint64) * mix + np.uint64(6))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - 18)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """``weights`` (of FEATURES), ``bias``, and the slope and offset that turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(len(found)) + self.bias)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.offset, -40, 40))))


def ratios(positive: np.ndarray, negative: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """The log ratio of the smoothed, normalised class counts of each feature."""
    p, q = positive + alpha, negative + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_dual(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7):
    """Weights and bias of the linear hinge-loss model on the indicators scaled by ``scale``, by dual coordinate
    descent: one multiplier per row, each visit solves its own bounded problem exactly. The bias is one more input."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] / np.sqrt(len(r)) for r in rows]
    norms = np.array([v @ v for v in values]) + 1.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, r, v = labels[i], rows[i], values[i]
            gradient = y * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                w[r] += step * v
                bias += step
    return w, bias


def calibrate(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the margins, by Newton steps on smoothed targets."""
    up, down = positive.sum(), (~positive).sum()
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model from the training rows (labels 1 and 0) and their class counts per feature. The logistic curve comes
    from a quarter of the rows, left out of a first fit. With one class only, or no rows, every score is one share."""
    if not len(rows) or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.5
        return Model(np.zeros(FEATURES), 0.0, 1e-6, float(np.log((share * len(rows) + 1) / ((1 - share) * len(rows) + 1))))
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == c]), minlength=FEATURES) for c in (0, 1)]
    scale = ratios(counts[1].astype(float), counts[0].astype(float))
    y = np.where(labels == 1, 1.0, -1.0)
    # both classes weigh the same in the loss
    cost = np.where(labels == 1, 1.0, (labels == 1).sum() / max(1, (labels == 0).sum())) * COST

    def trained(keep: np.ndarray) -> tuple[np.ndarray, float]:
        w, b = fit_dual([rows[i] for i in keep], y[keep], scale, cost[keep])
        return w * scale, b

    part = np.arange(len(rows)) % 4 == 3
    if part.any() and len(set(labels[part])) == 2 and len(set(labels[~part])) == 2:
        w, b = trained(np.flatnonzero(~part))
        m = Model(w, b, 1.0, 0.0)
        left = np.flatnonzero(part)
        slope, offset = calibrate(np.array([m.margin(rows[i]) for i in left]), labels[left] == 1)
    else:
        slope, offset = 1.0, 0.0
    w, b = trained(np.arange(len(rows)))
    return Model(w, b, slope, offset)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the identifier as text leaves 2 when divided by four."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled documents, none held out. Rows without identifier, quality or text
    row are passed over; of several labels of one document the smallest counts. The features of the sample, some 4 kB
    a row, come to the driver; ``sample`` bounds them."""
    chosen = (labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
              .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        working("quality")
        return pa.array((indicators(t.as_py()) for t in texts), pa.list_(pa.int32()))

    rows = text_of(docs).join(F.broadcast(chosen), "doc_id").select("label", found("text").alias("found")).toArrow()
    lists = rows.column("found").combine_chunks()
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return fit([values[a:b] for a, b in zip(ends[:-1], ends[1:])], rows.column("label").to_numpy())


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Column:
    """The score of ``text`` as a column for ``docs``; the model of two fixed-size arrays is broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        working("quality")
        return pa.array((model.value.score(t.as_py()) for t in texts), pa.float64())

    return score(F.coalesce(F.col("text").cast("string"), F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    ``score`` lies between 0 and 1, higher where label 1 is likelier; only the text enters it, so equal texts have
    equal scores. Null and empty texts are scored as texts without words. Without usable labels every score is one
    half. Other columns are ignored; an empty table gives an empty result.
    """
    rows = text_of(docs)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(rows, labels, sample).alias("score")).withColumn(
        "predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The documents with a score of at least ``accept``, with all their columns; no shuffle."""
    return docs.filter(scored(docs, labels, sample) >= accept)

"""Centroid clustering over zone maps in the order of a space-filling curve.

Vectors become whole numbers and are laid out once along a Hilbert curve through the components that vary most. Neighbours on
the curve form blocks, each with its least and greatest value of every component. What these boxes say about distances leaves
each block the centroids that can be nearest to any of its vectors: a centroid is passed over when another one is nearer
everywhere in the box. The rest are compared exactly, block by block, as matrix products. A round reads the blocks once and
sends one partial sum for each centroid and task; only the centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfacts.plans import tables

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
BLOCK, AXES, BITS = 512, 8, 7
#: Components must stay below: squared distances of vectors of up to 128 components then fit a long.
LIMIT = 1 << 27
#: Up to this, products of 64 components are exact in double precision.
EXACT = 1 << 21


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells ``(rows, axes)`` with coordinates below ``2 ** bits``: consecutive places are
    neighbouring cells. Coordinates are turned into Gray-coded form and their bits interleaved; below 63 bits in all."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            set_ = (x[:, i] >> b) & 1 == 1
            swapped = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swapped)
            x[:, i] ^= swapped
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | (x[:, i] >> b) & 1
    return place


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box, in ascending order."""
    nearest = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    farthest = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    left = np.flatnonzero((nearest ** 2).sum(1) <= (farthest ** 2).sum(1).min())
    # the distance to the one nearest the middle less that to another is linear over the box: greatest in a corner
    some = centroids[left]
    best = some[((2 * some - low - high) ** 2).sum(1).argmin()]
    slope = 2 * (some - best)
    most = (best ** 2).sum() - (some ** 2).sum(1) + np.maximum(slope * low, slope * high).sum(1)
    return left[most >= 0]


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each vector of a block; ties to the smaller number."""
    left = candidates(low, high, centroids)
    some = centroids[left]
    if max(-low.min(), high.max(), np.abs(some).max()) <= EXACT and vectors.shape[1] <= 64:
        x, c = vectors.astype(np.float64), some.astype(np.float64)
        distances = ((x ** 2).sum(1)[:, None] - 2 * (x @ c.T) + (c ** 2).sum(1)).astype(np.int64)
    else:
        distances = np.stack([((vectors - c) ** 2).sum(1) for c in some], 1)
    which = distances.argmin(1)
    return left[which], distances[np.arange(len(vectors)), which]


def whole_numbers(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``(vec_id, q)``: vectors of ``width`` finite components, each as ``floor(scale * x)``."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") == width) & F.forall("x", finite))
    fits = F.forall("x", lambda v: F.abs(v * scale) < LIMIT)
    return rows.select("vec_id", F.when(fits, F.transform("x", lambda v: F.floor(v * scale).cast("int"))).otherwise(
        F.raise_error(F.lit(f"components of {LIMIT // scale} and more: squared distances do not fit a long"))).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _spread(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variance, least and greatest value of every component, over all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(width), np.zeros(width)
        low, high = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column(0), width)
                n, one, two = n + len(q), one + q.sum(0), two + (q.astype(float) ** 2).sum(0)
                low, high = np.minimum(low, q.min(0)), np.maximum(high, q.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({
                "d": pa.array(range(width), pa.int64()), "n": pa.array([n] * width, pa.int64()), "one": pa.array(one), "two": pa.array(two), "low": pa.array(low), "high": pa.array(high)})

    found = rows.select("q").mapInArrow(part, "d long, n long, one double, two double, low long, high long").groupBy("d").agg(
        F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    n, one, two, low, high = (np.array([r[c] for r in found]) for c in ("n", "one", "two", "low", "high"))
    return (two / n - (one / n) ** 2 if len(found) else two), low, high


BLOCKS = "ids array<long>, vectors binary, low array<int>, high array<int>"


def blocks(rows: DataFrame, width: int, size: int = BLOCK, axes: int = AXES, bits: int = BITS) -> DataFrame:
    """``rows(vec_id, q)`` as a written table of blocks of at most ``size`` neighbours on the curve, each with its box.

    Equal vectors share a place on the curve; the range partitions also cut by identifier and row, so they spread.
    """
    spread, least, greatest = _spread(rows, width)
    if not len(spread):
        return tables.materialize(rows.sparkSession.createDataFrame([], BLOCKS))
    chosen = np.argsort(-spread, kind="stable")[:axes]
    low, span = least[chosen], greatest[chosen] - least[chosen] + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = ((_matrix(b.column(1), width)[:, chosen] - low) << bits) // span
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hilbert(cells, bits))], ["vec_id", "q", "place"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def block(own: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
            ids = pa.concat_arrays([i for i, _ in own])
            q = np.concatenate([v for _, v in own])
            return pa.RecordBatch.from_pydict({
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "vectors": pa.array([q.astype("<i4").tobytes()], pa.binary()),
                "low": pa.array([q.min(0).tolist()], pa.list_(pa.int32())), "high": pa.array([q.max(0).tolist()], pa.list_(pa.int32()))})

        n = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                some = b.slice(at, min(size - n, b.num_rows - at))
                held.append((some.column(0), _matrix(some.column(1), width)))
                n, at = n + some.num_rows, at + some.num_rows
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    order = ["place", "vec_id", "row"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = rows.mapInArrow(place, "vec_id long, q array<int>, place long").withColumn("row", F.monotonically_increasing_id())
    return tables.materialize(lined.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "q").mapInArrow(gather, BLOCKS))


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array | None, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            ids, vectors, low, high = (b.column(b.schema.get_field_index(c))[k] for c in ("ids", "vectors", "low", "high"))
            yield ids.values, np.frombuffer(vectors.as_py(), "<i4").reshape(-1, width).astype(np.int64), np.array(low.as_py(), np.int64), np.array(high.as_py(), np.int64)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; those without any stay."""
    k, width = centroids.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, q, low, high in _each(batches, width):
            which, _ = nearest(q, low, high, centroids)
            counts += np.bincount(which, minlength=k)
            for c in np.unique(which):
                sums[c] += q[which == c].sum(0)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(own, pa.int64()), "n": pa.array(counts[own]), "sums": pa.array(sums[own].tolist(), pa.list_(pa.int64()))})

    total = packed.mapInArrow(part, "cluster long, n long, sums array<long>").groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(width)]).alias("sums")).collect()  # a row per centroid
    after = centroids.copy()
    for r in total:
        after[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return after


def assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    width = centroids.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q, low, high in _each(batches, width):
            which, distance = nearest(q, low, high, centroids)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(which.astype(np.int32)), "distance": pa.array(distance)})

    return packed.mapInArrow(part, "vec_id long, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per vector that takes part.

    Vectors that are null, of another length, or hold null or non-finite components take no part. The first centroids are
    the ``k`` vectors, or all if fewer, of least SHA-256 of ``seed:vec_id``; among rows that repeat an identifier, a null
    one counting as empty text, of least components. Every row of repeated ones counts. Components of 2^27 / ``scale`` and more raise an
    error, as distances would not fit a long. Other columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = whole_numbers(embeddings, width, scale)
    packed = blocks(rows, width)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = rows.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()  # the feature: k rows
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["q"] for r in start], np.int64)
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    found = tables.materialize(assigned(packed, centroids))
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    known = spark.createDataFrame([(c, d, total, digest(centroids[c])) for c, d in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> str:
    """The same by comparing every vector with every centroid in every round."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
        SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM kept ORDER BY h, q LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rn, min({{'d': d, 'c': c}}) AS m FROM (
        SELECT k.rn, c.c, list_sum(list_transform(list_zip(k.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k CROSS JOIN c{r} c) GROUP BY rn)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM (
            SELECT a.m.c AS c, j, sum(k.q[j]) AS s, count(*) AS n FROM a{r} a JOIN kept k ON k.rn = a.rn CROSS JOIN (SELECT unnest(range(1, {width + 1})) AS j) GROUP BY 1, 2) GROUP BY c) n ON n.c = c.c)""")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
       (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k ON k.rn = a.rn JOIN c{rounds} c ON c.c = a.m.c"""

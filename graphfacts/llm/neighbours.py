"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected to a few dimensions by a Gaussian matrix; for two vectors at distance d the squared projected
distance over d^2 is chi-square distributed. A kd-tree over the projections yields neighbours in order of projected
distance, leaf by leaf; they are verified against the original vectors, and the search ends when the chi-square distribution says
that a vector closer than the worst one kept would hardly lie so far out in the projection.

The upper levels of the tree cut the table into cells of bounded size that Spark shuffles; a task searches one block
of one cell for a bounded set of queries. A first round in a query's own block bounds its distance, and the same
chi-square test then names the cells it has to visit. Largest inner products become smallest distances by one more
coordinate that brings every vector to the greatest length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphfacts.plans import tables

DIMENSIONS, CONFIDENCE, SEED = 10, 0.97, 20
#: Rows aimed at in a block, most cells, and the sample of projected vectors that the cells are cut by.
CELL, CELLS, SAMPLE = 4096, 4096, 20_000
LEAF, FIRST, QUERY_BLOCKS, CHUNK = 64, 3, 16, 512


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_point(p: float, degrees: int) -> float:
    """Where the distribution function reaches ``p``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


class Space(NamedTuple):
    """The projection and the length every vector is brought to."""

    matrix: np.ndarray
    length: float

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length ** 2 - (vectors ** 2).sum(1), 0.0))
        return vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors * (self.length / np.sqrt((vectors ** 2).sum(1)))[:, None] @ self.matrix[:-1]

    def squared(self, products: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Squared distances that inner products with queries of the given lengths stand for."""
        return np.maximum(2 * self.length ** 2 - 2 * self.length * products / sizes, 0.0)


class Cells(NamedTuple):
    """The upper levels of the tree: the dimension and place of each cut, in heap order; leaves are cells."""

    dimension: np.ndarray
    place: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while len(self.place) and node[:1].size and node.min() < len(self.place):
            right = points[np.arange(len(points)), self.dimension[node]] > self.place[node]
            node = 2 * node + 1 + right
        return node - len(self.place)


def cut(points: np.ndarray, cells: int) -> Cells:
    """Median cuts of the widest dimension, to a power of two of cells."""
    inner = cells - 1
    dimension, place = np.zeros(inner, np.int64), np.zeros(inner)
    parts = {0: points}
    for node in range(inner):
        own = parts.pop(node)
        if len(own):
            d = int(np.argmax(own.max(0) - own.min(0)))
            dimension[node], place[node] = d, np.median(own[:, d])
        right = own[:, dimension[node]] > place[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return Cells(dimension, place)


def leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree: halves by rank in the widest dimension, so that equal points are split as well."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            done.append(own)
            continue
        held = points[own]
        d = int(np.argmax(held.max(0) - held.min(0)))
        order = np.argpartition(held[:, d], len(own) // 2)
        todo += [own[order[len(own) // 2:]], own[order[:len(own) // 2]]]
    return done


def search(space: Space, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
           bounds: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, id, product)`` of at most ``k`` neighbours of each query in one block.

    ``bounds`` are inner products that another block already reached ``k`` times (minus infinity if none did): what is
    below is not returned. ``reach`` is the chi-square point of the stopping test.
    """
    asked = space.queries(queries)
    points = space.points(vectors)
    tree = leaves(points)
    low = np.array([points[own].min(0) for own in tree])
    high = np.array([points[own].max(0) for own in tree])
    sizes = np.sqrt((queries ** 2).sum(1))
    slack, last = 1e-9 * space.length ** 2, np.iinfo(np.int64).max
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(queries), CHUNK):
        q = np.arange(first, min(first + CHUNK, len(queries)))
        gap = gaps(asked[q], low, high)
        best, best_id = np.full((len(q), k), -np.inf), np.full((len(q), k), last)
        worst = bounds[q].copy()

        def within(rows: np.ndarray, leaf: int) -> np.ndarray:
            """The test: a leaf whose projection lies beyond the reach of the worst neighbour kept is passed over."""
            known = np.isfinite(worst[rows])
            limit = np.where(known, reach * (space.squared(np.where(known, worst[rows], 0.0), sizes[q[rows]]) + slack), np.inf)
            return rows[gap[rows, leaf] <= limit]

        def verify(rows: np.ndarray, leaf: int) -> None:
            own = tree[leaf]
            product = queries[q[rows]] @ vectors[own].T
            rows = rows[product.max(1) >= worst[rows] - 1e-9 * np.maximum(np.abs(worst[rows]), space.length ** 2 * 1e-6)]
            if not len(rows):
                return
            # those that may enter are summed alike for every vector, so equal vectors tie exactly
            product = (vectors[own] * queries[q[rows]][:, None, :]).sum(2)
            name = np.broadcast_to(ids[own], product.shape)
            product[(name == query_ids[q[rows]][:, None]) | (product < bounds[q[rows]][:, None])] = -np.inf
            products, names = np.concatenate([best[rows], product], 1), np.concatenate([best_id[rows], name], 1)
            names[np.isinf(products)] = last
            top = np.lexsort((names, -products), axis=1)[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(products, top, 1), np.take_along_axis(names, top, 1)
            worst[rows] = np.maximum(best[rows, -1], bounds[q[rows]])

        # the nearest leaves first, so that the test has something to hold against; then whatever it lets through
        nearest = np.argsort(gap, 1, kind="stable")[:, :FIRST]
        for rank in range(nearest.shape[1]):
            for leaf in np.unique(nearest[:, rank]):
                if len(rows := within(np.flatnonzero(nearest[:, rank] == leaf), leaf)):
                    verify(rows, leaf)
        gap[np.arange(len(q))[:, None], nearest] = np.inf
        for leaf in np.argsort(gap.min(0), kind="stable"):
            if len(rows := within(np.flatnonzero(np.isfinite(gap[:, leaf])), leaf)):
                verify(rows, leaf)
        hit = np.isfinite(best)
        out.append((np.broadcast_to(q[:, None], best.shape)[hit], best_id[hit], best[hit]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def gaps(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of projected queries to boxes."""
    gap = np.zeros((len(asked), len(low)))
    for d in range(asked.shape[1]):
        x = asked[:, d][:, None]
        gap += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0.0) ** 2
    return gap


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` in double precision, without identifiers or vectors that are null, zero, or hold null or
    non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


HIT = "query_id long, vec_id long, score double"


def neighbours(embeddings: DataFrame, asked: Column, k: int = 20, confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row for which ``asked`` holds, the ``k`` rows found of largest inner
    product, itself excepted, nearest first, ties to the smaller identifier.

    Each true neighbour is missed with a probability of at most about ``1 - confidence``. Vectors that are null, zero or
    hold null or non-finite components take no part. A product exists between vectors of one length only, so each length
    is searched on its own. Rows that repeat an identifier count once for each of its distinct vectors, as candidates.
    Other columns are ignored; with no candidates a query has no rows, and an empty table gives an empty result.

    The cells are cut by a sample of at most SAMPLE rows; every row is indexed. The driver holds that sample and a box
    and a count for each of at most CELLS cells; cells that outgrow a block are split by hash.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings).distinct()
    lengths = rows.groupBy(F.size("vector").alias("width")).agg(
        F.count(F.lit(1)).alias("total"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).orderBy("width").collect()
    parts = [_of_one_length(rows.filter(F.size("vector") == n["width"]), asked, k, confidence, dimensions, **n.asDict()) for n in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_one_length(rows: DataFrame, asked: Column, k: int, confidence: float, dimensions: int, width: int, total: int, longest: float) -> DataFrame:
    spark = rows.sparkSession
    space = Space(np.random.default_rng(SEED).normal(size=(width + 1, dimensions)), float(np.sqrt(longest)))

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    cells = 1
    while cells < CELLS and cells * CELL < total:
        cells *= 2
    tree = cut(space.points(_matrix(sample.column("vector"), width)), cells)
    names = [f"p{d}" for d in range(dimensions)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                points = space.points(_matrix(b.column(1), width))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tree.of(points)), *map(pa.array, points.T)],
                                                 ["vec_id", "vector", "asked", "cell", *names])

    placed = rows.select("vec_id", "vector", F.coalesce(asked, F.lit(False)).alias("asked")).mapInArrow(
        place, "vec_id long, vector array<double>, asked boolean, cell long, " + ", ".join(f"{n} double" for n in names))
    placed = tables.materialize(placed)
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f.__name__ + n) for f in (F.min, F.max) for n in names]).orderBy("cell").collect()
    number = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f + n] for n in names] for b in boxes]) for f in ("min", "max"))
    split = np.array([-(-b["n"] // CELL) for b in boxes])
    base = np.cumsum(split) - split
    known = spark.createDataFrame([(int(c), int(b), int(s)) for c, b, s in zip(number, base, split)], "cell long, base long, split long")
    # at most CELLS rows; a block is a hashed part of a cell
    placed = placed.join(F.broadcast(known), "cell").select(
        "vec_id", "vector", "asked", "cell", (F.col("base") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("split"))).alias("block"))
    queries = placed.filter("asked").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "block")
    reach = chi_square_point(confidence, dimensions)

    def found(table: pa.Table, routed: pa.Table) -> pa.Table:
        if not table.num_rows or not routed.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query_ids = routed.column("query_id").to_numpy()
        which, ids, score = search(
            space, table.column("vec_id").to_numpy(), _matrix(table.column("vector"), width), query_ids,
            _matrix(routed.column("query"), width), routed.column("bound").to_numpy(), k, reach)
        return pa.table({"query_id": query_ids[which], "vec_id": ids, "score": score})

    def visit(routes: DataFrame) -> DataFrame:
        """The neighbours of routed queries ``(query_id, query, bound, block, part)`` in their blocks."""
        wanted = routes.select(F.col("block").alias("_block"), F.col("part").alias("_part")).distinct()
        data = placed.join(wanted, F.col("block") == F.col("_block")).select("vec_id", "vector", "block", F.col("_part").alias("part"))
        return data.groupBy("block", "part").cogroup(routes.groupBy("block", "part")).applyInArrow(found, HIT)

    part = F.floor(F.col("block") / QUERY_BLOCKS)
    nothing = F.lit(float("-inf"))
    at_home = tables.materialize(queries.select("query_id", "query", nothing.alias("bound"), "block", part.alias("part")))
    home = tables.materialize(visit(at_home))
    bounds = home.groupBy(F.col("query_id").alias("_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    started = (queries.join(bounds, F.col("query_id") == F.col("_id"), "left")
               .select("query_id", "query", F.when(F.col("n") >= k, F.col("least")).otherwise(nothing).alias("bound"), F.col("block").alias("home")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                some = b.slice(at, CHUNK)
                vectors = _matrix(some.column(1), width)
                points, bound, own = space.queries(vectors), some.column(2).to_numpy(), some.column(3).to_numpy()
                gap = gaps(points, low, high)
                sizes = np.sqrt((vectors ** 2).sum(1))
                with np.errstate(invalid="ignore"):
                    limit = np.where(np.isinf(bound), np.inf, reach * (space.squared(bound, sizes) + 1e-9 * space.length ** 2))
                q, c = np.nonzero(gap <= limit[:, None])
                q, c = np.repeat(q, split[c]), np.concatenate([base[j] + np.arange(split[j]) for j in c] or [np.zeros(0, np.int64)])
                other = c != own[q]
                q, c = q[other], c[other]
                taken = some.take(pa.array(q))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), taken.column(2), pa.array(c, pa.int64()), pa.array(own[q] // QUERY_BLOCKS, pa.int64())],
                    ["query_id", "query", "bound", "block", "part"])

    routes = tables.materialize(started.mapInArrow(route, "query_id long, query array<double>, bound double, block long, part long"))
    every = home.unionByName(visit(routes))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (every.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

"""Approximate nearest neighbours by a forest of random-projection trees.

The trees split on the direction between two sample vectors, at the median of the sample, and are fitted
on at most ``SAMPLE`` vectors; their size depends on the parameters only, so they are broadcast.
Every vector goes to one leaf of every tree. A query walks all trees with one priority queue: the
branch whose splitting planes lie nearest to the query is opened next, whichever tree it belongs to, until
the opened leaves hold ``SHARE`` of the vectors of one tree. Queries meet the vectors of these leaves
in blocks, exact distances are computed there, and only the best of a block go on.

Equal vectors become one before anything is dealt, so a vector that occurs very often fills no leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.session import cut

NEIGHBOURS = 10
TREES = 8
LEAVES = 256  # of one tree
SAMPLE = 8_192
SHARE = 1.0
BLOCK = 50_000  # vectors of a leaf in one task, about


class Forest:
    """Flat trees: for node i a direction, a threshold and two children; a child below zero is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 7):
        self.roots, self.directions, self.thresholds, self.children = [], [], [], []
        self.leaf_share: list[float] = []
        rng = np.random.default_rng(seed)
        size = max(8, len(sample) // leaves)

        def grow(own: np.ndarray) -> int:
            if len(own) >= 2 * size:
                a, b = sample[rng.choice(own, 2, replace=False)]
                line = a - b
                along = sample[own] @ line
                middle = float(np.median(along))
                if (along <= middle).any() and (along > middle).any():
                    node = len(self.children)
                    self.directions.append(line)
                    self.thresholds.append(middle)
                    self.children.append((0, 0))
                    self.children[node] = (grow(own[along <= middle]), grow(own[along > middle]))
                    return node
            self.leaf_share.append(len(own) / max(1, len(sample)))
            return -len(self.leaf_share)

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        self.lines = np.array(self.directions).reshape(len(self.children), sample.shape[1])
        self.norms = np.linalg.norm(self.lines, axis=1)

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distance of each vector to each splitting plane."""
        return (vectors @ self.lines.T - self.thresholds) / np.where(self.norms > 0, self.norms, 1)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        side = self.margins(vectors) > 0
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            kids = np.array(self.children).reshape(-1, 2)
            while (inner := np.flatnonzero(node >= 0)).size:
                node[inner] = kids[node[inner], side[inner, node[inner]].astype(int)]
            out[:, t] = -1 - node
        return out

    def search(self, margins: np.ndarray, share: float) -> list[int]:
        """The leaves that a query opens, by one queue over all trees."""
        queue = [(0.0, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(queue)
        found, held = [], 0.0
        while queue and held < share:
            far, tree, node = heapq.heappop(queue)
            while node >= 0:
                low, high = self.children[node]
                near, other = (high, low) if margins[node] > 0 else (low, high)
                heapq.heappush(queue, (max(far, abs(margins[node])), tree, other))
                node = near
            found.append(-1 - node)
            held += self.leaf_share[-1 - node]
        return found


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _deal(forest, blocks: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            cells = forest.value.leaves(_matrix(part.column(1)))
            for t in range(cells.shape[1]):
                yield pa.record_batch([pa.array(cells[:, t], pa.int64()), part.column(2), part.column(0), part.column(1)],
                                      ["cell", "block", "id", "vector"])

    return run


def _ask(forest, blocks: int, share: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 64):
                few = part.slice(start, 64)
                opened = [forest.value.search(m, share) for m in forest.value.margins(_matrix(few.column(1)))]
                for block in range(blocks):
                    row = np.repeat(np.arange(len(opened)), [len(x) for x in opened])
                    cells = np.concatenate([np.array(x, np.int64) for x in opened])
                    yield pa.record_batch([pa.array(cells), pa.array(np.full(len(row), block), pa.int32()),
                                           few.column(0).take(pa.array(row)), few.column(1).take(pa.array(row))],
                                          ["cell", "block", "id", "vector"])

    return run


def _rerank(keep: int):
    """The nearest vectors of a block of a leaf for every query that opened it."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            held, ids = _matrix(vectors["vector"]), vectors["id"].to_numpy()
            order = np.argsort(ids)
            held, ids = held[order], ids[order]
            for query, vector in zip(queries["id"].to_pylist(), _matrix(queries["vector"]), strict=True):
                score = np.sqrt(((held - vector) ** 2).sum(axis=1))
                best = np.argpartition(score, keep - 1)[:keep] if len(score) > keep else np.arange(len(score))
                best = np.flatnonzero(score <= score[best].max())  # all that tie with the last
                best = best[np.argsort(score[best], kind="stable")][:keep]
                out["query_id"] += [query] * len(best)
                out["id"] += ids[best].tolist()
                out["score"] += score[best].tolist()
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    return run


def nearest(rows: DataFrame, is_query, k: int = NEIGHBOURS, trees: int = TREES, leaves: int = LEAVES,
            sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """The ``k`` nearest rows of every query row of ``rows`` (vec_id, embedding; others are ignored).

    ``is_query`` is a condition on vec_id. Returns query_id, rank (from 1), vec_id, score (Euclidean
    distance in double precision), nearest first, ties to the smaller vec_id. A row takes no part if its
    vec_id or vector is null, the vector is all zero, holds a null or non-finite component, or has
    another length than most vectors (of equally frequent lengths the smaller counts). Rows that repeat a
    vec_id count once for each different vector, and never as neighbours of a query with that vec_id.
    An empty table gives no rows.
    """
    spark = rows.sparkSession
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    able = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    length = able.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    able = able.filter(F.size("vector") == length.n)
    distinct = cut(able.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    count = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()  # bounded by ``sample``
    forest = spark.sparkContext.broadcast(Forest(_matrix(drawn["vector"]), trees, leaves))
    blocks = max(1, -(-count // (leaves * BLOCK)))

    kind = distinct.schema["vector"].dataType.simpleString()
    schema = f"cell long, block int, id long, vector {kind}"
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    dealt = distinct.select("id", "vector", own).mapInArrow(_deal(forest, blocks), schema)
    asked = able.filter(is_query).distinct().select("vec_id", "vector").mapInArrow(_ask(forest, blocks, share), schema)
    found = (dealt.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block"))
             .applyInArrow(_rerank(k + 1), "query_id long, id long, score double"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("place", best).filter(
        F.col("place") <= k + 1).drop("place")

    several = distinct.filter("n > 1").select("vector", "id")
    first = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    copies = (able.join(several, "vector").select("id", "vec_id").distinct()
              .withColumn("place", first).filter(F.col("place") <= k + 1).drop("place"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.join(copies, "id", "left").withColumn("vec_id", F.coalesce("vec_id", "id"))
            .filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

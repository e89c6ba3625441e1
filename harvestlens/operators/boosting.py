"""Boosted regression trees for all crops and folds in one set of passes (M1-M4, M6).

Features are cut into at most ``BINS`` intervals and kept as one byte each. Rows of a model that are alike in every interval are a
cell: they go the same way in every tree. Growing a level of a tree takes sums over (model, node, feature, interval): how many rows
there are, and their residuals, both added up by cell once a tree. The splits follow from these sums alone, whose size depends on
the parameters. A model is a crop, or a crop without one fold. Residuals are summed as whole multiples of a small step, so that
sums are exact and a fit does not depend on how rows are dealt, beyond what the sketch of the intervals' borders does.

- Models of up to ``TASK_ROWS`` rows (known from their counts) are grown side by side, each by one task.
- Larger ones with up to ``CELLS`` cells of ``CELL_ROWS`` rows or more on average (counted) are tallied first: one pass over the rows says for each cell and tree how many rows
  are drawn and the sum of their targets. Partial tallies are added up, and a model is grown from its tally by one task. A tally's size
  is bounded by the parameters, rows are read once for all trees.
- The others are grown together from all their rows: one job per level adds up the sums of all tasks, model by model, and only the
  splits come to the driver. Cells with their predictions so far stay in executor storage; every few rounds they are
  checkpointed to the shared folder, so that a lost executor costs a few rounds. These passes are RDD code: numpy
  works on a whole partition at a time, and a query plan for each of thousands of levels would cost more than the level.

The first and the last give the same trees. A tally rounds targets and predictions to steps, the others their difference, so values may
differ by some steps, 1e-10 of the target's range.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import settle
from harvestlens.operators import ordered, reports
from harvestlens.session import cut, delete_path, shared_root

BINS = 64  # intervals of a feature
BLOCK_ROWS = 65_536  # rows in one block, and so in one step of numpy
TASK_ROWS = 262_144  # rows of a model that one task grows alone
CELLS = 4_096  # different rows of intervals up to which a larger model is grown from a tally, 6 KB each with 400 trees
CELL_ROWS = 8  # rows of a cell on average from which a tally is worth its size
TALLY_ROWS = 262_144  # rows that are tallied at a time
PENALTY = 1.0  # added to the row count of a leaf
KEPT_ROUNDS = 20  # rounds between checkpoints
QUANTILE_ACCURACY = 10_000
REMEMBERED_ROWS = 50_000  # rows of feature values whose results a task remembers
_MODEL_TABLE = ("crop string, version string, kind string, tree int, node int, feature string, threshold double, "
                "gain double, cover long, value double")


@dataclass
class CropModel:
    """Trees as flat arrays [tree, node]; the children of node i are 2i + 1 (feature <= threshold) and 2i + 2.

    ``feature`` is -1 at a leaf; ``value`` is what a leaf adds to ``base``; ``cover`` counts the rows a tree was grown on.
    """

    crop: str
    features: list[str]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    edges: list[np.ndarray] = field(default_factory=list)

    @property
    def version(self) -> str:
        """A name made from the contents."""
        parts = [self.crop, self.features, self.base, *(a.tobytes() for a in (self.feature, self.threshold, self.value))]
        return f"{zlib.crc32(pickle.dumps(parts, 4)):08x}"

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Base value and leaf values of all trees for rows of feature values."""
        trees, nodes = self.feature.shape
        # Below a leaf every row goes left, and the leaf's value with it.
        feature, value = np.maximum(self.feature, 0), self.value.copy()
        threshold = np.where(self.feature >= 0, self.threshold, np.inf)
        for i in range(nodes // 2):
            value[:, 2 * i + 1] = np.where(self.feature[:, i] >= 0, value[:, 2 * i + 1], value[:, i])
        depth = (nodes + 1).bit_length() - 2
        out = np.empty(len(x))
        step = max(1, 2_000_000 // max(1, trees))
        tree = np.arange(trees)[None, :]
        for start in range(0, len(x), step):
            rows = x[start : start + step]
            at = np.zeros((len(rows), trees), np.int64)
            row = np.arange(len(rows))[:, None]
            for _ in range(depth):
                at = 2 * at + 1 + (rows[row, feature[tree, at]] > threshold[tree, at])
            out[start : start + step] = self.base + value[tree, at].sum(axis=1)
        return out


def complete(features: list[str]) -> Column:
    test = F.lit(True)
    for f in features:
        test = test & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return test


def _spread(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Plan:
    """What growing trees needs to know, model by model."""

    names: list[str]
    edges: list[list[np.ndarray]]
    base: np.ndarray
    scale: np.ndarray
    features: list[str]
    params: dict

    def of(self, chosen: list[str]) -> Plan:
        at = [self.names.index(n) for n in chosen]
        return Plan(chosen, [self.edges[i] for i in at], self.base[at], self.scale[at], self.features, self.params)

    def allowed(self, name: str) -> list[np.ndarray]:
        """The features each tree of a model may split on."""
        width, p = len(self.features), self.params
        allowed = np.zeros((p["maxIter"], width), bool)
        for t in range(p["maxIter"]):
            draw = np.random.default_rng([p["seed"], zlib.crc32(name.encode()), t])
            allowed[t, draw.permutation(width)[: max(1, int(float(p["featureSubsetStrategy"]) * width))]] = True
        return list(allowed)

    def drawn(self, hashes: np.ndarray, t: int) -> np.ndarray:
        """Whether tree t sees the rows with these hashes."""
        salt = _spread(np.array([self.params["seed"] * 1_000_003 + t + 1], np.uint64))[0]
        return (_spread(hashes ^ salt) >> np.uint64(11)) < np.uint64(int(self.params["subsamplingRate"] * (1 << 53)))

    def numbered(self, part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Model and intervals of rows of (model, target, hash, features...)."""
        number = {name: i for i, name in enumerate(self.names)}
        coded = pa.chunked_array([part["__model"]]) if isinstance(part, pa.RecordBatch) else part["__model"]
        coded = coded.combine_chunks().dictionary_encode()
        known = np.array([number[m] for m in coded.dictionary.to_pylist()], np.int16)
        model = known[coded.indices.to_numpy()]
        bins = np.zeros((len(model), len(self.features)), np.uint8)
        places = [(m, np.flatnonzero(model == m)) for m in known.tolist()]
        for j in range(len(self.features)):
            x = part[f"__f{j}"].to_numpy()
            for m, at in places:
                bins[at, j] = np.searchsorted(self.edges[m][j], x[at], "left")
        return model, bins

    def block(self, part: pa.Table) -> dict:
        """Rows of (model, target, hash, features...) by cells, which have one byte per feature and the prediction so far."""
        model, bins = self.numbered(part)
        key = np.ascontiguousarray(np.hstack([bins, model.view(np.uint8).reshape(-1, 2)]))
        _, first, cell = np.unique(key.view(np.dtype((np.void, key.shape[1]))).ravel(), return_index=True, return_inverse=True)
        return {"model": model[first], "bins": bins[first], "at": self.base[model[first]],
                "cell": cell, "y": part["__y"].to_numpy(), "hash": part["__h"].to_numpy().view(np.uint64)}


def _exact(key: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit whole numbers by key; halves are added up, so that doubles hold them."""
    if not len(values) or float(np.abs(values).max()) * len(values) < 2.0**53:
        return np.bincount(key, values, size).astype(np.int64)
    high = values >> 26
    low = np.bincount(key, values - (high << 26), size).astype(np.int64)
    return (np.bincount(key, high, size).astype(np.int64) << 26) + low


def _ready(block: dict, t: int, plan: Plan) -> dict:
    """The block with the number and the residuals, in steps, of the rows that tree t draws from each cell."""
    scale, size = plan.scale[block["model"]], len(block["at"])
    if "tally" in block:
        n, total = (a[:, t] for a in block["tally"])
        return block | {"n": n, "residual": total - n * np.rint(block["at"] * scale).astype(np.int64)}
    drawn = plan.drawn(block["hash"], t)
    cell = block["cell"][drawn]
    residual = np.rint((block["y"][drawn] - block["at"][cell]) * scale[cell]).astype(np.int64)
    return block | {"n": np.bincount(cell, minlength=size), "residual": _exact(cell, residual, size)}


def _blocks(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows as packed blocks."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(plan.block(pa.Table.from_batches(part)))], pa.binary())], names=["block"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = BLOCK_ROWS - sum(b.num_rows for b in waiting)
                waiting.append(batch.slice(0, room))
                if batch.num_rows >= room:
                    yield block(waiting)
                    waiting = []
                batch = batch.slice(room)
        if waiting:
            yield block(waiting)

    return rows.mapInArrow(packed, "block binary")


def _walk(block: dict, feature: np.ndarray, interval: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Node of each cell after some levels, and whether it got down to that level."""
    model = block["model"]
    node, down, cell = np.zeros(len(model), np.int64), np.ones(len(model), bool), np.arange(len(model))
    for _ in range(levels):
        f = feature[model, node]
        down &= f >= 0
        right = block["bins"][cell, f] > interval[model, node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node, down


def _sums(blocks: Iterator[dict], feature: np.ndarray, interval: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Rows and residuals by [model, node, feature, interval] for all nodes of a level."""
    nodes, out = 1 << level, None
    for block in blocks:
        models, width = len(feature), block["bins"].shape[1]
        size = models * nodes * BINS
        if out is None:
            out = np.zeros((2, width, size), np.int64)
        node, down = _walk(block, feature, interval, level)
        at = np.flatnonzero(down & (block["n"] > 0))
        n, residual = block["n"][at], block["residual"][at]
        place = (block["model"][at].astype(np.int64) * nodes + node[at] - (nodes - 1)) * BINS
        for j in range(width):
            key = place + block["bins"][at, j]
            out[0, j] += np.bincount(key, n, size).astype(np.int64)
            out[1, j] += _exact(key, residual, size)
    if out is not None:
        yield out.reshape(2, width, models, nodes, BINS).transpose(0, 2, 3, 1, 4)


def _grow(plan: Plan, allowed, splits: Callable[[tuple, list], list[tuple]]) -> tuple[np.ndarray, ...]:
    """The next tree of every model: feature, interval, gain, cover and value by [model, node].

    ``splits`` gives what ``_split`` finds for every model in the sums of a level over all rows.
    """
    models, depth = len(plan.names), plan.params["maxDepth"]
    nodes = (1 << (depth + 1)) - 1
    feature, interval, cover = np.full((models, nodes), -1, np.int64), np.zeros((models, nodes), np.int64), np.zeros((models, nodes), np.int64)
    gain, value = np.zeros((models, nodes)), np.zeros((models, nodes))
    for level in range(depth):
        own, below = slice((1 << level) - 1, (2 << level) - 1), slice((2 << level) - 1, (4 << level) - 1)
        for m, (f, i, g, c, v, root) in splits((feature, interval, level), allowed):
            feature[m, own], interval[m, own], gain[m, own], cover[m, below], value[m, below] = f, i, g, c, v
            if level == 0:
                cover[m, 0], value[m, 0] = root
        if not (feature[:, own] >= 0).any():
            break
    return feature, interval, gain, cover, value


def _moved(block: dict, tree: tuple[np.ndarray, ...], depth: int) -> dict:
    """The block with the predictions after one more tree."""
    feature, interval, _, _, value = tree
    node, _ = _walk(block, feature, interval, depth)
    return block | {"at": block["at"] + value[block["model"], node]}


def _alone(own: Plan, blocks: list[dict]) -> pa.Table:
    """All trees of the only model of a plan, grown from blocks at hand."""
    trees, allowed, rate = [], own.allowed(own.names[0]), own.params["stepSize"]
    for t in range(own.params["maxIter"]):
        blocks = [_ready(b, t, own) for b in blocks]

        def splits(task: tuple, may: np.ndarray) -> list[tuple]:
            return [(0, _split(sum(next(_sums(iter([b]), *task)) for b in blocks)[:, 0], task[2], may, own.scale[0], rate))]

        trees.append(_grow(own, allowed[t], splits))
        blocks = [_moved(b, trees[-1], own.params["maxDepth"]) for b in blocks]
    return pa.table({"model": own.names, "trees": pa.array([pickle.dumps([np.concatenate(a) for a in zip(*trees)])], pa.binary())})


def _collected(grown: DataFrame, plan: Plan) -> list[np.ndarray]:
    found = {r.model: pickle.loads(r.trees) for r in grown.collect()}
    return [np.stack(a) for a in zip(*(found[n] for n in plan.names))]


def _grow_in_tasks(usable: DataFrame, plan: Plan) -> list[np.ndarray]:
    """All trees of every model, a model by one task; arrays by [model, tree, node]."""
    def grown(table: pa.Table) -> pa.Table:
        own = plan.of([table["__model"][0].as_py()])
        # Sums are exact, so the order in which the rows arrived does not matter.
        return _alone(own, [own.block(table.slice(i, BLOCK_ROWS)) for i in range(0, table.num_rows, BLOCK_ROWS)])

    dealt = usable.repartition(4 * len(plan.names), "__model")
    return _collected(dealt.groupBy("__model").applyInArrow(grown, "model string, trees binary"), plan)


def _cells(usable: DataFrame, plan: Plan) -> DataFrame:
    """Rows as (model, cell, target in steps, hash); a cell is the interval of every feature, a byte each."""
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, bins = plan.numbered(batch)
            y = np.rint(batch["__y"].to_numpy() * plan.scale[model]).astype(np.int64)
            cell = pa.Array.from_buffers(pa.binary(bins.shape[1]), len(bins), [None, pa.py_buffer(np.ascontiguousarray(bins))])
            yield pa.RecordBatch.from_arrays([batch["__model"], cell.cast(pa.binary()), pa.array(y), batch["__h"]], names=["model", "cell", "y", "hash"])

    return usable.mapInArrow(binned, "model string, cell binary, y long, hash long")


_TALLY = "model string, part long, cell binary, n binary, sum binary"


def _tally(model: pa.Array, part: pa.Array, cells: pa.Array, n: np.ndarray, total: np.ndarray) -> pa.Table:
    return pa.table([model, part, cells, pa.array([x.tobytes() for x in n], pa.binary()), pa.array([x.tobytes() for x in total], pa.binary())],
                    [x.split()[0] for x in _TALLY.split(", ")])


def _tallies(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cells of some partial tallies, and their sums."""
    cells = rows["cell"].combine_chunks().dictionary_encode()
    at = cells.indices.to_numpy()
    n, total = (np.stack([np.frombuffer(x, np.int64) for x in rows[c].to_pylist()]) for c in ("n", "sum"))
    out = np.zeros((2, len(cells.dictionary), n.shape[1]), np.int64)
    for row, cell in enumerate(at.tolist()):
        out[0, cell] += n[row]
        out[1, cell] += total[row]
    return cells.dictionary, out[0], out[1]


def _grow_from_tallies(cells: DataFrame, plan: Plan, rows: list[int]) -> list[np.ndarray]:
    """All trees of every model, from the sums that each cell has for each tree; arrays by [model, tree, node]."""
    spark, trees = cells.sparkSession, plan.params["maxIter"]

    def tallied(table: pa.Table) -> pa.Table:
        found = table["cell"].combine_chunks().dictionary_encode()
        at, size = found.indices.to_numpy(), len(found.dictionary)
        hashes, y = table["hash"].to_numpy().view(np.uint64), table["y"].to_numpy()
        n, total = np.zeros((2, trees, size), np.int64)
        for t in range(trees):
            drawn = plan.drawn(hashes, t)
            cell = at[drawn]
            n[t], total[t] = np.bincount(cell, minlength=size), _exact(cell, y[drawn], size)
        groups = table["groups"][0].as_py()
        part = pa.array([zlib.crc32(c) % groups for c in found.dictionary.to_pylist()], pa.int64())
        return _tally(pa.array([table["model"][0].as_py()] * size), part, found.dictionary, n.T, total.T)

    def added(table: pa.Table) -> pa.Table:
        cells, n, total = _tallies(table)
        first = [pa.array([table[c][0].as_py()] * len(cells)) for c in ("model", "part")]
        return _tally(*first, cells, n, total)

    def grown(table: pa.Table) -> pa.Table:
        own = plan.of([table["model"][0].as_py()])
        cells, n, total = _tallies(table)
        bins = np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(len(cells), -1)
        model = np.zeros(len(cells), np.int16)
        return _alone(own, [{"model": model, "bins": bins, "at": own.base[model], "tally": (n, total)}])

    groups = [(name, max(1, -(-n // TALLY_ROWS))) for name, n in zip(plan.names, rows)]
    dealt = cells.join(F.broadcast(spark.createDataFrame(groups, "model string, groups long")), "model").withColumn(
        "share", F.pmod(F.monotonically_increasing_id(), F.col("groups")))
    partial = dealt.repartition(sum(g for _, g in groups), "model", "share").groupBy("model", "share").applyInArrow(tallied, _TALLY)
    whole = partial.groupBy("model", "part").applyInArrow(added, _TALLY)
    return _collected(whole.repartition(4 * len(plan.names), "model").groupBy("model").applyInArrow(grown, "model string, trees binary"), plan)


def _grow_in_passes(usable: DataFrame, plan: Plan, rows: int) -> list[np.ndarray]:
    """All trees of all models together, a job for each level; arrays by [model, tree, node]."""
    spark, depth, rate, models = usable.sparkSession, plan.params["maxDepth"], plan.params["stepSize"], len(plan.names)
    packed = cut(_blocks(usable.repartition(max(1, -(-rows // BLOCK_ROWS))), plan))
    state = packed.rdd.map(lambda r: _ready(pickle.loads(r[0]), 0, plan)).persist(StorageLevel.MEMORY_AND_DISK)
    trees, before, kept = [], None, []
    allowed = [plan.allowed(name) for name in plan.names]

    def splits(task: tuple, may: list[np.ndarray]) -> list[tuple]:
        nonlocal before
        level, scale = task[2], plan.scale
        sums = state.mapPartitions(lambda blocks: ((m, found[:, m]) for found in _sums(blocks, *task) for m in range(models)))
        whole = sums.reduceByKey(lambda a, b: a + b, min(models, 64))
        found = whole.map(lambda x: (x[0], _split(x[1], level, may[x[0]], scale[x[0]], rate))).collect()
        if before is not None:  # the predictions are computed and stored by now
            before.unpersist()
            before = None
        return found

    for t in range(plan.params["maxIter"]):
        trees.append(_grow(plan, [own[t] for own in allowed], splits))
        before, state = state, state.map(lambda b, tree=trees[-1], t=t: _ready(_moved(b, tree, depth), t + 1, plan)).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % KEPT_ROUNDS == 0:
            state.checkpoint()
            kept.append(state)
            for old in kept[:-2]:  # the last but one may still be read
                delete_path(spark, old.getCheckpointFile())
            kept = kept[-2:]
    state.unpersist()
    for old in kept:
        if old.getCheckpointFile():
            delete_path(spark, old.getCheckpointFile())
    return [np.stack(a, axis=1) for a in zip(*trees)]


def fit_models(rows: DataFrame, features: list[str], *, model: str, target: str = "yield_bu_ac",
               params: dict | None = None, task_rows: int = TASK_ROWS) -> dict[str, CropModel]:
    """One model for each value of the column ``model``, fitted on its complete rows.

    A tree sees a share of the rows, drawn by a hash of all columns of a row, and a share of the features. Rows that are equal in
    every column are drawn together. A value of ``model`` without complete rows gets no model.
    """
    p = config.BOOSTING | (params or {})
    shared_root(rows.sparkSession)  # names the folder of the checkpoints
    plain = [f"`{c.name}`" for c in rows.schema if c.dataType.typeName() not in ("map", "variant") and c.name != model]
    known = F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")) & F.col(model).isNotNull()
    usable = cut(rows.where(complete(features) & known).select(
        F.col(model).cast("string").alias("__model"), F.col(target).cast("double").alias("__y"), F.xxhash64(*plain).alias("__h"),
        *[F.col(f).cast("double").alias(f"__f{j}") for j, f in enumerate(features)]))
    shares = [i / BINS for i in range(1, BINS)]
    stats = usable.groupBy("__model").agg(
        F.count("*").alias("n"), F.avg("__y").alias("mean"), F.min("__y").alias("low"), F.max("__y").alias("high"),
        *[F.percentile_approx(f"__f{j}", shares, QUANTILE_ACCURACY).alias(f"q{j}") for j in range(len(features))]).orderBy("__model").collect()
    if not stats or not features or not p["maxIter"]:
        return {}
    # Residuals in steps so small that their sums just fit: 2**53 in a block, 2**62 in all.
    reach = [max(abs(s["high"]), abs(s["low"]), s["high"] - s["low"], 1e-9) for s in stats]
    scale = [2.0 ** (min(34, 61 - s["n"].bit_length()) - int(np.ceil(np.log2(2 * r)))) for s, r in zip(stats, reach)]
    plan = Plan([s["__model"] for s in stats], [[np.unique(s[f"q{j}"]) for j in range(len(features))] for s in stats],
                np.array([round(s["mean"], 6) for s in stats]), np.array(scale), list(features), p)
    out = {}
    small = [s["__model"] for s in stats if s["n"] <= task_rows]
    large = [s["__model"] for s in stats if s["n"] > task_rows]
    if small:
        out |= _models(plan.of(small), _grow_in_tasks(usable.where(F.col("__model").isin(small)), plan.of(small)))
    if large:
        n = {s["__model"]: s["n"] for s in stats}
        cells = cut(_cells(usable.where(F.col("__model").isin(large)), plan))
        different = cells.groupBy("model", "cell").agg(F.lit(1)).groupBy("model").agg(F.count("*").alias("cells")).collect()
        few = {r.model for r in different if r.cells <= min(CELLS, n[r.model] / CELL_ROWS)}
        tallied, others = [m for m in large if m in few], [m for m in large if m not in few]
        if tallied:
            own = plan.of(tallied)
            out |= _models(own, _grow_from_tallies(cells.where(F.col("model").isin(tallied)), own, [n[m] for m in tallied]))
        if others:
            own = plan.of(others)
            out |= _models(own, _grow_in_passes(usable.where(F.col("__model").isin(others)), own, sum(n[m] for m in others)))
    return {name: out[name] for name in plan.names}


def _models(plan: Plan, grown: list[np.ndarray]) -> dict[str, CropModel]:
    out = {}
    for m, name in enumerate(plan.names):
        feature, interval, gain, cover, value = (a[m] for a in grown)
        threshold = np.full(feature.shape, np.inf)
        for j in range(len(plan.features)):
            at = feature == j
            threshold[at] = plan.edges[m][j][interval[at]]
        out[name] = CropModel(name, list(plan.features), float(plan.base[m]), feature, threshold, gain, cover, value, plan.edges[m])
    return out


def _split(sums: np.ndarray, level: int, allowed: np.ndarray, scale: float, rate: float) -> tuple:
    """The best splits of a model's nodes of a level, from sums by [rows or residuals, node, feature, interval].

    Feature (-1: none), interval and gain by node, cover and value by child, cover and value of the first node itself.
    """
    count, total = sums[0].astype(float), sums[1] / scale
    rows, whole = count[:, 0].sum(axis=1), total[:, 0].sum(axis=1)  # [node]
    left_rows, left = np.cumsum(count, axis=2), np.cumsum(total, axis=2)
    right_rows, right = rows[:, None, None] - left_rows, whole[:, None, None] - left
    better = (left**2 / (left_rows + PENALTY) + right**2 / (right_rows + PENALTY)
              - (whole**2 / (rows + PENALTY))[:, None, None])
    better = np.where((left_rows > 0) & (right_rows > 0) & allowed[None, :, None], better, 0.0)
    flat = better.reshape(len(rows), -1)
    best = flat.argmax(axis=1)
    won = np.take_along_axis(flat, best[:, None], axis=1)[:, 0]
    split, node = won > 1e-9, np.arange(len(rows))
    feature, interval = np.divmod(best, BINS)
    cover, value = np.zeros(2 * len(rows), np.int64), np.zeros(2 * len(rows))
    for side, (n, s) in enumerate(((left_rows, left), (right_rows, right))):
        n, s = n[node, feature, interval], s[node, feature, interval]
        cover[side::2], value[side::2] = np.where(split, n, 0), np.where(split, rate * s / (n + PENALTY), 0.0)
    root = rows[0], rate * whole[0] / (rows[0] + PENALTY)
    return np.where(split, feature, -1), np.where(split, interval, 0), np.where(split, won, 0.0), cover, value, root


def fit_crops(df: DataFrame, features: list[str], *, crops: list[str] = config.CROPS,
              train_years: list[int] = config.TRAIN_YEARS, crop: str = "commodity_name",
              target: str = "yield_bu_ac", params: dict | None = None) -> dict[str, CropModel]:
    """One model per listed crop on its training years (M1)."""
    train = df.where(F.col("year").isin(train_years) & F.col(crop).isin(crops))
    models = fit_models(train, features, model=crop, target=target, params=params)
    return {c: models[c] for c in crops if c in models}


def contiguous_folds(df: DataFrame, order: list[Column], k: int = 5, out: str = "fold", *, keys: list[str] | None = None,
                     task_rows: int = ordered.TASK_ROWS) -> DataFrame:
    """k blocks in row order within each group, the first ones longer by one where the rows do not divide evenly."""
    keys = keys or []
    numbered = ordered.positions(df, keys, order, "__row", task_rows=task_rows)
    if keys:
        counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
        numbered = numbered.join(counts, keys)
    else:
        numbered = numbered.withColumn("__n", F.lit(df.count()).cast("long"))
    size, extra = F.expr(f"__n div {k}"), F.col("__n") % k
    starts = [i * size + F.least(F.lit(i), extra) for i in range(1, k)]
    return numbered.withColumn(out, sum((F.col("__row") >= s).cast("int") for s in starts)).drop("__row", "__n").select(*df.columns, out)


def cross_validate(df: DataFrame, features: list[str], order: list[Column], *, target: str = "yield_bu_ac", k: int = 5,
                   keys: list[str] | None = None, params: dict | None = None) -> DataFrame:
    """R² per fold, for each group of ``keys`` (M2). A fold is scored by a model of the group's other folds.

    All folds of all groups are fitted together: a row is a training row of k - 1 models.
    """
    keys = keys or []
    rows = df.where(complete(features) & F.col(target).isNotNull())
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    folds = cut(contiguous_folds(rows, order, k, keys=keys))
    of_group = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in keys]) if keys else F.lit("")
    without = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("fold")))
    train = folds.withColumn("__without", without).withColumn("__model", F.concat_ws("\x1f", "__without", of_group)).drop("__without")
    models = fit_models(train, features, model="__model", target=target, params=params)
    scored = predict(folds.withColumn("__model", F.concat_ws("\x1f", "fold", of_group)), models, crop="__model", out="__predicted")
    return reports.regression_metrics(scored, target, "__predicted", [*keys, "fold"]).select(*keys, "fold", "n", "r2")


def cv_summary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.groupBy(*(keys or [])).agg(
        settle(F.avg("r2"), 3).alias("cv_r2_mean"), settle(F.stddev_pop("r2"), 3).alias("cv_r2_std"))


def model_table(spark: SparkSession, models: dict[str, CropModel]) -> DataFrame:
    """Models as rows: their features in order, base values, interval borders, and every node with its split, gain and rows."""
    rows = []
    for m in models.values():
        head = (m.crop, m.version)
        rows.append((*head, "base", None, None, None, None, None, None, m.base))
        rows += [(*head, "feature", None, j, f, None, None, None, None) for j, f in enumerate(m.features)]
        rows += [(*head, "edge", None, i, f, float(x), None, None, None) for f, e in zip(m.features, m.edges) for i, x in enumerate(e)]
        trees, nodes = m.feature.shape
        made = m.cover > 0
        for t, i in np.argwhere(made).tolist():
            inner = m.feature[t, i] >= 0
            rows.append((*head, "split" if inner else "leaf", t, i, m.features[m.feature[t, i]] if inner else None,
                         float(m.threshold[t, i]) if inner else None, float(m.gain[t, i]) if inner else None, int(m.cover[t, i]),
                         float(m.value[t, i])))
        rows.append((*head, "shape", trees, nodes, None, None, None, None, None))
    columns = [c.split()[0] for c in _MODEL_TABLE.split(", ")]
    kinds = {"tree": "Int32", "node": "Int32", "cover": "Int64"}
    frame = pd.DataFrame({c: pd.array([r[i] for r in rows], kinds.get(c, "object" if c in ("crop", "version", "kind", "feature") else "Float64"))
                          for i, c in enumerate(columns)})
    return spark.createDataFrame(pa.Table.from_pandas(frame, pa.schema([
        (c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[k])
        for c, k in (x.split() for x in _MODEL_TABLE.split(", "))]), preserve_index=False))


def save(models: dict[str, CropModel], folder: str) -> None:
    """Write the models as one table, a partition for each crop (M3)."""
    spark = SparkSession.getActiveSession()
    model_table(spark, models).write.mode("overwrite").partitionBy("crop").parquet(folder)


def load(spark: SparkSession, folder: str, crops: list[str]) -> dict[str, CropModel]:
    """Read the models that exist, feature lists included; only the partitions of these crops are read."""
    from harvestlens.sources.tables import path_exists

    if not path_exists(spark, folder):
        return {}
    fields = ", ".join(x for x in _MODEL_TABLE.split(", ") if not x.startswith("crop "))
    table = spark.read.schema(f"{fields}, crop string").parquet(folder).where(F.col("crop").isin(crops)).toPandas()
    found = {c: _from_rows(c, own) for c, own in table.groupby("crop")}
    return {c: found[c] for c in crops if c in found}


def _from_rows(crop: str, table: pd.DataFrame) -> CropModel:
    by_kind = dict(list(table.groupby("kind")))
    features = by_kind["feature"].sort_values("node")["feature"].tolist()
    shape = tuple(int(by_kind["shape"].iloc[0][c]) for c in ("tree", "node"))
    arrays = {"feature": np.full(shape, -1, np.int64), "threshold": np.full(shape, np.inf), "gain": np.zeros(shape),
              "cover": np.zeros(shape, np.int64), "value": np.zeros(shape)}
    for kind in ("split", "leaf"):
        rows = by_kind.get(kind)
        if rows is None:
            continue
        at = rows["tree"].to_numpy(int), rows["node"].to_numpy(int)
        arrays["cover"][at], arrays["value"][at] = rows["cover"].to_numpy(int), rows["value"].to_numpy(float)
        if kind == "split":
            arrays["feature"][at] = [features.index(f) for f in rows["feature"]]
            arrays["threshold"][at], arrays["gain"][at] = rows["threshold"].to_numpy(float), rows["gain"].to_numpy(float)
    borders = by_kind.get("edge", table.iloc[:0])
    edges = [borders[borders["feature"] == f].sort_values("node")["threshold"].to_numpy(float) for f in features]
    return CropModel(crop, features, float(by_kind["base"].iloc[0]["value"]), **arrays, edges=edges)


def importances(spark: SparkSession, models: dict[str, CropModel]) -> DataFrame:
    """Importance per crop and feature (M4); one row per model input.

    ``total_gain`` adds up the gain of all splits on the feature; ``xgb_importance`` is the gain per split as a share of all features'.
    """
    nodes = model_table(spark, models)
    inputs = nodes.where("kind = 'feature'").select("crop", "feature")
    splits = nodes.where("kind = 'split'").groupBy("crop", "feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("total_gain"))
    both = inputs.join(splits, ["crop", "feature"], "left").na.fill(0, ["splits", "total_gain"])
    each = both.withColumn("__each", F.coalesce(F.try_divide("total_gain", "splits"), F.lit(0.0)))
    whole = each.groupBy("crop").agg(F.sum("__each").alias("__all"))
    return each.join(whole, "crop").select(
        "crop", "feature", settle(F.coalesce(F.try_divide("__each", "__all"), F.lit(0.0)), 4).alias("xgb_importance"), "splits", "total_gain")


def model_inputs(models: dict[str, CropModel]) -> list[str]:
    """Features of any of the models, in order."""
    return list(dict.fromkeys(f for m in models.values() for f in m.features))


def by_model(batch: pd.DataFrame, models: dict[str, CropModel], inputs: list[str]) -> Iterator[tuple[CropModel, np.ndarray, np.ndarray]]:
    """For every model the places of its complete rows in a batch of (crop, inputs...), and their feature values."""
    values = batch.iloc[:, 1:].to_numpy(dtype=float)
    crop = batch.iloc[:, 0]
    for name, model in models.items():
        own = values[:, [inputs.index(f) for f in model.features]]
        at = np.flatnonzero((crop == name).to_numpy(bool) & ~np.isnan(own).any(axis=1))
        if len(at):
            yield model, at, own[at]


class Remembered:
    """A function of rows of feature values that is asked once for equal rows.

    Weather is that of a county and a season, so the rows of a season share their values. Nothing depends on it: rows that are
    all different are all computed, and what is remembered is dropped when it holds more than ``most`` rows.
    """

    def __init__(self, of: Callable[[np.ndarray], np.ndarray], most: int = REMEMBERED_ROWS):
        self.of, self.most, self.place, self.values = of, most, {}, None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(x, float)
        if len(self.place) > self.most:
            self.place, self.values = {}, None
        place, known = self.place, len(self.place)
        at = np.array([place.setdefault(row, len(place)) for row in x.view(np.dtype((np.void, 8 * x.shape[1]))).ravel().tolist()], np.int64)
        if len(place) > known:
            later = np.flatnonzero(at >= known)
            _, first = np.unique(at[later], return_index=True)
            fresh = self.of(x[later[first]])
            self.values = fresh if self.values is None else np.concatenate([self.values, fresh])
        return self.values[at]


def input_struct(inputs: list[str], crop: str) -> Column:
    return F.struct(F.col(crop).cast("string").alias("__crop"), *[F.col(f).cast("double").alias(f) for f in inputs])


def predict(df: DataFrame, models: dict[str, CropModel], *, crop: str = "commodity_name",
            out: str = "xgb_predicted_yield") -> DataFrame:
    """Predictions for rows with complete features; null elsewhere and for crops without a model (M6).

    One pass for all crops: the trees of all models are sent to the tasks, which pick a row's model by its crop.
    """
    if not models:
        return df.withColumn(out, F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(models)
    inputs = model_inputs(models)

    @F.pandas_udf("double")
    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        ask = {name: Remembered(m.predict) for name, m in shared.value.items()}
        for batch in batches:
            found = np.full(len(batch), np.nan)
            for model, at, x in by_model(batch, shared.value, inputs):
                found[at] = ask[model.crop](x)
            yield pd.Series(found).astype("Float64").where(~np.isnan(found))

    value = predicted(input_struct(inputs, crop))
    return df.withColumn(out, F.when(~F.isnan(value), value))


def split_metrics(scored: DataFrame, train_years: list[int], *, crop: str = "commodity_name",
                  target: str = "yield_bu_ac", predicted: str = "xgb_predicted_yield") -> DataFrame:
    """RMSE and R² on the training years and on the years held out."""
    marked = scored.withColumn("split", F.when(F.col("year").isin(train_years), "train").otherwise("test"))
    return reports.regression_metrics(marked, target, predicted, [crop, "split"])

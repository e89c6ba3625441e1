"""Isolation forest per group (M8, M9).

Every tree is grown from at most 256 rows, so growing is one small task per tree. The trees are then
broadcast (their size depends on the number of trees only) and all rows are scored in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens import config
from harvestlens.operators import ordered
from harvestlens.operators.joins import attach, is_small
from harvestlens.session import cut

GRID_CELLS = 65_536  # combinations of intervals of a tree that are tabulated
WALKED_ROWS = 5_000  # rows of a group that a task walks before it tabulates the group's trees


def standardise(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population std per group (M8); a constant column gives 0."""
    stats = df.na.drop(subset=keys).groupBy(*keys).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns],
        F.count("*").alias("__weight"))
    joined = attach(df, stats, keys, weight="__weight")
    return joined.withColumns({
        f"{c}{suffix}": F.coalesce(
            F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")),
            F.when(F.col(c).isNotNull(), F.lit(0.0)))
        for c in columns
    }).select(*df.columns, *[f"{c}{suffix}" for c in columns])


def tree_choices(rows: DataFrame, group: str, key: list[str], columns: list[str], *, trees: int, size: int,
                 seed: int) -> DataFrame:
    """Rows with a tree they may grow in, about 2 x ``size`` for each tree (group, columns, tree, __key, __draw).

    A pool of about trees x size rows is drawn first; each of its rows chooses a few trees. Draws come
    from a hash of the key, the inputs, the number among equal rows and the seed: they do not depend
    on how the rows are partitioned, and equal rows are not drawn together.
    """
    stats = rows.groupBy(group).agg(F.count("*").alias("__n"))
    equal = rows.groupBy(group, *columns, F.xxhash64(*[F.col(k) for k in key]).alias("__row")).agg(F.count("*").alias("__copies"))
    marked = equal.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(
        group, *columns, F.xxhash64("__row", *columns, "__copy").alias("__key"))

    def unit(*parts) -> F.Column:
        return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)

    counted = attach(marked, stats.select(group, "__n"), [group], weight="__n")
    pool = counted.where(unit(F.col("__key"), F.lit(seed)) * F.col("__n") < trees * size)
    offered = F.least(F.col("__n"), F.lit(trees * size))
    # A row takes one tree out of each of some equal parts of the trees, so that a tree is offered 2 x size rows.
    share = F.least(F.lit(float(trees)), F.lit(2.0 * size * trees) / offered)
    parts = F.floor(share + unit(F.col("__key"), F.lit(seed + 1))).cast("int")

    def within(j: F.Column) -> F.Column:
        at = F.floor((j + unit(F.col("__key"), j, F.lit(seed + 2))) * trees / F.col("__parts"))
        return F.least(at, F.lit(trees - 1)).cast("int")

    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), within))
    return pool.withColumn("__parts", F.least(parts, F.lit(trees))).withColumn("tree", F.explode(chosen)).withColumn(
        "__draw", unit(F.col("__key"), F.col("tree"), F.lit(seed + 3))).select(group, *columns, "tree", "__key", "__draw")


def tree_samples(rows: DataFrame, group: str, key: list[str], columns: list[str], *, trees: int, size: int,
                 seed: int) -> DataFrame:
    """Per group and tree up to ``size`` rows drawn without replacement (group, tree, columns)."""
    near = tree_choices(rows, group, key, columns, trees=trees, size=size, seed=seed)
    first = Window.partitionBy(group, "tree").orderBy("__draw", "__key")
    return cut(near.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= size).select(
        group, "tree", *columns))


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    with np.errstate(all="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (left, right, feature, threshold, depth when a leaf)."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = [[-1, -1, -1, 0.0, 0.0]]
    stack = [(0, x, 0)]
    while stack:
        at, part, depth = stack.pop()
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else np.array([], int)
        if depth >= limit or len(spread) == 0:
            nodes[at][4] = depth + float(_average_path(len(part)))
            continue
        f = int(rng.choice(spread))
        t = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        left = part[:, f] <= t
        nodes[at][:4] = [len(nodes), len(nodes) + 1, f, t]
        nodes += [[-1, -1, -1, 0.0, 0.0], [-1, -1, -1, 0.0, 0.0]]
        stack += [(nodes[at][0], part[left], depth + 1), (nodes[at][1], part[~left], depth + 1)]
    return [tuple(n) for n in nodes]


def grow_forest(samples: DataFrame, group: str, columns: list[str], seed: int) -> DataFrame:
    """All trees as node rows."""
    kind = samples.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(columns)
        nodes = _grow(pdf[columns].to_numpy(float), np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["left", "right", "feature", "threshold", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "rows", len(pdf))
        out.insert(0, "tree", tree)
        out.insert(0, "grp", pdf[group].iloc[0])
        return out

    # The samples are few bytes but much work, so their tasks are not merged by size.
    spread = samples.repartition(samples.sparkSession.sparkContext.defaultParallelism, group, "tree")
    return spread.groupBy(group, "tree").applyInPandas(
        one, f"grp {kind}, tree int, rows int, node int, left int, right int, feature int, threshold double, path double")


def _walked(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Path length of every row in a tree, node by node."""
    left, right, feature, threshold, path = tree
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    while True:
        inner = left[at] >= 0
        if not inner.any():
            return path[at]
        go_left = x[rows, feature[at]] <= threshold[at]
        at = np.where(inner, np.where(go_left, left[at], right[at]), at)


def _grid(tree: tuple[np.ndarray, ...], width: int) -> tuple[list[np.ndarray], np.ndarray] | None:
    """The borders of each input and the leaf of every combination of intervals; None when these are too many.

    A leaf is a box of intervals, so few inputs have a small grid: at most size^width / width^width cells.
    """
    left, right, feature, threshold, _ = tree
    borders = [np.unique(threshold[(left >= 0) & (feature == f)]) for f in range(width)]
    shape = [len(b) + 1 for b in borders]
    if np.prod(shape, dtype=float) > GRID_CELLS or len(left) > 1 << 16:
        return None
    grid, stack = np.zeros(shape, np.uint16), [(0, tuple((0, n) for n in shape))]
    while stack:
        at, box = stack.pop()
        if left[at] < 0:
            grid[tuple(slice(*b) for b in box)] = at
            continue
        f = int(feature[at])
        low, high = box[f]
        border = int(np.searchsorted(borders[f], threshold[at])) + 1  # intervals before it go left
        stack.append((int(left[at]), (*box[:f], (low, max(low, min(high, border))), *box[f + 1:])))
        stack.append((int(right[at]), (*box[:f], (min(high, max(low, border)), high), *box[f + 1:])))
    return borders, grid.ravel()


class Forest:
    """Average path length of rows. Trees are walked for the first rows; then leaves are looked up in the trees' grids."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], width: int):
        self.trees, self.width, self.seen, self.grids = trees, width, 0, None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        self.seen += len(x)
        if self.grids is None and self.seen > WALKED_ROWS:
            self.grids = [_grid(t, self.width) for t in self.trees]
        total = np.zeros(len(x))
        if self.grids is None:
            for tree in self.trees:
                total += _walked(x, tree)
            return total / len(self.trees)
        values, places = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(self.width)))
        for tree, known in zip(self.trees, self.grids):
            if known is None:
                total += _walked(x, tree)
                continue
            borders, grid = known
            cell = np.zeros(len(x), np.int64)
            for own, value, place in zip(borders, values, places):
                until = np.searchsorted(value, own, "right")  # values up to each border
                interval = np.repeat(np.arange(len(own) + 1), np.diff(until, prepend=0, append=len(value)))
                cell *= len(own) + 1
                cell += interval[place]
            total += tree[4][grid[cell]]
        return total / len(self.trees)


def score(df: DataFrame, nodes: DataFrame, group: str, columns: list[str], out: str) -> DataFrame:
    """Anomaly score in (0, 1], larger is more unusual; null where an input is null."""
    table = nodes.toPandas()
    forests = {}
    for name, part in table.groupby("grp"):
        trees = [
            tuple(t[c].to_numpy() for c in ("left", "right", "feature", "threshold", "path"))
            for _, t in part.sort_values("node").groupby("tree")]
        expected = float(_average_path(part.groupby("tree")["rows"].first().max()))
        forests[name] = (trees, max(expected, 1e-12))
    shared = df.sparkSession.sparkContext.broadcast(forests)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        ask: dict = {}
        for names, values in batches:
            x = values.to_numpy(dtype=float)
            result = np.full(len(x), np.nan)
            for name in names.dropna().unique():
                if name in shared.value:
                    trees, expected = shared.value[name]
                    here = (names == name).to_numpy() & ~np.isnan(x).any(axis=1)
                    if here.any():
                        if name not in ask:
                            ask[name] = Forest(trees, len(columns))
                        result[here] = 2.0 ** (-ask[name](x[here]) / expected)
            series = pd.Series(result, dtype=object)
            yield series.where(~np.isnan(result), None)

    return df.withColumn(out, scored(F.col(group), F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))


def isolation_layer(df: DataFrame, columns: list[str], key: list[str], *, group: str = "commodity_name",
                    groups: list[str] = config.CROPS, trees: int = config.ISOLATION_TREES, size: int = config.ISOLATION_ROWS,
                    contamination: float = config.CONTAMINATION, seed: int = 42, drop_incomplete: bool = False,
                    task_rows: int = ordered.TASK_ROWS) -> DataFrame:
    """Add ``if_anomaly_score`` and ``if_anomaly``, the top share per group (M9).

    Rows with a null input get a null score and no flag; ``drop_incomplete`` leaves them out. The
    listed groups set the number of forests that are broadcast.
    """
    usable = F.col(group).isin(groups)
    for c in columns:
        usable = usable & F.col(c).isNotNull()
    rows = df.where(usable)
    samples = tree_samples(rows, group, key, columns, trees=trees, size=size, seed=seed)
    nodes = grow_forest(samples, group, columns, seed)
    target = rows if drop_incomplete else df
    if is_small(target):  # scoring costs far more than moving a small table to all cores
        target = target.repartition(df.sparkSession.sparkContext.defaultParallelism)
    scored = cut(score(target, nodes, group, columns, "if_anomaly_score"))
    bound = ordered.exact_percentiles(
        scored, [group], "if_anomaly_score", {"__cut": 1 - contamination}, task_rows=task_rows)
    flagged = attach(scored, bound, [group], weight="__n")
    return flagged.withColumn(
        "if_anomaly", F.coalesce(F.col("if_anomaly_score") > F.col("__cut"), F.lit(False))).select(
            *scored.columns, "if_anomaly")

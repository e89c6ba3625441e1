"""Exact path-dependent Shapley values of boosted trees (M5, M7).

For one leaf the model gives its value when all tests on the path hold; a feature outside the
coalition passes its tests with the share of training rows that did. With 0/1 outcomes per
feature, the contributions of a leaf depend only on which of its (few) features pass, so they are
tabulated once per leaf, by tasks that take some trees each, and looked up for whole Arrow batches of rows. One pass serves
all crops: a row's tables are picked by its crop.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens.functions.columns import settle
from harvestlens.operators.boosting import CropModel, Remembered, by_model, input_struct, model_inputs

DRIVERS = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())]))
LEAVES_AT_ONCE = 512  # leaves and rows of one step of the look-up, some MB
ROWS_AT_ONCE = 64
TREES_AT_ONCE = 25  # trees whose leaves one row of the job that makes the tables stands for


def _leaves(model: CropModel, trees: range) -> tuple[float, list[tuple]]:
    """What the trees give on average, and per leaf (value, features, lower bounds, upper bounds, shares)."""
    base, leaves = 0.0, []
    for t in trees:
        feature, threshold, cover, values = (a[t] for a in (model.feature, model.threshold, model.cover, model.value))
        stack = [(0, {}, 1.0)]
        while stack:
            at, path, reach = stack.pop()
            if feature[at] < 0:
                base += values[at] * reach
                if path:
                    leaves.append(_leaf(float(values[at]), path))
                continue
            f, border = int(feature[at]), float(threshold[at])
            for child, left in ((2 * at + 1, True), (2 * at + 2, False)):
                share = cover[child] / cover[at]
                low, high, z = path.get(f, (-np.inf, np.inf, 1.0))
                bounds = (low, min(high, border), z * share) if left else (max(low, border), high, z * share)
                stack.append((child, path | {f: bounds}, reach * share))
    return float(base), leaves


def _leaf(value: float, path: dict[int, tuple[float, float, float]]) -> tuple:
    low, high, share = np.array(list(path.values())).T
    return value, np.array(list(path)), low, high, share


def _tables(leaves: list[tuple], at_once: int = 1024) -> list[tuple[np.ndarray, ...]]:
    """Leaves with equally many features together: features, bounds, contributions[leaf, pattern, feature].

    The worth of a coalition is the product of what each feature gives: whether it passes, if it is a
    member, else its share. Shapley's weights turn the worth of all coalitions into contributions.
    """
    out = []
    for k in sorted({len(leaf[1]) for leaf in leaves}):
        own = [leaf for leaf in leaves if len(leaf[1]) == k]
        member = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1  # [coalition or pattern, feature]
        size = member.sum(axis=1)
        weight = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)] + [0.0])
        gain = np.where(member == 1, weight[size - 1][:, None], -weight[size][:, None])  # [coalition, feature]
        value, features, low, high, share = (np.array([leaf[i] for leaf in own]) for i in range(5))
        table = np.empty((len(own), 1 << k, k))
        for start in range(0, len(own), at_once):
            few = slice(start, start + at_once)
            worth = np.ones((len(share[few]), 1 << k, 1 << k))  # [leaf, pattern, coalition]
            for j in range(k):
                worth *= np.where(member[None, None, :, j] == 1, member[None, :, None, j], share[few, j, None, None])
            table[few] = value[few, None, None] * (worth @ gain)
        out.append((features, low, high, table))
    return out


class Lookup:
    """Leaf tables laid out for many rows.

    Between two borders of a feature no test on it changes. So a feature's interval gives its bit in the patterns of all leaves at
    once, a row's patterns are the sum over its features, and every leaf adds the contributions of its pattern.
    """

    def __init__(self, tables: list[tuple[np.ndarray, ...]], width: int):
        ends = [[np.zeros(0)] for _ in range(width)]
        for features, low, high, _ in tables:
            for f in np.unique(features):
                at = features == f
                ends[f] += [low[at], high[at]]
        self.width = width
        self.borders = [np.unique(x[np.isfinite(x)]) for x in map(np.concatenate, ends)]
        self.parts = [self._part(*(a[i : i + LEAVES_AT_ONCE] for a in arrays)) for arrays in tables for i in range(0, len(arrays[0]), LEAVES_AT_ONCE)]

    def _part(self, features: np.ndarray, low: np.ndarray, high: np.ndarray, table: np.ndarray) -> tuple:
        leaves, k = features.shape
        bits, wide = {}, np.zeros((leaves, 1 << k, self.width))
        for f in np.unique(features).tolist():
            leaf, j = np.nonzero(features == f)  # a leaf has a feature once
            borders = self.borders[f]
            first = np.where(np.isfinite(low[leaf, j]), np.searchsorted(borders, low[leaf, j]) + 1, 0)
            last = np.where(np.isfinite(high[leaf, j]), np.searchsorted(borders, high[leaf, j]), len(borders))
            interval = np.arange(len(borders) + 1)[:, None]
            bits[f] = np.zeros((len(borders) + 1, leaves), np.uint8 if k <= 8 else np.int32)
            bits[f][:, leaf] = ((interval >= first) & (interval <= last)) << j
            wide[leaf, :, f] = table[leaf, :, j]
        return bits, np.arange(leaves) << k, wide.reshape(leaves << k, self.width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Contributions [row, feature]."""
        out = np.zeros((len(x), self.width))
        interval = [np.searchsorted(b, x[:, f]) for f, b in enumerate(self.borders)]
        for bits, offset, wide in self.parts:
            leaves = np.ones(len(offset))
            for start in range(0, len(x), ROWS_AT_ONCE):
                few = slice(start, start + ROWS_AT_ONCE)
                pattern = sum(own[interval[f][few]] for f, own in bits.items())
                found = wide.take((pattern + offset).ravel(), axis=0).reshape(-1, len(offset), self.width)
                out[few] += leaves @ found
        return out


def _contributions(x: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    return Lookup(tables, x.shape[1])(x)


def leaf_tables(spark: SparkSession, models: dict[str, CropModel]) -> dict[str, tuple[float, list]]:
    """Base value and leaf tables of every model, made by tasks of some trees each.

    Their size depends on the models alone: trees times leaves times 2^depth.
    """
    shared = spark.sparkContext.broadcast(models)
    work = [(name, start) for name, m in models.items() for start in range(0, len(m.feature), TREES_AT_ONCE)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                model = shared.value[name]
                base, leaves = _leaves(model, range(start, min(start + TREES_AT_ONCE, len(model.feature))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([start]), pa.array([base]), pa.array([pickle.dumps(_tables(leaves))], pa.binary())],
                    names=["crop", "start", "base", "tables"])

    rows = spark.createDataFrame(work, "crop string, start long").repartition(len(work), "start", "crop").mapInArrow(
        made, "crop string, start long, base double, tables binary")
    found: dict[str, tuple[float, dict]] = {name: (m.base, {}) for name, m in models.items()}
    for r in sorted(rows.collect(), key=lambda r: (r.crop, r.start)):
        base, sizes = found[r.crop]
        for part in pickle.loads(r.tables):
            sizes.setdefault(part[0].shape[1], []).append(part)
        found[r.crop] = base + r.base, sizes
    return {name: (base, [tuple(np.concatenate(a) for a in zip(*parts)) for _, parts in sorted(sizes.items())])
            for name, (base, sizes) in found.items()}


def _is_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def attribute(df: DataFrame, models: dict[str, CropModel], *, crop: str = "commodity_name", out: str = "drivers",
              base: str = "base_value") -> DataFrame:
    """All rows, plus base value and contributions sorted by size (M7); both null without complete features or a model.

    One pass over the rows for all crops. The leaf tables are broadcast: they grow with the models (trees times 2^depth), not
    with the rows.
    """
    if not models:
        return df.withColumns({base: F.lit(None).cast("double"), out: F.lit(None).cast(DRIVERS)})
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((models, leaf_tables(spark, models)))
    inputs = model_inputs(models)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def contributions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        known, tables = shared.value
        ask: dict[str, Remembered] = {}
        for batch in batches:
            found = np.full((len(batch), len(inputs) + 1), np.nan)
            for model, at, x in by_model(batch, known, inputs):
                start, own = tables[model.crop]
                if model.crop not in ask:
                    ask[model.crop] = Remembered(Lookup(own, len(model.features)))
                found[at, -1] = start
                found[np.ix_(at, [inputs.index(f) for f in model.features])] = ask[model.crop](x)
            yield pd.Series(list(found))

    found = F.col("__c")
    pairs = F.transform(
        F.arrays_zip(F.array(*[F.lit(f) for f in inputs]).alias("feature"), F.slice(found, 1, len(inputs)).alias("value")),
        lambda d: F.struct(d["feature"].alias("feature"), d["value"].alias("value")))
    drivers = F.filter(pairs, lambda d: _is_number(d["value"]))  # a model may lack a feature that another has
    by_size = F.array_sort(drivers, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(
        F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(F.lit(0)))
    done = _is_number(F.element_at(found, -1))
    values = df.withColumn("__c", contributions(input_struct(inputs, crop)))
    return values.withColumns({base: F.when(done, F.element_at(found, -1)), out: F.when(done, by_size)}).drop("__c")


def global_attribution(df: DataFrame, models: dict[str, CropModel], *, crop: str = "commodity_name") -> DataFrame:
    """Mean absolute contribution per crop and feature (M5), over the rows that have contributions."""
    rows = attribute(df, models, crop=crop).select(F.col(crop).alias("crop"), F.explode("drivers").alias("d"))
    return rows.groupBy("crop", F.col("d.feature").alias("feature")).agg(
        settle(F.avg(F.abs("d.value")), 4).alias("shap_mean_abs"))

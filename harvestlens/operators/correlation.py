"""Correlations of every (crop, feature) in one pass (A10-A12, A22) and their p-values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import settle
from harvestlens.operators import ordered
from harvestlens.operators.joins import attach
from harvestlens.session import cut


def pearson(df: DataFrame, group: str, target: str, features: list[str]) -> DataFrame:
    """n and Pearson r per (crop, feature), from one aggregate over the rows as they lie."""
    x = F.col(target).cast("double")
    aggs: list[Column] = []
    for f in features:
        y = F.col(f).cast("double")
        xf, yf = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        spread = F.stddev_pop(xf) * F.stddev_pop(yf)
        aggs += [F.struct(
            F.lit(f).alias("feature"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"),
            F.try_divide(F.covar_pop(xf, yf), spread).alias("r")).alias(f"__{f}")]
    wide = df.groupBy(F.col(group).alias("crop")).agg(*aggs)
    return wide.select("crop", F.explode(F.array(*[F.col(f"__{f}") for f in features])).alias("s")).select(
        "crop", "s.feature", "s.n", "s.r")


WORD = 63  # features whose presence fits into one long


def _presence(features: list[str]) -> Column:
    """Which features of a row are known, as bits of an array of longs."""
    return F.array(*[
        F.lit(0).cast("long") + sum(F.when(F.col(f).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                                    for i, f in enumerate(features[at:at + WORD]))
        for at in range(0, len(features), WORD)])


def _known(i: int) -> Column:
    return F.col("__known")[i // WORD].bitwiseAND(F.lit(1 << i % WORD).cast("long")) != 0


def _same_nulls(seen: DataFrame, features: list[str]) -> dict[str, int]:
    """For each feature the number of the first feature that is null on the same rows."""
    words = range(-(-len(features) // WORD))
    row = seen.agg(*[
        F.bit_or(F.col("__known")[w].bitwiseXOR(F.when(_known(i), F.lit(-1)).otherwise(F.lit(0)).cast("long"))).alias(f"d{i}_{w}")
        for i in range(len(features)) for w in words]).first()
    return {f: next(j for j in range(i + 1) if not (row[f"d{i}_{j // WORD}"] or 0) >> j % WORD & 1) for i, f in enumerate(features)}


def spearman(df: DataFrame, group: str, target: str, features: list[str], *,
             task_rows: int = ordered.TASK_ROWS) -> DataFrame:
    """n and Spearman r per (crop, feature): Pearson of average-ties ranks on the same complete pairs.

    The target is ranked once for all features that are null on the same rows, per distinct value, and the ranks are
    joined back by value. Rows then collapse to the distinct values of each feature with the sum of their
    target ranks, so no table of pairs is written. Groups too large for one task are ranked in blocks.
    """
    rows = df.where(F.col(target).isNotNull()).select(
        F.col(group).alias("crop"), F.col(target).cast("double").alias("__x"),
        *[F.col(f).cast("double").alias(f"__y{i}") for i, f in enumerate(features)])
    seen = cut(rows.groupBy("crop", "__x", _presence([f"__y{i}" for i in range(len(features))]).alias("__known")).agg(
        F.count("*").alias("__copies")))
    pattern = _same_nulls(seen, features)
    sizes = seen.groupBy("crop").agg(F.sum("__copies").alias("rows"), F.count_distinct("__x").alias("values"))
    size = sizes.agg(F.sum("values").alias("total"), F.max("values").alias("values"), F.max("rows").alias("rows")).first()
    patterns = sorted(set(pattern.values()))
    counts = seen.groupBy("crop", "__x").agg(
        F.sum("__copies").alias("__all"), *[F.sum(F.when(_known(j), F.col("__copies")).otherwise(0)).alias(f"__n{j}") for j in patterns])
    before = ordered.running(counts, ["crop"], [F.col("__x")], {f"__b{j}": F.col(f"__n{j}") for j in patterns},
                             task_rows=task_rows, profile=(size["total"] or 0, size["values"] or 0))
    ranks = before.select("crop", "__x", "__all", *[
        (F.col(f"__b{j}") + (F.col(f"__n{j}") + 1) / 2.0).alias(f"__r{j}") for j in patterns])
    ranked = attach(rows, ranks, ["crop", "__x"], weight="__all", null_safe=True)
    pairs = ranked.select("crop", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"__y{i}").alias("y"), F.col(f"__r{pattern[f]}").alias("rx"))
        for i, f in enumerate(features)])).alias("p")).select("crop", "p.*").where(F.col("y").isNotNull())
    keys = ["crop", "feature"]
    values = pairs.groupBy(*keys, "y").agg(
        F.count("*").alias("__copies"), F.sum("rx").alias("sx"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"))
    fits = (size["rows"] or 0) <= task_rows  # no feature has more distinct values than its crop has rows
    profile = (len(features) * (size["rows"] or 0), size["rows"] or 0) if fits else None
    ordered_values = ordered.average_ranks(values, keys, "y", "ry", task_rows=task_rows, profile=profile)
    ry, copies = F.col("ry"), F.col("__copies")
    sums = ordered_values.groupBy(*keys).agg(
        F.sum(copies).alias("n"), F.sum("sxx").alias("sxx"), F.sum(copies * ry * ry).alias("syy"), F.sum(F.col("sx") * ry).alias("sxy"))
    n, mean = F.col("n"), (F.col("n") + 1) / 2.0  # the mean rank is known
    cov = F.col("sxy") - n * mean * mean
    spread = F.sqrt(F.col("sxx") - n * mean * mean) * F.sqrt(F.col("syy") - n * mean * mean)
    return sums.select(*keys, "n", F.try_divide(cov, spread).alias("r"))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values that are computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _log_gamma(z: Column) -> Column:
    """Stirling series eight steps up; ``z`` is above zero."""
    up = z + 8.0
    series = (up - 0.5) * F.log(up) - up + math.log(2 * math.pi) / 2 + 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5))
    product = z
    for i in range(1, 8):
        product = product * (z + float(i)) / up
    return series - F.log(product) - 7 * F.log(up)


def _beta_share(p: Column, q: Column, y: Column) -> Column:
    """Regularised incomplete beta I_y(p, q) for y below (p + 1) / (p + q + 2): Lentz's method as a fold over its steps."""
    front = F.exp(p * F.log(y) + q * F.log1p(-y) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p
    one = F.lit(1.0)
    first = 1 / (1 - (p + q) * y / (p + 1))

    def half(state: Column, term: Callable[[Column], Column], m: Column) -> Column:
        moved = _let({"t": term(m)}, lambda v: F.struct((1 / (1 + v["t"] * state["d"])).alias("d"), (1 + v["t"] / state["c"]).alias("c")))
        return _let({"s": moved}, lambda v: F.struct(
            v["s"]["c"].alias("c"), v["s"]["d"].alias("d"), (state["total"] * v["s"]["c"] * v["s"]["d"]).alias("total")))

    def step(state: Column, m: Column) -> Column:
        even = half(state, lambda m: m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), m)
        return _let({"e": even}, lambda v: half(
            v["e"], lambda m: -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)), m))

    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    start = F.struct(one.alias("c"), first.alias("d"), first.alias("total"))
    return front * F.aggregate(steps, start, step, lambda s: s["total"])


STEPS = 300  # of the continued fraction


def p_value(r: str, n: str) -> Column:
    """Two-sided p of r from n pairs (A12): I_{1-r²}((n-2)/2, 1/2); null below three pairs or without r."""
    r, n = F.col(r).cast("double"), F.col(n).cast("double")

    def tail(v: Column) -> Column:
        a, x = v["a"], v["x"]
        flip = x > (a + 1) / (a + 2.5)
        half = F.lit(0.5)
        share = _let({"p": F.when(flip, half).otherwise(a), "q": F.when(flip, a).otherwise(half), "y": F.when(flip, 1 - x).otherwise(x)},
                     lambda w: F.when(w["y"] <= 0, 0.0).otherwise(_beta_share(w["p"], w["q"], w["y"])))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(flip, 1 - share).otherwise(share)))

    return F.when(r.isNotNull() & ~F.isnan(r) & (n >= 3), _let(
        {"a": (n - 2) / 2, "x": F.greatest(F.lit(0.0), 1 - r * r)}, tail))


def correlations(df: DataFrame, features: list[str], *, group: str = "commodity_name", target: str = "yield_bu_ac",
                 groups: list[str] | None = None, min_pairs: int = config.MIN_PAIRS,
                 task_rows: int = ordered.TASK_ROWS) -> DataFrame:
    """The correlations table, strongest first within a crop."""
    rows = df if groups is None else df.where(F.col(group).isin(groups))
    linear = pearson(rows, group, target, features).where(F.col("n") >= min_pairs)
    ranks = spearman(rows, group, target, features, task_rows=task_rows).withColumnRenamed("r", "s").drop("n")
    both = linear.join(ranks, ["crop", "feature"])
    return both.select(
        "crop", "feature",
        settle(F.col("r"), 3).alias("pearson_r"), settle(p_value("r", "n"), 4).alias("pearson_p"),
        settle(F.col("s"), 3).alias("spearman_r"), settle(p_value("s", "n"), 4).alias("spearman_p"),
        F.abs("r").alias("abs_pearson"),
    ).orderBy("crop", F.col("abs_pearson").desc(), "feature")


def trend_line(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per group."""
    return df.na.drop(subset=[x, y]).groupBy(group).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"))


def importance_from_correlations(corr: DataFrame) -> DataFrame:
    """Stand-in for model importances when no model was fitted."""
    return corr.select("crop", "feature", F.col("abs_pearson").alias("xgb_importance"),
                       F.col("abs_pearson").alias("shap_mean_abs"))

"""Profiles, counts, pivots and ordered extracts behind charts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.functions.columns import settle
from harvestlens.operators import ordered


def profile(df: DataFrame, *, year: str = "year", distinct: list[str]) -> DataFrame:
    """Row count, year range, distinct counts and nulls per column in one pass (A1).

    Each distinct count first reduces to distinct values before its shuffle.
    """
    return df.agg(
        F.count("*").alias("n_rows"), F.min(year).alias("min_year"), F.max(year).alias("max_year"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in distinct],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns])


def melt(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, value: one row per key row and column."""
    return df.unpivot([*keys], [F.col(c).cast("double").alias(c) for c in columns], "column", "value")


def describe(df: DataFrame, keys: list[str], columns: list[str], digits: int) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per group and column (A2)."""
    long = melt(df, keys, columns)
    by = [*keys, "column"]
    moments = long.groupBy(*by).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = ordered.exact_percentiles(long, by, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("__n")
    both = moments.join(quartiles, by, "left")
    return both.select(*by, "count", *[
        settle(F.col(c), digits).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, exact quartiles and maximum per group."""
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return ordered.exact_percentiles(df, keys, value, probs).withColumnRenamed("__n", "n")


def medians(df: DataFrame, keys: list[str], columns: list[str], prefix: str = "median_") -> DataFrame:
    """Exact medians of several columns per group, side by side."""
    long = ordered.exact_percentiles(melt(df, keys, columns), [*keys, "column"], "value", {"m": 0.5})
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"{prefix}{c}") for c in columns])


def event_review(df: DataFrame, year: int, *, crop: str = "commodity_name", key: str = "fips", actual: str = "yield_bu_ac",
                 predicted: str = "xgb_predicted_yield", gap: str = "xgb_residual", small: float = 10.0) -> DataFrame:
    """Medians of one year per crop, and whether the model foresaw it."""
    rows = df.where(F.col("year") == year)
    counts = rows.groupBy(crop).agg(F.count_distinct(key).alias("counties"))
    joined = counts.join(medians(rows, [crop], [actual, predicted, gap]), crop)
    verdict = F.when(F.abs(f"median_{gap}") < small, "anticipated").otherwise("missed")
    return joined.withColumn("verdict", verdict)


def event_flags(df: DataFrame, year: int, *, crop: str = "commodity_name", kind: str = "anomaly_type",
                flag: str = "is_anomaly") -> DataFrame:
    """Rows, flagged rows and unexplained rows of one year per crop."""
    return df.where(F.col("year") == year).groupBy(crop).agg(
        F.count("*").alias("n_rows"), F.count_if(flag).alias("flagged"), F.count_if(F.col(kind) == "UNEXPLAINED").alias("unexplained"))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value, all rows and the share in percent."""
    has = F.col(column).isNotNull()
    return df.agg(F.count_if(has).alias("matched"), F.count("*").alias("n_rows"),
                  settle(100 * F.avg(has.cast("double")), 1).alias("match_pct"))


def mean_by(df: DataFrame, keys: list[str], value: str, digits: int, out: str) -> DataFrame:
    """Rounded group mean."""
    return df.groupBy(*keys).agg(settle(F.avg(value), digits).alias(out))


def count_pivot(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with one column per value; absent cells are 0."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def count_by(df: DataFrame, keys: list[str], out: str = "n", where: Column | None = None) -> DataFrame:
    """Rows per group, optionally of those that pass a test."""
    return (df if where is None else df.where(where)).groupBy(*keys).agg(F.count("*").alias(out))


def flag_sum(df: DataFrame, keys: list[str], flag: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long")).alias(out))


def layer_overlap(df: DataFrame, z: str = "z_anomaly", r: str = "residual_anomaly", flag: str = "is_anomaly") -> DataFrame:
    """How the first two layers overlap, and the flagged share."""
    zf, rf, af = (F.coalesce(F.col(c), F.lit(False)) for c in (z, r, flag))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(af).alias("flagged"), F.count_if(zf).alias("z_flagged"),
        F.count_if(zf & ~rf).alias("weather_explained"), F.count_if(zf & rf).alias("unexplained"),
        settle(100 * F.avg(af.cast("double")), 1).alias("flagged_pct"))


def value_shares(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Counts of a column with their share in percent of the group total, largest first."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if keys:
        total = F.sum("n").over(Window.partitionBy(*keys))  # over one row per value
    else:
        total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", settle(100.0 * F.col("n") / total, 1)).orderBy(*keys, F.col("n").desc(), value)


def mean_pivot(df: DataFrame, row: str, column: str, values: list, measure: str, *, missing: float | None = None) -> DataFrame:
    """Means with one column per value (A20); absent cells stay null unless a filler is given."""
    wide = df.groupBy(row).pivot(column, values).agg(F.avg(measure))
    return wide if missing is None else wide.na.fill(missing, [str(v) for v in values])


def mean_and_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean with its sample-deviation band."""
    mean, std = F.avg(value), F.stddev_samp(value)
    return df.groupBy(*keys).agg(mean.alias("mean"), std.alias("std"), (mean - std).alias("low"), (mean + std).alias("high"))


def yield_trend(merged: DataFrame, *, crop: str = "commodity_name") -> DataFrame:
    """Yearly means per crop behind the trend chart."""
    return merged.groupBy("year", crop).agg(
        settle(F.avg("yield_bu_ac"), 1).alias("avg_yield_bu_ac"), settle(F.avg("gdd_base10"), 0).alias("avg_gdd"),
        settle(F.avg("heat_stress_days"), 1).alias("avg_heat_days")).orderBy("year", crop)


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """RMSE and R² where both sides are known."""
    rows = df.na.drop(subset=[actual, predicted])
    square = F.pow(F.col(actual) - F.col(predicted), F.lit(2))
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(square)).alias("rmse"),
        (1 - F.try_divide(F.avg(square), F.var_pop(actual))).alias("r2"))


def ranked_view(df: DataFrame, columns: list[str], measure: str, group: str = "crop") -> DataFrame:
    """Chosen columns, ordered by group and falling measure (O1, O2)."""
    return df.select(*columns).orderBy(group, F.col(measure).desc(), "feature")


def anomaly_feed(df: DataFrame, columns: list[str], limit: int = 500, ties: tuple[str, ...] = ("fips",)) -> DataFrame:
    """Flagged rows, newest year first, largest gap first (O3); only the top rows leave each task."""
    return df.where(F.col("is_anomaly")).orderBy(
        F.col("year").desc(), F.abs("xgb_residual").desc_nulls_last(), *ties).limit(limit).select(*columns)


def top_keys(df: DataFrame, key: str, flag: str | None, n: int = 6) -> DataFrame:
    """Keys with the most flagged rows, or with most rows when there is no flag."""
    score = F.count("*") if flag is None else F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long"))
    return df.groupBy(key).agg(score.alias("score")).orderBy(F.col("score").desc(), key).limit(n)


def series(df: DataFrame, where: Column, order: list[Column], columns: list[str], *, label: str = "z_direction",
           middle: str = "NORMAL") -> DataFrame:
    """One ordered series with its unusual rows marked."""
    return df.where(where).select(*columns, (F.col(label) != middle).alias("is_marked")).orderBy(*order)


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """A repeatable sample of n rows, the same on any partitioning."""
    mark = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(mark, *key).limit(n)


def head(df: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all tables; a column missing somewhere is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()

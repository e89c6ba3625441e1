"""Per-group scores, gap filling, ranks and deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import settle
from harvestlens.operators import ordered
from harvestlens.operators.joins import attach


def group_stats(df: DataFrame, keys: list[str], value: str, *, mean: str = "mean", std: str = "std", low: str = "min",
                high: str = "max", count: str = "count") -> DataFrame:
    """Sample statistics per group; groups with a null key are left out (A3)."""
    return df.na.drop(subset=keys).groupBy(*keys).agg(
        F.avg(value).alias(mean), F.stddev_samp(value).alias(std), F.min(value).alias(low),
        F.max(value).alias(high), F.count(value).alias(count))


def with_aggregates(df: DataFrame, keys: list[str], aggregates: dict[str, Column], *,
                    bound: int | None = None) -> DataFrame:
    """Group aggregates on every row: combined on the map side, then joined back; null keys get nulls.

    A table whose row count ``bound`` is known to fit one task is windowed instead.
    """
    if bound is not None and bound <= ordered.TASK_ROWS:
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        w = Window.partitionBy(*keys)
        return df.withColumns({name: F.when(known, a.over(w)) for name, a in aggregates.items()})
    stats = df.na.drop(subset=keys).groupBy(*keys).agg(
        *[a.alias(name) for name, a in aggregates.items()], F.count("*").alias("__weight"))
    return attach(df, stats, keys, weight="__weight").drop("__weight")


def with_group_stats(df: DataFrame, keys: list[str], value: str, names: dict[str, str]) -> DataFrame:
    """Chosen statistics of a column on every row."""
    known = {"mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value),
             "count": F.count(value)}
    return with_aggregates(df, keys, {out: known[name] for name, out in names.items()})


def group_zscore(df: DataFrame, keys: list[str], value: str, out: str, *, epsilon: float = 0.0,
                 digits: int | None = None) -> DataFrame:
    """(x - group mean) / (sample std + epsilon); a one-row or, without epsilon, constant group gives null."""
    scored = with_group_stats(df, keys, value, {"mean": "__mean", "std": "__std"})
    z = F.try_divide(F.col(value) - F.col("__mean"), F.col("__std") + epsilon)
    return scored.withColumn(out, z if digits is None else settle(z, digits)).drop("__mean", "__std")


def group_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Largest value of the group on every row."""
    return with_group_stats(df, keys, value, {"max": out})


def fill_gaps(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], *,
              task_rows: int = ordered.TASK_ROWS, bound: int | None = None) -> DataFrame:
    """Linear by row position inside, nearest value at both ends; all-null stays null."""
    near = ordered.nearest_known(df, keys, order, columns, task_rows=task_rows, bound=bound)

    def filled(c: str) -> Column:
        before, after, at = F.col(f"__prev_{c}"), F.col(f"__next_{c}"), F.col("__pos")
        between = before["v"] + (after["v"] - before["v"]) * (at - before["p"]) / (after["p"] - before["p"])
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(before.isNotNull() & after.isNotNull(), between)
            .otherwise(F.coalesce(before["v"], after["v"]))
        )

    return near.withColumns({c: filled(c) for c in columns}).select(*df.columns)


def leave_one_out_z(df: DataFrame, keys: list[str], value: str, out: str, *,
                    task_rows: int = ordered.TASK_ROWS) -> DataFrame:
    """(x - median of the others) / (IQR of the others / 1.349).

    With the group sorted as a[0..n-1], the j-th of the others is a[j] when x > a[j] and a[j+1]
    when not, whichever copy of x is taken out. So a row needs no rank of its own: a handful of
    order statistics per group, joined back, decide it.
    """
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    rest_last = F.col("__n") - 2  # last position among the others
    wanted = {}
    for name, p in probs.items():
        low = F.floor(rest_last * F.lit(p))
        high = F.least(low + 1, rest_last)
        wanted |= {f"__{name}_l0": low, f"__{name}_l1": low + 1, f"__{name}_h0": high, f"__{name}_h1": high + 1}
    stats = ordered.order_statistics(df, keys, value, wanted, task_rows=task_rows)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__weight"))
    stats = sizes.join(stats, keys, "inner")
    rows = attach(df, stats, keys, weight="__weight")
    x = F.col(value)

    def other(name: str) -> Column:
        return F.when(x > F.col(f"{name}0"), F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    def quantile(name: str, p: float) -> Column:
        low, high = other(f"__{name}_l"), other(f"__{name}_h")
        return low + (high - low) * (rest_last * F.lit(p) - F.floor(rest_last * F.lit(p)))

    rows = rows.withColumns({f"__{name}": quantile(name, p) for name, p in probs.items()})
    iqr = F.col("__q3") - F.col("__q1")
    z = F.when(x.isNull() | (F.col("__n") < 2), F.lit(None).cast("double")).when(iqr == 0, F.lit(0.0)).otherwise(
        F.try_divide(x - F.col("__q2"), iqr / config.IQR_TO_SIGMA))
    return rows.withColumn(out, z).select(*df.columns, out)


def tie_ranks(df: DataFrame, keys: list[str], value: str, out: str, *, task_rows: int = ordered.TASK_ROWS) -> DataFrame:
    """Average-ties rank from 1; null values have no rank."""
    ranks = ordered.average_ranks(ordered.value_counts(df, keys, value), keys, value, out, task_rows=task_rows)
    return attach(df, ranks, [*keys, value], weight="__copies").drop("__copies")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, *, rank: str | None = None) -> DataFrame:
    """First n rows per group (W6). Spark limits each group to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)
    return kept.withColumnRenamed("__rank", rank) if rank else kept.drop("__rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order.

    An ordered row number limited to 1 keeps one row per key and task before the shuffle, so
    a key with many copies costs no task more than any other.
    """
    return top_n(df, keys, order, 1)

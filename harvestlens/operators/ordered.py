"""Exact ordered computations inside groups of any size.

A window over a group puts the whole group into one task. That is right when the largest group
was measured and is small. Beyond that the rows are range-partitioned on (keys, order) into
blocks, each block is worked on alone, and what crosses a block border is carried over from a
per-block summary. A block holds at most one group that began in an earlier block, so the carried
rows number at most two per block, however large the groups are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from harvestlens.operators.joins import attach
from harvestlens.session import cut

TASK_ROWS = 1_000_000
BLOCK = "__block"


def group_profile(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group); the counts are combined before the shuffle."""
    row = (
        df.groupBy(*keys).agg(F.count("*").alias("__n"))
        .agg(F.sum("__n").alias("total"), F.max("__n").alias("largest")).first()
    )
    return int(row["total"] or 0), int(row["largest"] or 0)


def _blocks(df: DataFrame, keys: list[str], order: list[Column], total: int, task_rows: int) -> DataFrame:
    """Rows tagged with the number of their contiguous (keys, order) range, written out.

    Range bounds are sampled anew by every plan that asks for them, so the tags are fixed by
    a checkpoint before two branches read them.
    """
    count = max(1, math.ceil(total / task_rows))
    ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *order)
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _null_safe(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the per-border rows (at most two per block) on block and keys."""
    renamed = carry.withColumnsRenamed({k: f"__c_{k}" for k in [BLOCK, *keys]})
    condition = F.col(BLOCK) == F.col(f"__c_{BLOCK}")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    return df.join(F.broadcast(renamed), condition, "left").drop(*[f"__c_{k}" for k in [BLOCK, *keys]])


def running(df: DataFrame, keys: list[str], order: list[Column], measures: dict[str, Column], *,
            task_rows: int = TASK_ROWS, profile: tuple[int, int] | None = None) -> DataFrame:
    """Add, per measure, its sum over the rows that come earlier in the group (0 for the first).

    ``order`` must rank the rows of a group without ties that matter. ``profile`` is the ``group_profile`` of
    ``df`` where it is known already.
    """
    total, largest = profile or group_profile(df, keys)
    if largest <= task_rows:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({
            name: F.coalesce(F.sum(amount).over(before), F.lit(0)) for name, amount in measures.items()
        })
    blocks = _blocks(df, keys, order, total, task_rows)
    inside = Window.partitionBy(BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(BLOCK, *keys).agg(*[F.sum(a).alias(f"__t_{n}") for n, a in measures.items()])
    carry = sums.select(
        BLOCK, *keys, F.count("*").over(earlier).alias("__earlier"),
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in measures],
    ).where("__earlier > 0").drop("__earlier")
    local = blocks.withColumns({f"__l_{n}": F.sum(a).over(inside) for n, a in measures.items()})
    joined = _null_safe(local, carry, keys)
    return joined.withColumns({
        n: F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__b_{n}"), F.lit(0)) for n in measures
    }).drop(BLOCK, *[f"__l_{n}" for n in measures], *[f"__b_{n}" for n in measures])


def positions(df: DataFrame, keys: list[str], order: list[Column], out: str = "pos", *,
              task_rows: int = TASK_ROWS) -> DataFrame:
    """0-based row position inside the group; with no keys, inside the whole table."""
    return running(df, keys, order, {out: F.lit(1).cast("long")}, task_rows=task_rows)


def _so_far(group: WindowSpec, order: str, backwards: bool = False) -> WindowSpec:
    """Frame from one end of the group to the row. Looking ahead is looking back in the opposite
    order: a frame that ends at the last row would be computed anew for every row."""
    by = F.col(order).desc() if backwards else F.col(order)
    return group.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)


def nearest_known(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], *,
                  task_rows: int = TASK_ROWS, bound: int | None = None) -> DataFrame:
    """Add ``__pos`` and, per column, the closest non-null (position, value) at or before and at or after.

    ``bound`` is a row count of ``df`` known already; when it is small, no group needs to be measured.
    """
    def marks(pos: Column, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(pos.alias("p"), F.col(c).alias("v")))

    total, largest = (bound, bound) if bound is not None and bound <= task_rows else group_profile(df, keys)
    if largest <= task_rows:
        w = Window.partitionBy(*keys)
        ranked = df.withColumn("__pos", F.row_number().over(w.orderBy(*order)).cast("long"))
        return ranked.withColumns({
            f"__{side}_{c}": F.last(marks(F.col("__pos"), c), True).over(frame)
            for side, frame in (("prev", _so_far(w, "__pos")), ("next", _so_far(w, "__pos", backwards=True)))
            for c in columns
        })
    blocks = _blocks(df, keys, order, total, task_rows)
    w = Window.partitionBy(BLOCK, *keys)
    local = blocks.withColumn("__lp", F.row_number().over(w.orderBy(*order)).cast("long"))
    # Structs compare by position first, so min and max give the first and last known value.
    summary = local.groupBy(BLOCK, *keys).agg(
        F.count("*").alias("__n"),
        *[F.min(marks(F.col("__lp"), c)).alias(f"__f_{c}") for c in columns],
        *[F.max(marks(F.col("__lp"), c)).alias(f"__t_{c}") for c in columns],
    )
    by_group = Window.partitionBy(*keys)
    earlier = by_group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = by_group.orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    spanning = summary.withColumns({
        "__off": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
        "__blocks": F.count("*").over(Window.partitionBy(*keys)),
    }).where("__blocks > 1")

    def shifted(name: str) -> Column:
        mark = F.col(name)
        return F.when(mark.isNotNull(), F.struct((mark["p"] + F.col("__off")).alias("p"), mark["v"].alias("v")))

    carry = spanning.select(
        BLOCK, *keys, "__off",
        *[F.last(shifted(f"__t_{c}"), True).over(earlier).alias(f"__cp_{c}") for c in columns],
        *[F.last(shifted(f"__f_{c}"), True).over(later).alias(f"__cn_{c}") for c in columns],
    )
    local = local.withColumns({
        f"__{side}_{c}": F.last(marks(F.col("__lp"), c), True).over(frame)
        for side, frame in (("lb", _so_far(w, "__lp")), ("la", _so_far(w, "__lp", backwards=True)))
        for c in columns
    })
    joined = _null_safe(local, carry, keys).withColumn("__off", F.coalesce("__off", F.lit(0)))
    out = joined.withColumns(
        {"__pos": F.col("__lp") + F.col("__off")}
        | {f"__prev_{c}": F.coalesce(shifted(f"__lb_{c}"), F.col(f"__cp_{c}")) for c in columns}
        | {f"__next_{c}": F.coalesce(shifted(f"__la_{c}"), F.col(f"__cn_{c}")) for c in columns}
    )
    return out.drop(BLOCK, "__lp", "__off", *[f"__{t}_{c}" for t in ("lb", "la", "cp", "cn") for c in columns])


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Copies of one value collapse on the map side before anything is ordered."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__copies"))


def average_ranks(counts: DataFrame, keys: list[str], value: str, out: str, *, copies: str = "__copies",
                  task_rows: int = TASK_ROWS, profile: tuple[int, int] | None = None) -> DataFrame:
    """Average-ties rank of every distinct value, from (keys, value, copies)."""
    ranked = running(counts, keys, [F.col(value)], {"__before": F.col(copies)}, task_rows=task_rows, profile=profile)
    return ranked.withColumn(out, F.col("__before") + (F.col(copies) + 1) / 2.0).drop("__before")


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Column], *,
                     task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per group: ``__n`` non-null values and the values at the wanted 0-based positions.

    A position is an expression over ``__n``; positions outside the group give null.
    """
    counts = cut(value_counts(df, keys, value))
    profile = group_profile(counts, keys)
    ranked = running(counts, keys, [F.col(value)], {"__before": F.col("__copies")}, task_rows=task_rows, profile=profile)
    if profile[1] <= task_rows:
        ranked = ranked.withColumn("__n", F.sum("__copies").over(Window.partitionBy(*keys)))
    else:
        sizes = counts.groupBy(*keys).agg(F.sum("__copies").alias("__n"), F.count("*").alias("__weight"))
        if keys:
            ranked = attach(ranked, sizes, keys, weight="__weight", null_safe=True)
        else:
            ranked = ranked.withColumn("__n", sizes.select("__n").scalar())
    hit = {
        name: (F.col("__before") <= at) & (at < F.col("__before") + F.col("__copies"))
        for name, at in wanted.items()
    }
    return ranked.groupBy(*keys).agg(
        F.max("__n").alias("__n"), *[F.max(F.when(test, F.col(value))).alias(name) for name, test in hit.items()])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *,
                      task_rows: int = TASK_ROWS) -> DataFrame:
    """Linear-interpolation percentiles per group, without gathering a group."""
    last = F.col("__n") - 1
    wanted = {}
    for name, p in probs.items():
        low = F.floor(last * F.lit(p))
        wanted[f"__lo_{name}"] = low
        wanted[f"__hi_{name}"] = F.least(low + 1, last)
    found = order_statistics(df, keys, value, wanted, task_rows=task_rows)
    return found.select(*keys, F.col("__n"), *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))
         * (last * F.lit(p) - F.floor(last * F.lit(p)))).alias(n)
        for n, p in probs.items()
    ])

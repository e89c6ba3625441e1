"""Joins of the weather, yield and county tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.session import cut

LOOKUP_ROWS = 500_000
HOT_SHARE = 1000
HOT_SLOTS = 64


def is_small(df: DataFrame, rows: int = LOOKUP_ROWS) -> bool:
    """Whether the table has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], *, weight: str, how: str = "left",
           null_safe: bool = False, small: int = LOOKUP_ROWS) -> DataFrame:
    """N:1 join where ``weight`` says how many rows of ``df`` belong to each lookup row.

    The lookup is written out first, so its size is known: a small one is broadcast and no row of
    ``df`` moves. Otherwise keys that hold more than a thousandth of all rows, which number fewer
    than a thousand, are broadcast and the rest is joined by shuffle. Rows of those hot keys are spread
    over slots there, where nothing matches them, so that no task receives them all.
    """
    lookup = cut(lookup)
    if lookup.count() <= small:
        right = F.broadcast(lookup.withColumnsRenamed({k: f"__k_{k}" for k in keys}))
        if weight in df.columns:
            right = right.drop(weight)
        condition = F.lit(True)
        for k in keys:
            condition = condition & (
                F.col(k).eqNullSafe(F.col(f"__k_{k}")) if null_safe else F.col(k) == F.col(f"__k_{k}"))
        return df.join(right, condition, how).drop(*[f"__k_{k}" for k in keys])
    values = [c for c in lookup.columns if c not in keys]
    total = lookup.agg(F.sum(weight)).scalar()
    ranked = lookup.withColumn("__hot", F.col(weight) * HOT_SHARE > total)
    hot = ranked.where("__hot").withColumnsRenamed({c: f"__h_{c}" for c in values} | {k: f"__k_{k}" for k in keys})

    def match(left: DataFrame, right: DataFrame, extra: list[tuple[str, str]]) -> DataFrame:
        condition = F.lit(True)
        for a, b in [(k, f"__k_{k}") for k in keys] + extra:
            condition = condition & (F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b))
        return left.join(right, condition, "left")

    first = match(df, F.broadcast(hot), []).drop(*[f"__k_{k}" for k in keys])
    no_key = F.lit(False)
    for k in [] if null_safe else keys:  # rows that match nothing need no common task either
        no_key = no_key | F.col(k).isNull()
    spread = first.withColumn("__slot", F.when(
        F.col("__hot") | no_key, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SLOTS))).otherwise(F.lit(0).cast("long")))
    cold = (
        ranked.where("not __hot").drop("__hot").withColumn("__cold_slot", F.lit(0).cast("long"))
        .withColumnsRenamed({k: f"__k_{k}" for k in keys} | {c: f"__c_{c}" for c in values})
        .withColumn("__cold", F.lit(True))
    )
    both = match(spread, cold, [("__slot", "__cold_slot")])
    if how == "inner":
        both = both.where(F.col("__hot") | F.col("__cold"))
    picked = [
        F.when(F.col("__hot"), F.col(f"__h_{c}")).otherwise(F.col(f"__c_{c}")).alias(c)
        for c in values if c != weight
    ]
    kept = [F.col(weight)] if weight in df.columns else []
    if not kept:
        picked.append(F.when(F.col("__hot"), F.col(f"__h_{weight}")).otherwise(F.col(f"__c_{weight}")).alias(weight))
    return both.select(*[F.col(c) for c in df.columns], *picked)


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", *,
                rows: int = LOOKUP_ROWS) -> DataFrame:
    """N:1 equi-join; the lookup is broadcast only when it was counted to be small.

    The lookup is read twice, so it should be a table or cut.
    A larger lookup is shuffled with the rows counted per key first, so hot keys are split.
    """
    if how in ("left_semi", "left_anti"):
        return df.join(F.broadcast(lookup) if is_small(lookup, rows) else lookup, keys, how)
    if is_small(lookup, rows):
        return df.join(F.broadcast(lookup), keys, how)
    load = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    weighted = lookup.join(load, keys, "left").withColumn("__rows", F.coalesce("__rows", F.lit(0)))
    return attach(df, weighted, keys, weight="__rows", how=how).drop("__rows")


def with_centroids(yields: DataFrame, centroids: DataFrame, key: str = "fips") -> DataFrame:
    """Yields with lat/lon; unmatched keys keep nulls."""
    if key not in yields.columns:
        raise KeyError(f"no column {key!r}; build the county key first")
    return lookup_join(yields, centroids.select(key, "lat", "lon"), [key], "left")


def merge_weather(yields: DataFrame, weather: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Yield rows with the season of their county and year."""
    return lookup_join(yields, weather, keys or ["fips", "year"], "inner")


def map_rows(df: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Keep rows whose key is mapped and add the mapping."""
    return lookup_join(df, mapping, keys, "inner")


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work rows with no finished counterpart."""
    return lookup_join(work, cut(done.select(*keys).distinct()), keys, "left_anti")


def work_list(locations: DataFrame, years: list[int], *, key: str = "fips") -> DataFrame:
    """Every located key times every year, as an explode per row."""
    return locations.where(F.col("lat").isNotNull()).select(
        key, "lat", "lon", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))


def county_snapshot(df: DataFrame, year: int, crop: str, columns: list[str], *, required: str,
                    crop_column: str = "commodity_name") -> DataFrame:
    """Attributes of the counties of one crop and year."""
    return df.where((F.col("year") == year) & (F.col(crop_column) == crop)).select(*columns).na.drop(subset=[required])

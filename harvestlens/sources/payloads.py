"""Daily rows out of JSON answers kept as text, one per location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens import schemas
from harvestlens.functions.agronomy import sentinel_to_null


def daily_from_arrays(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Parallel arrays to one row per day; answers without days give no rows."""
    daily = F.from_json(F.col(payload), schemas.ARRAYS_PAYLOAD)["daily"]
    parsed = df.select(*keys, daily.alias("d")).where(F.col("d.time").isNotNull())
    # A variable that was not asked for is an empty array: zipping pads it with nulls.
    variables = [F.coalesce(F.col(f"d.{c}"), F.array().cast("array<double>")).alias(c) for c in schemas.DAILY_ARRAYS]
    zipped = F.arrays_zip(F.col("d.time").alias("time"), *variables)
    return parsed.select(*keys, F.explode(zipped).alias("z")).select(
        *keys, F.col("z.time").try_cast("date").alias("date"), *[F.col(f"z.{c}").alias(c) for c in schemas.DAILY_ARRAYS])


def daily_from_maps(df: DataFrame, payload: str, keys: list[str], *, sentinel: float = -999.0) -> DataFrame:
    """Maps of variable to day to value, as one row per answer and day; the sentinel becomes null."""
    parameter = F.from_json(F.col(payload), schemas.MAPS_PAYLOAD)["properties"]["parameter"]
    days = F.array_distinct(F.flatten(F.transform(F.map_values("p"), lambda v: F.map_keys(v))))
    rows = df.select(*keys, parameter.alias("p")).select(*keys, "p", F.explode(days).alias("day"))
    return rows.select(*keys, F.to_date("day", "yyyyMMdd").alias("date"), *[
        sentinel_to_null(F.try_element_at(F.try_element_at("p", F.lit(c)), F.col("day")), sentinel).alias(c)
        for c in schemas.DAILY_MAPS])

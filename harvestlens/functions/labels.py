"""Labels, classes and explanation text as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import fixed, present

NO_SIGNAL = "no clear weather signal — investigate non-meteorological factors"


def direction(z: Column, threshold: float = config.Z_THRESHOLD, low: str = "LOW", high: str = "HIGH",
              middle: str = "NORMAL") -> Column:
    """Three-way label; null takes the middle one."""
    return F.when(z < -threshold, low).when(z > threshold, high).otherwise(middle)


def residual_direction(z: Column, threshold: float = config.Z_THRESHOLD) -> Column:
    return direction(z, threshold, "UNEXPLAINED_LOW", "UNEXPLAINED_HIGH", "WEATHER_EXPLAINED")


def two_sided_flag(z: Column, threshold: float = config.Z_THRESHOLD) -> Column:
    return F.coalesce(F.abs(z) > threshold, F.lit(False))


def low_flag(z: Column, threshold: float = config.Z_THRESHOLD) -> Column:
    return F.coalesce(z < -threshold, F.lit(False))


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def any_flag(*flags: Column) -> Column:
    result = F.lit(False)
    for flag in flags:
        result = result | F.coalesce(flag, F.lit(False))
    return result


def anomaly_type(z: Column, r: Column, isolated: Column) -> Column:
    """Ordered precedence of the three layers."""
    z, r, isolated = (F.coalesce(f, F.lit(False)) for f in (z, r, isolated))
    return (
        F.when(z & r, "UNEXPLAINED").when(z, "WEATHER_DRIVEN").when(r, "RESIDUAL_ONLY")
        .when(isolated, "ISOLATION_ONLY").otherwise("NORMAL")
    )


def label_lookup(key: Column, labels: dict) -> Column:
    """Dictionary lookup that falls back to the key."""
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[key], key) if pairs else key


def event_name(year: Column, events: dict[int, str] = config.EXTREME_EVENTS) -> Column:
    pairs = [F.lit(item) for pair in events.items() for item in pair]
    return F.create_map(*pairs)[year] if pairs else F.lit(None).cast("string")


def weather_context(df: DataFrame, *, crop: str = "commodity_name", long_season_crop: str = "Corn",
                    events: dict[int, str] = config.EXTREME_EVENTS, wet_z: float = config.Z_THRESHOLD,
                    hot_days: float = config.HOT_DAYS, least_gdd: tuple[float, float] = config.LEAST_GDD,
                    stress: float = config.STRESS) -> Column:
    """Threshold-based remarks joined by '; ', or a default sentence. ``least_gdd`` is for the long-season crop and the others."""
    have = set(df.columns)
    parts: list[Column] = []
    if {"precip_z", "precip_total_mm"} <= have:
        detail = F.concat(F.lit("(precip "), fixed(F.col("precip_total_mm"), 0), F.lit(" mm, Z="),
                          fixed(F.col("precip_z"), 1), F.lit(")"))
        parts.append(F.when(F.col("precip_z") < -wet_z, F.concat(F.lit("drought "), detail))
                     .when(F.col("precip_z") > wet_z, F.concat(F.lit("excess moisture "), detail)))
    if "heat_stress_days" in have:
        parts.append(F.when(F.col("heat_stress_days") > hot_days, F.concat(
            F.lit("heat stress ("), fixed(F.col("heat_stress_days"), 0), F.lit(" days >35°C)"))))
    if {"gdd_base10", crop} <= have:
        least = F.when(F.col(crop) == long_season_crop, least_gdd[0]).otherwise(F.lit(least_gdd[1]))
        parts.append(F.when(F.col("gdd_base10") < least, F.concat(
            F.lit("low GDD ("), fixed(F.col("gdd_base10"), 0), F.lit(")"))))
    if "cwsi" in have:
        parts.append(F.when(F.col("cwsi") > stress, F.concat(
            F.lit("water stress (CWSI="), fixed(F.col("cwsi"), 1), F.lit(")"))))
    if "year" in have:
        parts.append(event_name(F.col("year"), events))
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", NO_SIGNAL).otherwise(text)


def driver_sentence(drivers: Column, unit: str = "bu/ac", top: int = 3) -> Column:
    """Text for the leading drivers; ``drivers`` is array<struct<feature,value>> sorted by size."""
    return F.array_join(F.transform(F.slice(drivers, 1, top), lambda d: F.concat(
        F.replace(d["feature"], F.lit("_"), F.lit(" ")),
        F.when(d["value"] > 0, " increased").otherwise(" decreased"),
        F.lit(" predicted yield by "), fixed(F.abs(d["value"]), 1), F.lit(f" {unit}"))), "; ")


def residual_sentence(gap: Column, gap_z: Column, threshold: float = config.Z_THRESHOLD, unit: str = "bu/ac") -> Column:
    """What is left after the weather effects; empty where nothing was predicted."""
    verdict = F.when(F.abs(gap_z) > threshold,
                     "this gap is statistically significant and likely non-meteorological.").otherwise(
                         "this gap is within normal prediction error.")
    text = F.concat(
        F.lit("After weather effects, actual yield was "), fixed(F.abs(gap), 1), F.lit(f" {unit} "),
        F.when(gap < 0, "below").otherwise("above"), F.lit(" the model's prediction (residual Z="),
        F.coalesce(fixed(gap_z, 2), F.lit("nan")), F.lit(") — "), verdict)
    return F.when(gap.isNull(), "").otherwise(text)


def full_explanation(z: Column, attribution: Column, gap_text: Column, context: Column) -> Column:
    """Header, non-empty parts and context joined by ' | '."""
    header = F.concat(F.lit("Unexpectedly "), F.when(z < 0, "LOW").otherwise("HIGH"), F.lit(" yield (Z="),
                      F.coalesce(fixed(z, 2), F.lit("nan")), F.lit(")"))
    return F.concat_ws(
        " | ", header,
        F.concat(F.lit("Model attribution: "), F.nullif(attribution, F.lit(""))),
        F.nullif(gap_text, F.lit("")), F.concat(F.lit("Weather context: "), context))


def effect_direction(r: Column) -> Column:
    return F.when(F.coalesce(r, F.lit(0.0)) < 0, "reduces yield").otherwise("increases yield")


def keep_present(df: DataFrame, columns: list[str] = config.ANOMALY_COLUMNS) -> DataFrame:
    return df.select(present(df, columns))

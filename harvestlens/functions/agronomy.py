"""Units, plausibility and derived indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestlens.functions.columns import clip_lower, settle

TENTHS = ["TMAX", "TMIN", "PRCP", "AWND"]


def scale_tenths(element: Column, value: Column, elements: list[str] = TENTHS) -> Column:
    return F.when(element.isin(elements), value / 10.0).otherwise(value)


def plausible(element: Column, value: Column, rain: str = "PRCP") -> Column:
    """Rain within [0, 2000], everything else within [-60, 60]."""
    return F.when(element == rain, value.between(0, 2000)).otherwise(value.between(-60, 60))


def fahrenheit_to_c(value: Column, missing_from: float = 9000.0) -> Column:
    return F.when(value < missing_from, (value - 32) * 5 / 9)


def inches_to_mm(value: Column, missing_from: float = 99.0) -> Column:
    """Missing rain counts as none."""
    return F.when(value < missing_from, value * 25.4).otherwise(F.lit(0.0))


def knots_to_ms(value: Column, missing_from: float = 999.0) -> Column:
    return F.when(value < missing_from, value * 0.514444)


def sentinel_to_null(value: Column, sentinel: float = -999.0) -> Column:
    return F.nullif(value, F.lit(sentinel))


def degree_days(average: Column, base: float = 10.0) -> Column:
    return clip_lower(average - base, 0.0)


def et0_estimate(tmax: Column, tmin: Column, tavg: Column, radiation: float = 30.0, days: int = 214) -> Column:
    """Temperature-only reference evapotranspiration over a season."""
    return F.lit(0.0023) * F.sqrt(clip_lower(tmax - tmin, 0.0)) * (tavg + 17.8) * radiation * days


def water_stress(et0: Column, precip: Column) -> Column:
    return settle(et0 / clip_lower(precip, 1.0), 3)


def heat_share(heat_days: Column, season_max_gdd: Column) -> Column:
    return settle(heat_days / clip_lower(season_max_gdd, 1.0), 4)

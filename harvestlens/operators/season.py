"""Daily observations to growing-season features (A4-A8, J7, and the cleaning of S2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions import agronomy
from harvestlens.functions.columns import blank, clip_lower, parse_date, settle
from harvestlens.operators import joins


def clean_observations(raw: DataFrame, *, months: list[int] = config.GROWING_MONTHS,
                       elements: list[str] = config.DAILY_ELEMENTS) -> DataFrame:
    """Quality-checked, scaled season observations: station_id, date, element, data_value, year."""
    dated = (
        raw.where(F.col("element").isin(elements) & blank(F.col("q_flag")))
        .withColumn("date", parse_date(F.col("date")))
        .na.drop(subset=["date", "data_value"])
        .where(F.month("date").isin(months))
    )
    scaled = dated.withColumn("data_value", agronomy.scale_tenths(F.col("element"), F.col("data_value")))
    kept = scaled.where(agronomy.plausible(F.col("element"), F.col("data_value")))
    year = F.col("year") if "year" in raw.columns else F.year("date")
    return kept.select("station_id", "date", "element", "data_value", year.cast("int").alias("year"))


def station_days(obs: DataFrame, *, dry_mm: float = config.DRY_MM) -> DataFrame:
    """One row per station and day, temperatures side by side."""
    def of(element: str) -> Column:
        return F.when(F.col("element") == element, F.col("data_value"))

    return obs.groupBy("station_id", "year", "date").agg(
        F.avg(of("TMAX")).alias("tmax"), F.avg(of("TMIN")).alias("tmin"),
        F.sum(of("PRCP")).alias("rain"), F.count_if(of("PRCP") < dry_mm).alias("dry"),
        F.sum(of("AWND")).alias("wind"), F.count(of("AWND")).alias("wind_n"))


def station_seasons(obs: DataFrame, *, min_days: int = config.MIN_COMMON_DAYS, heat_c: float = config.HEAT_C,
                    dry_mm: float = config.DRY_MM, base_c: float = config.GDD_BASE_C) -> DataFrame:
    """Season of every station with enough days that have both temperatures (A4)."""
    days = station_days(obs, dry_mm=dry_mm)
    both = F.col("tmax").isNotNull() & F.col("tmin").isNotNull()
    mean = (F.col("tmax") + F.col("tmin")) / 2
    seasons = days.groupBy("station_id", "year").agg(
        F.count_if(both).alias("common_days"),
        settle(F.avg(F.when(both, F.col("tmax"))), 2).alias("tmax_mean_c"),
        settle(F.avg(F.when(both, F.col("tmin"))), 2).alias("tmin_mean_c"),
        settle(F.avg(mean), 2).alias("tavg_mean_c"),
        settle(F.coalesce(F.sum("rain"), F.lit(0.0)), 1).alias("precip_total_mm"),
        settle(F.coalesce(F.sum(agronomy.degree_days(mean, base_c)), F.lit(0.0)), 1).alias("gdd_base10"),
        F.count_if(both & (F.col("tmax") > heat_c)).alias("heat_stress_days"),
        F.sum("dry").alias("drought_days"),
        settle(F.try_divide(F.sum("wind"), F.sum("wind_n")), 2).alias("wind_mean_ms"),
    )
    return seasons.where(F.col("common_days") >= min_days).drop("common_days").withColumns(
        {"et0_total_mm": F.lit(None).cast("double"), "solar_total_mj": F.lit(None).cast("double")})


def mapped_seasons(obs: DataFrame, mapping: DataFrame, *, key: str = "station_id", **options) -> DataFrame:
    """County seasons of cleaned observations; ``mapping`` has the station and its county.

    Rows of other stations go before the shuffle; the county is added to the few rows after it.
    """
    ours = joins.lookup_join(obs, mapping.select(key), [key], "left_semi")
    return county_seasons(joins.map_rows(station_seasons(ours, **options), mapping, [key]))


def county_seasons(stations: DataFrame, *, key: str = "fips") -> DataFrame:
    """Unweighted mean over the stations of a county and year (A5)."""
    measures = [c for c in stations.columns if c not in ("station_id", "year", key)]
    return stations.groupBy(key, "year").agg(*[F.avg(c).alias(c) for c in measures])


def _sum0(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(0.0)


def season_from_arrays(daily: DataFrame, *, keys: tuple[str, ...] = ("fips", "year"), heat_c: float = config.HEAT_C,
                       dry_mm: float = config.DRY_MM, base_c: float = config.GDD_BASE_C) -> DataFrame:
    """Season of wide daily rows with gridded variables (A6); absent optional columns count as 0."""
    tmax, tmin, rain = F.col("temperature_2m_max"), F.col("temperature_2m_min"), F.col("precipitation_sum")
    mean = (tmax + tmin) / 2.0
    return daily.groupBy(*keys).agg(
        F.avg(tmax).alias("tmax_mean_c"), F.avg(tmin).alias("tmin_mean_c"), F.avg(mean).alias("tavg_mean_c"),
        _sum0(rain).alias("precip_total_mm"), _sum0(agronomy.degree_days(mean, base_c)).alias("gdd_base10"),
        F.count_if(tmax > heat_c).alias("heat_stress_days"), F.count_if(rain < dry_mm).alias("drought_days"),
        _sum0(_optional(daily, "et0_fao_evapotranspiration")).alias("et0_total_mm"),
        _sum0(_optional(daily, "shortwave_radiation_sum")).alias("solar_total_mj"),
        F.avg(_optional(daily, "windgusts_10m_max")).alias("wind_max_mean_ms"))


def season_from_maps(daily: DataFrame, *, keys: tuple[str, ...] = ("fips", "year"), heat_c: float = config.HEAT_C,
                     dry_mm: float = config.DRY_MM, base_c: float = config.GDD_BASE_C) -> DataFrame:
    """Season of wide daily rows with agro-climate variables (A7); rain is clipped at 0."""
    def have(name: str) -> Column:
        return F.col(name) if name in daily.columns else F.lit(None).cast("double")

    tmax, tmin, rain = have("T2M_MAX"), have("T2M_MIN"), clip_lower(have("PRECTOTCORR"), 0.0)
    mean = (tmax + tmin) / 2.0
    return daily.groupBy(*keys).agg(
        F.avg(tmax).alias("tmax_mean_c"), F.avg(tmin).alias("tmin_mean_c"), F.avg(mean).alias("tavg_mean_c"),
        _sum0(rain).alias("precip_total_mm"), _sum0(agronomy.degree_days(mean, base_c)).alias("gdd_base10"),
        F.count_if(tmax > heat_c).alias("heat_stress_days"), F.count_if(rain < dry_mm).alias("drought_days"),
        _sum0(have("ALLSKY_SFC_SW_DWN")).alias("solar_total_mj"),
        F.avg(_optional(daily, "RH2M")).alias("rh_mean_pct"), F.avg(_optional(daily, "WS2M")).alias("wind_mean_ms"),
        F.lit(None).cast("double").alias("et0_total_mm"))


def season_pooled(daily: DataFrame, *, keys: tuple[str, ...] = ("fips", "year"), heat_c: float = config.HEAT_C,
                  dry_mm: float = config.DRY_MM, base_c: float = config.GDD_BASE_C) -> DataFrame:
    """Season over all station-days of a county (A8): sums grow with the number of stations."""
    tmax, tmin, rain = F.col("tmax_c"), F.col("tmin_c"), F.coalesce("prcp_mm", F.lit(0.0))
    mean = (tmax + tmin) / 2
    pooled = daily.groupBy(*keys).agg(
        F.avg(tmax).alias("tmax_mean_c"), F.avg(tmin).alias("tmin_mean_c"), F.avg(mean).alias("tavg_mean_c"),
        F.sum(rain).alias("precip_total_mm"), _sum0(agronomy.degree_days(mean, base_c)).alias("gdd_base10"),
        F.count_if(tmax > heat_c).alias("heat_stress_days"), F.count_if(rain < dry_mm).alias("drought_days"),
        F.avg("wdsp_ms").alias("wind_mean_ms"),
        F.lit(None).cast("double").alias("et0_total_mm"), F.lit(None).cast("double").alias("solar_total_mj"))
    return pooled.where(F.col("tmax_mean_c").isNotNull() & F.col("tmin_mean_c").isNotNull())


def pooled_units(raw: DataFrame, *, years: list[int] | None = None,
                 months: list[int] = config.GROWING_MONTHS) -> DataFrame:
    """Unit conversion and sentinel handling of the wide daily station table (P13, with P7 and P9)."""
    kept = raw.where(F.col("mo").isin(months) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if years is not None:
        kept = kept.where(F.col("year").isin(years))
    return kept.select(
        "stn", "year", F.col("mo").alias("month"), F.col("da").alias("day"), "lat", "lon",
        agronomy.fahrenheit_to_c(F.col("max")).alias("tmax_c"), agronomy.fahrenheit_to_c(F.col("min")).alias("tmin_c"),
        agronomy.fahrenheit_to_c(F.col("temp")).alias("tavg_c"), agronomy.inches_to_mm(F.col("prcp")).alias("prcp_mm"),
        agronomy.knots_to_ms(F.col("wdsp")).alias("wdsp_ms"))

"""The datasets behind the dashboard, the charts and the two reports, from the written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions import labels
from harvestlens.operators import correlation, joins, reports, windows
from harvestlens.session import cut
from harvestlens.sources import tables

FEED = ["year", "fips", "county_name", "state_abbr", "commodity_name", "yield_bu_ac", "xgb_predicted_yield", "xgb_residual",
        "yield_z_robust", "anomaly_type", "explanation"]


def dashboard_datasets(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    """The four dashboard datasets; ``names`` maps merged, correlations, importance and anomalies to tables."""
    tables.require_tables(spark, list(names.values()))
    merged, corr, importance, anomalies = (spark.table(names[n]) for n in ("merged", "correlations", "importance", "anomalies"))
    return {
        "importance": reports.ranked_view(importance, ["crop", "feature", "shap_mean_abs", "xgb_importance"], "shap_mean_abs"),
        "correlations": reports.ranked_view(corr, ["crop", "feature", "pearson_r", "spearman_r", "abs_pearson"], "abs_pearson"),
        "yield_trend": reports.yield_trend(merged),
        "anomalies": reports.anomaly_feed(anomalies, FEED, ties=("fips", "commodity_name", "irr_name")),
    }


def top_drivers(importance: DataFrame, corr: DataFrame, n: int = 3) -> DataFrame:
    """Leading features per crop, with a readable label and the direction of their effect."""
    top = windows.top_n(importance, ["crop"], [F.col("shap_mean_abs").desc(), F.col("feature")], n, rank="rank")
    signed = joins.lookup_join(top, cut(corr.select("crop", "feature", "pearson_r")), ["crop", "feature"], "left")
    return signed.select(
        "crop", "rank", "feature", labels.label_lookup(F.col("feature"), config.FEATURE_LABELS).alias("label"),
        "shap_mean_abs", labels.effect_direction(F.col("pearson_r")).alias("effect"))


def chart_datasets(merged: DataFrame, scored: DataFrame, *, crop: str = "Corn", states: list[str] = config.FOCUS_STATES,
                   years: list[int] | None = None, sample: int = 500) -> dict[str, DataFrame]:
    """Inputs of the heat maps, scatter lines, yearly bands, box plots and sample scatter of one crop."""
    years = years or list(range(config.YEAR_MIN, config.YEAR_MAX + 1))
    rows = merged.where(F.col("commodity_name") == crop)
    focus = rows.where(F.col("state_abbr").isin(states))
    pairs = rows.na.drop(subset=["precip_total_mm", "yield_bu_ac"])
    return {
        "heat_by_state": reports.mean_pivot(focus, "state_abbr", "year", years, "heat_stress_days", missing=0.0),
        "rain_by_state": reports.mean_pivot(focus, "state_abbr", "year", years, "precip_z"),
        "gdd_line": correlation.trend_line(focus, "commodity_name", "gdd_base10", "yield_bu_ac"),
        "yearly_band": reports.mean_and_std(rows, ["year"], "yield_bu_ac"),
        "yearly_box": reports.five_numbers(rows, ["year"], "yield_bu_ac"),
        "flagged_by_year": reports.flag_sum(scored, ["year"], "is_anomaly", "flagged"),
        "rain_sample": reports.seeded_sample(pairs, ["fips", "irr_name", "year"], sample, 42),
        "top_counties": reports.top_keys(scored, "fips", "is_anomaly"),
    }


def map_dataset(scored: DataFrame, year: int, crop: str) -> DataFrame:
    """County scores of one year and crop for a map; the plain z-score where there is no robust one."""
    if "yield_zscore" in scored.columns:
        scored = scored.withColumn("yield_z_robust", F.coalesce("yield_z_robust", "yield_zscore"))
    return joins.county_snapshot(scored, year, crop, ["fips", "yield_z_robust", "yield_bu_ac", "county_name", "state_abbr"],
                                 required="yield_z_robust")


def county_series(scored: DataFrame, fips: str, crop: str = "Corn") -> DataFrame:
    """The yields of one county over the years, with the marks of unusual ones."""
    return reports.series(scored, (F.col("fips") == fips) & (F.col("commodity_name") == crop), [F.col("year"), F.col("irr_name")],
                          ["year", "irr_name", "yield_bu_ac"])


def county_charts(scored: DataFrame, *, crops: tuple[str, ...] = ("Corn", "Soybeans"), n: int = 6) -> dict[str, DataFrame]:
    """Per crop the yields of the counties with most flagged rows, the counties one after the other.

    Where no row is flagged, these are the counties with most rows.
    """
    top = reports.top_keys(scored.where("is_anomaly"), "fips", "is_anomaly", n)
    if top.isEmpty():
        top = reports.top_keys(scored, "fips", None, n)
    rows = scored.join(F.broadcast(top), "fips")  # n rows
    order = [F.col("score").desc(), F.col("fips"), F.col("year"), F.col("irr_name")]
    names = ["fips", "county_name", "state_abbr", "year", "irr_name", "yield_bu_ac"]
    return {crop: reports.series(rows, F.col("commodity_name") == crop, order, names) for crop in crops}


def anomaly_report(scored: DataFrame, *, event_year: int = 2012, worst: int = 5) -> dict[str, DataFrame]:
    """Tables of the anomaly findings: totals, types, years, worst unexplained rows and the event review."""
    flagged = scored.where("is_anomaly")
    by_year = reports.count_pivot(flagged, "year", "anomaly_type", config.ANOMALY_TYPES)
    return {
        "totals": reports.layer_overlap(scored),
        "types": reports.value_shares(flagged, "anomaly_type"),
        "types_by_crop": reports.value_shares(flagged, "anomaly_type", ["commodity_name"]),
        "by_year": by_year.withColumn("event", labels.event_name(F.col("year"))).orderBy("year"),
        "worst_unexplained": windows.top_n(
            flagged.where("anomaly_type = 'UNEXPLAINED'"), ["commodity_name"],
            [F.col("xgb_residual"), F.col("fips"), F.col("year"), F.col("irr_name")], worst, rank="rank"),
        "event_review": reports.event_review(scored, event_year),
        "event_flags": reports.event_flags(scored, event_year),
        "event_mean_z": reports.mean_by(scored.where(F.col("year") == event_year), ["commodity_name"], "yield_z_robust", 2, "mean_z"),
        "directions_by_year": reports.count_pivot(scored, "year", "z_direction", ["LOW", "NORMAL", "HIGH"]),
        "types_of_crops": reports.count_pivot(flagged, "commodity_name", "anomaly_type", config.ANOMALY_TYPES),
        "mean_residual": reports.mean_by(scored, ["year"], "xgb_residual", 2, "mean_residual"),
        "unexplained_by_year": reports.count_by(flagged, ["year"], where=F.col("anomaly_type") == "UNEXPLAINED"),
    }

"""The three batch entries, each reading tables and writing tables.

Between the entries results are written, as the operators read their input more than once and a
written table also lets a failed run start from the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions import agronomy, labels
from harvestlens.functions.columns import active_features, settle
from harvestlens.operators import attribution, boosting, correlation, joins, layers, neighbours, reports, season, windows
from harvestlens.session import cut, in_scratch_space, scratch_path
from harvestlens.sources import files, payloads, tables

def publish(spark: SparkSession, catalog: str | None, name: str, path: str, fmt: str) -> None:
    """Register a written table as ``catalog.name``, if a catalog schema is given."""
    if catalog:
        tables.register(spark, f"{catalog}.{name}", path, fmt)


BAND = ("fips", "commodity_name", "irr_name")


@in_scratch_space
def yields_table(spark: SparkSession, yield_csv: str, centroids: DataFrame, out: str, *, quality: str | None = None,
                 catalog: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Yield CSV to the ``yields`` table: county key, position, group statistics, z-score.

    With a folder ``quality`` the quality tables are written there, too.
    """
    rows = joins.with_centroids(files.read_yields(spark, yield_csv), centroids)
    tables.write_table(yield_statistics(rows), out, partition_by=["commodity_name", "year"], fmt=fmt)
    publish(spark, catalog, "yields", out, fmt)
    yields = tables.read_table(spark, out, fmt)
    if quality:
        for name, table in yield_quality(yields).items():
            tables.write_table(table, f"{quality}/{name}", fmt=fmt)
            publish(spark, catalog, f"yields_{name}", f"{quality}/{name}", fmt)
    return yields


def yield_quality(yields: DataFrame) -> dict[str, DataFrame]:
    """Quality tables of Entry 1: the profile, the crops, a description per crop, values present and missing."""
    return {
        "profile": reports.profile(yields, distinct=["fips", "commodity_name", "state_abbr"]),
        "crops": reports.distinct_values(yields, "commodity_name"),
        "description": reports.describe(yields, ["commodity_name"], ["yield_bu_ac"], 2),
        "coverage": reports.coverage(yields, "lat"),
    }


def yield_statistics(rows: DataFrame, keys: tuple[str, ...] = BAND, value: str = "yield_bu_ac") -> DataFrame:
    stats = windows.with_group_stats(rows, list(keys), value, {
        "mean": "yield_mean", "std": "yield_std", "min": "min", "max": "max", "count": "n_years"})
    z = F.try_divide(F.col(value) - F.col("yield_mean"), F.col("yield_std"))
    return stats.withColumn("yield_zscore", settle(z, 3))


def derive_indices(seasons: DataFrame, *, key: str = "fips", order: str = "year") -> DataFrame:
    """Fill gaps along the years, then rain score, evapotranspiration, stress and heat share.

    ``seasons`` is a written table with one row per county and year; its count decides the plan.
    """
    bound = seasons.count()
    present = [c for c in config.IMPUTED_COLUMNS if c in seasons.columns]
    whole = windows.fill_gaps(
        seasons.withColumns({c: F.col(c).cast("double") for c in present}), [key], [F.col(order)], present, bound=bound)
    rain = "precip_total_mm"
    known = windows.with_aggregates(whole, [key], {
        "__mean": F.avg(rain), "__std": F.stddev_samp(rain), "__top_gdd": F.max("gdd_base10")},
        bound=bound)
    et0 = agronomy.et0_estimate(F.col("tmax_mean_c"), F.col("tmin_mean_c"), F.col("tavg_mean_c"))
    return known.withColumn("et0_estimate_mm", et0).withColumns({
        "precip_z": (F.col(rain) - F.col("__mean")) / (F.col("__std") + config.Z_EPSILON),
        "cwsi": agronomy.water_stress(F.col("et0_estimate_mm"), F.col(rain)),
        "heat_fraction": agronomy.heat_share(F.col("heat_stress_days"), F.col("__top_gdd")),
    }).drop("__mean", "__std", "__top_gdd")


def located_counties(yields: DataFrame) -> DataFrame:
    """One position per county, the lowest where rows disagree."""
    located = yields.na.drop(subset=["lat", "lon"]).select("fips", "lat", "lon", "county_name", "state_abbr")
    return windows.first_per_key(located, ["fips"], [F.col(c) for c in ("lat", "lon", "county_name", "state_abbr")])


@in_scratch_space
def weather_table(spark: SparkSession, yields: DataFrame, folder: str, years: list[int], cache: str, out: str, *,
                  stations_file: str = "ghcnd-stations.txt", catalog: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Entry 1: year files to county seasons (only years the cache lacks), imputed and with indices."""
    counties = cut(located_counties(yields))
    stations = files.read_stations(spark, f"{folder}/{stations_file}")
    mapping = cut(neighbours.nearest(stations, counties).select("station_id", "fips"))

    def compute(missing: list[int]) -> DataFrame:
        return season.mapped_seasons(files.land_daily(spark, folder, missing, scratch_path(spark, "daily")), mapping)

    seasons = cut(tables.extend_by_year(spark, cache, years, compute, fmt=fmt))
    if seasons.limit(1).count() == 0:
        raise RuntimeError(f"no daily observations found in {folder} for {years}")
    tables.write_table(derive_indices(seasons), out, partition_by=["year"], fmt=fmt)
    publish(spark, catalog, "weather", out, fmt)
    return tables.read_table(spark, out, fmt)


def weather_from_station_table(spark: SparkSession, counties: DataFrame, years: list[int], *,
                               candidates: list[str] = config.GSOD_TABLES) -> DataFrame:
    """County seasons from the first wide daily station table that exists, station-days pooled per county."""
    daily = season.pooled_units(tables.scan_first(spark, candidates), years=years)
    stations = windows.first_per_key(daily.select("stn", "lat", "lon"), ["stn"], [F.col("lat"), F.col("lon")])
    mapping = cut(neighbours.nearest(cut(stations), counties).select("stn", "fips"))
    seasons = season.season_pooled(joins.map_rows(daily, mapping, ["stn"]))
    return joins.lookup_join(seasons, counties.select("fips", "lat", "lon"), ["fips"], "left")


def answers_to_ask(counties: DataFrame, years: list[int], done: DataFrame | None = None) -> DataFrame:
    """Every located county and year that has no seasons yet: the keys whose answers are to be saved next."""
    work = joins.work_list(counties, years)
    return work if done is None else tables.resume_keys(work, done)


def extend_with_answers(done: DataFrame, answers: DataFrame, payload: str, *, maps: bool = False) -> DataFrame:
    """Earlier county seasons and those of new answers; a county and year that is done is left as it is."""
    fresh = tables.resume_keys(answers, done)
    return tables.merge_done(done, weather_from_answers(fresh, payload, maps=maps))


def weather_from_answers(answers: DataFrame, payload: str, *, maps: bool = False) -> DataFrame:
    """County seasons from saved JSON answers, one per (fips, year)."""
    if maps:
        return season.season_from_maps(payloads.daily_from_maps(answers, payload, ["fips", "year"]))
    return season.season_from_arrays(payloads.daily_from_arrays(answers, payload, ["fips", "year"]))


@in_scratch_space
def merged_table(spark: SparkSession, yields: DataFrame, weather: DataFrame, out: str, *, catalog: str | None = None,
                 fmt: str = "parquet") -> DataFrame:
    tables.write_table(joins.merge_weather(yields, weather), out, partition_by=["commodity_name"], fmt=fmt)
    publish(spark, catalog, "merged", out, fmt)
    return tables.read_table(spark, out, fmt)


@in_scratch_space
def correlation_tables(spark: SparkSession, merged: DataFrame, folder: str, *, crops: list[str] = config.CROPS,
                       train_years: list[int] = config.TRAIN_YEARS, params: dict | None = None,
                       with_models: bool = True, folds: int = 5, catalog: str | None = None,
                       fmt: str = "parquet") -> dict[str, DataFrame]:
    """Entry 2: correlations, models and importances; with models also their errors and fold scores per crop."""
    features = active_features(merged, config.WEATHER_FEATURES)
    corr = correlation.correlations(merged, features, groups=crops)
    tables.write_table(corr, f"{folder}/correlations", fmt=fmt)
    corr = tables.read_table(spark, f"{folder}/correlations", fmt)
    if with_models:
        models = boosting.fit_crops(merged, features, crops=crops, train_years=train_years, params=params)
        boosting.save(models, f"{folder}/models")
        train = merged.where(F.col("year").isin(train_years) & F.col("yield_bu_ac").isNotNull())
        order = [F.col(c) for c in ("year", "fips", "irr_name")]
        quality = {
            "metrics": boosting.split_metrics(boosting.predict(merged, models), train_years),
            "folds": boosting.cv_summary(boosting.cross_validate(
                train.where(F.col("commodity_name").isin(list(models))), features, order, k=folds, keys=["commodity_name"],
                params=params), ["commodity_name"])}
        for name, table in quality.items():
            tables.write_table(table, f"{folder}/{name}", fmt=fmt)
        shap = attribution.global_attribution(train, models)
        importance = boosting.importances(spark, models).join(shap, ["crop", "feature"])
    else:
        importance = correlation.importance_from_correlations(corr)
    ranked = reports.ranked_view(importance, ["crop", "feature", "xgb_importance", "shap_mean_abs"], "shap_mean_abs")
    tables.write_table(ranked, f"{folder}/importance", fmt=fmt)
    names = ["correlations", "importance", *(["metrics", "folds"] if with_models else [])]
    for name in names:
        publish(spark, catalog, name, f"{folder}/{name}", fmt)
    return {name: tables.read_table(spark, f"{folder}/{name}", fmt) for name in names}


@in_scratch_space
def anomaly_table(spark: SparkSession, merged: DataFrame, folder: str, *, crops: list[str] = config.CROPS,
                  trees: int = config.ISOLATION_TREES, key: tuple[str, ...] = (*BAND, "year"),
                  drop_incomplete: bool = False, catalog: str | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Entry 3: three layers over the merged table; ``scored`` has every row, ``anomalies`` the flagged ones."""
    models = boosting.load(spark, f"{folder}/models", crops)
    rows = cut(layers.baseline_layer(layers.residual_layer(merged, models)))
    isolated = layers.isolation_by_crop(rows, models, list(key), crops=crops, trees=trees, drop_incomplete=drop_incomplete)
    tables.write_table(layers.combine(isolated), f"{folder}/scored", partition_by=["commodity_name"], fmt=fmt)
    scored = tables.read_table(spark, f"{folder}/scored", fmt)
    explained = layers.explain_flagged(scored.where("is_anomaly"), models)
    tables.write_table(labels.keep_present(explained), f"{folder}/anomalies", partition_by=["commodity_name"], fmt=fmt)
    for name in ("scored", "anomalies"):
        publish(spark, catalog, name, f"{folder}/{name}", fmt)
    return {"scored": scored, "anomalies": tables.read_table(spark, f"{folder}/anomalies", fmt)}

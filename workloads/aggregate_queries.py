"""Aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens.functions.columns import settle
from harvestlens.operators import correlation, joins, reports, season, windows
from harvestlens.session import cut, scratch_path
from harvestlens.sources import tables
from harvestlens.streaming import landing
from workloads import bases as b
from workloads.bases import R
from workloads.join_queries import DAYS
from workloads.registry import query
from workloads.scalar_queries import pearson_sql


def rounded(df, columns, digits=6):
    return df.withColumns({c: settle(F.col(c), digits) for c in columns})


@query("a1_profile", b.with_(b.YIELDS) + """
SELECT count(*) AS n_rows, min(year) AS min_year, max(year) AS max_year, count(DISTINCT fips) AS n_fips,
       count(DISTINCT commodity_name) AS n_commodity_name, count(*) FILTER (WHERE fips IS NULL) AS null_fips,
       count(*) FILTER (WHERE gappy_yield IS NULL) AS null_gappy_yield, count(*) FILTER (WHERE year IS NULL) AS null_year,
       count(*) FILTER (WHERE commodity_name IS NULL) AS null_commodity_name FROM yields""")
def a1(spark, d):
    return reports.profile(b.yields(spark, d).select("fips", "commodity_name", "year", "gappy_yield"),
                           distinct=["fips", "commodity_name"])


def describe_sql(keys: list[str], columns: list[str], digits: int, source: str) -> str:
    by = ", ".join(keys + [""]) if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return " UNION ALL ".join(f"""
SELECT {by}'{c}' AS "column", count({c}) AS count, {R(f"avg({c})", digits)} AS mean, {R(f"stddev_samp({c})", digits)} AS std,
       {R(f"min({c})", digits)} AS min, {R(f"quantile_cont({c}, 0.25)", digits)} AS p25, {R(f"quantile_cont({c}, 0.5)", digits)} AS p50,
       {R(f"quantile_cont({c}, 0.75)", digits)} AS p75, {R(f"max({c})", digits)} AS max FROM {source} {group}""" for c in columns)


@query("a2_describe_groups", b.with_(b.YIELDS) + describe_sql(["commodity_name", "irr_name"], ["gappy_yield"], 1, "yields"))
def a2(spark, d):
    return reports.describe(b.yields(spark, d), ["commodity_name", "irr_name"], ["gappy_yield"], 1)


@query("a2_describe_all", "WITH l AS (SELECT * FROM lineitem)" + describe_sql(
    [], ["l_quantity", "l_extendedprice", "l_discount"], 2, "l"))
def a2b(spark, d):
    return reports.describe(b.table(spark, d, "lineitem"), [], ["l_quantity", "l_extendedprice", "l_discount"], 2)


@query("a3_group_stats", b.with_(b.YIELDS) + f"""
SELECT fips, commodity_name, irr_name, {R("avg(gappy_yield)", 6)} AS mean, {R("stddev_samp(gappy_yield)", 6)} AS std,
       min(gappy_yield) AS min, max(gappy_yield) AS max, count(gappy_yield) AS count
FROM yields GROUP BY fips, commodity_name, irr_name""")
def a3(spark, d):
    return rounded(windows.group_stats(b.yields(spark, d), ["fips", "commodity_name", "irr_name"], "gappy_yield"), ["mean", "std"])


SEASONS = f"""
seasons AS (
  SELECT station_id, year, {R("avg(tmax) FILTER (WHERE tmax IS NOT NULL AND tmin IS NOT NULL)", 2)} AS tmax_mean_c,
         {R("avg(tmin) FILTER (WHERE tmax IS NOT NULL AND tmin IS NOT NULL)", 2)} AS tmin_mean_c,
         {R("avg((tmax + tmin) / 2)", 2)} AS tavg_mean_c, {R("coalesce(sum(rain), 0)", 1)} AS precip_total_mm,
         {R("sum(greatest((tmax + tmin) / 2 - 10, 0)) FILTER (WHERE tmax IS NOT NULL AND tmin IS NOT NULL)", 1)} AS gdd_base10,
         count(*) FILTER (WHERE tmin IS NOT NULL AND tmax > 20) AS heat_stress_days, CAST(sum(dry) AS BIGINT) AS drought_days,
         {R("sum(wind) / nullif(sum(wind_n), 0)", 2)} AS wind_mean_ms
  FROM days GROUP BY station_id, year HAVING count(*) FILTER (WHERE tmax IS NOT NULL AND tmin IS NOT NULL) >= 3)"""
MEASURES = ["tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "precip_total_mm", "gdd_base10", "heat_stress_days", "drought_days",
            "wind_mean_ms"]


def _seasons(spark, d):
    return season.station_seasons(b.observations(spark, d), min_days=3, heat_c=20.0)


@query("a4_station_season", b.with_(b.OBS, DAYS, SEASONS) + f"SELECT station_id, year, {', '.join(MEASURES)} FROM seasons")
def a4(spark, d):
    return _seasons(spark, d).select("station_id", "year", *MEASURES)


@query("a5_county_season", b.with_(b.OBS, DAYS, SEASONS, b.STATIONS) + "SELECT fips, year, " + ", ".join(
    f"{R(f'avg({c})', 4)} AS {c}" for c in MEASURES) + """
FROM seasons s JOIN station_map m ON s.station_id = m.station_id GROUP BY fips, year""")
def a5(spark, d):
    mapped = joins.map_rows(_seasons(spark, d), b.station_map(spark, d), ["station_id"])
    return rounded(season.county_seasons(mapped), MEASURES, 4).select("fips", "year", *MEASURES)


@query("s12_file_stream", b.with_(b.OBS, DAYS, SEASONS, b.STATIONS) + "SELECT fips, year, " + ", ".join(
    f"{R(f'avg({c})', 4)} AS {c}" for c in MEASURES) + """
FROM seasons s JOIN station_map m ON s.station_id = m.station_id GROUP BY fips, year""")
def s12b(spark, d):
    """The county seasons of the landed year file, through the file stream; the second run finds nothing new."""
    folder, cache, log = (scratch_path(spark, n) for n in ("landing", "cache", "stream"))
    b.observations_raw(spark, d).write.option("compression", "gzip").csv(f"{folder}/2024.csv")
    mapping = b.station_map(spark, d)
    for _ in range(2):
        landing.follow_year_files(spark, folder, mapping, cache, log, months=b.OBS_MONTHS, min_days=3, heat_c=20.0, pattern="part-*")
    return rounded(tables.read_table(spark, cache), MEASURES, 4).select("fips", "year", *MEASURES)


@query("s12_file_stream_again", b.with_(b.OBS, DAYS, SEASONS, b.STATIONS) + "SELECT fips, year, " + ", ".join(
    f"{R(f'avg({c})', 4)} AS {c}" for c in MEASURES) + """
FROM seasons s JOIN station_map m ON s.station_id = m.station_id GROUP BY fips, year""")
def s12c(spark, d):
    """A year delivered in part, folded in, and then delivered again as a whole."""
    folder, cache, log = (scratch_path(spark, n) for n in ("landing", "cache", "stream"))
    raw = b.observations_raw(spark, d)
    mapping = b.station_map(spark, d)
    for name, rows in (("early", raw.where("substring(date, 7, 2) <= '12'")), ("late", raw)):
        rows.write.csv(f"{folder}/{name}/2024.csv")
        landing.follow_year_files(spark, folder, mapping, cache, log, months=b.OBS_MONTHS, min_days=3, heat_c=20.0, pattern="part-*")
    return rounded(tables.read_table(spark, cache), MEASURES, 4).select("fips", "year", *MEASURES)


@query("a6_season_arrays", b.with_(b.DAILY) + f"""
SELECT fips, year, {R("avg(tmax_c)", 4)} AS tmax_mean_c, {R("avg(tmin_c)", 4)} AS tmin_mean_c, {R("avg((tmax_c + tmin_c) / 2)", 4)} AS tavg_mean_c,
       coalesce(sum(prcp_mm), 0) AS precip_total_mm, sum(greatest((tmax_c + tmin_c) / 2 - 10, 0)) AS gdd_base10,
       count(*) FILTER (WHERE tmax_c > 35) AS heat_stress_days, count(*) FILTER (WHERE prcp_mm < 0.5) AS drought_days,
       CAST(0 AS DOUBLE) AS et0_total_mm, sum(wdsp_ms) AS solar_total_mj, {R("avg(wdsp_ms)", 4)} AS wind_max_mean_ms
FROM daily GROUP BY fips, year""")
def a6(spark, d):
    rows = b.daily(spark, d).select(
        "fips", "year", F.col("tmax_c").alias("temperature_2m_max"), F.col("tmin_c").alias("temperature_2m_min"),
        F.col("prcp_mm").alias("precipitation_sum"), F.col("wdsp_ms").alias("shortwave_radiation_sum"),
        F.col("wdsp_ms").alias("windgusts_10m_max"))
    return rounded(season.season_from_arrays(rows), ["tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "wind_max_mean_ms"], 4)


@query("a7_season_maps", b.with_(b.DAILY) + f"""
SELECT fips, year, {R("avg(tmax_c)", 4)} AS tmax_mean_c, {R("avg(tmin_c)", 4)} AS tmin_mean_c, {R("avg((tmax_c + tmin_c) / 2)", 4)} AS tavg_mean_c,
       coalesce(sum(greatest(prcp_mm - 2, 0)) FILTER (WHERE prcp_mm IS NOT NULL), 0) AS precip_total_mm,
       sum(greatest((tmax_c + tmin_c) / 2 - 10, 0)) AS gdd_base10, count(*) FILTER (WHERE tmax_c > 35) AS heat_stress_days,
       count(*) FILTER (WHERE greatest(prcp_mm - 2, 0) < 0.5 AND prcp_mm IS NOT NULL) AS drought_days, sum(wdsp_ms) AS solar_total_mj,
       CAST(0 AS DOUBLE) AS rh_mean_pct, {R("avg(wdsp_ms)", 4)} AS wind_mean_ms, CAST(NULL AS DOUBLE) AS et0_total_mm
FROM daily GROUP BY fips, year""")
def a7(spark, d):
    rows = b.daily(spark, d).select(
        "fips", "year", F.col("tmax_c").alias("T2M_MAX"), F.col("tmin_c").alias("T2M_MIN"),
        (F.col("prcp_mm") - 2).alias("PRECTOTCORR"), F.col("wdsp_ms").alias("ALLSKY_SFC_SW_DWN"), F.col("wdsp_ms").alias("WS2M"))
    return rounded(season.season_from_maps(rows), ["tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "wind_mean_ms"], 4)


@query("a8_season_pooled", b.with_(b.DAILY, b.WEATHER) + f"""
SELECT fips, year, {R("tmax_mean_c", 4)} AS tmax_mean_c, {R("tmin_mean_c", 4)} AS tmin_mean_c, {R("tavg_mean_c", 4)} AS tavg_mean_c,
       precip_total_mm, gdd_base10, heat_stress_days, drought_days, {R("wind_mean_ms", 4)} AS wind_mean_ms FROM season""")
def a8(spark, d):
    rows = rounded(season.season_pooled(b.daily(spark, d)), ["tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "wind_mean_ms"], 4)
    return rows.drop("et0_total_mm", "solar_total_mj")


@query("a9_coverage", b.with_(b.YIELDS) + f"""
SELECT count(gappy_yield) AS matched, count(*) AS n_rows, {R("100.0 * count(gappy_yield) / count(*)", 1)} AS match_pct FROM yields""")
def a9(spark, d):
    return reports.coverage(b.yields(spark, d), "gappy_yield")


@query("a10_pearson", b.WM.rstrip() + ", r AS (" + pearson_sql(b.ACTIVE) + f") SELECT crop, feature, n, {R('r', 6)} AS r FROM r WHERE n >= 20")
def a10(spark, d):
    corr = correlation.pearson(b.merged(spark, d), "commodity_name", "yield_bu_ac", b.ACTIVE)
    return rounded(corr.where("n >= 20"), ["r"])


def spearman_sql(features: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT commodity_name AS crop, '{f}' AS feature, yield_bu_ac AS x, CAST({f} AS DOUBLE) AS y FROM merged "
        f"WHERE yield_bu_ac IS NOT NULL AND {f} IS NOT NULL" for f in features)
    return f""", pairs AS ({long}),
ranks AS (SELECT crop, feature,
   rank() OVER (PARTITION BY crop, feature ORDER BY x) + (count(*) OVER (PARTITION BY crop, feature, x) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY crop, feature ORDER BY y) + (count(*) OVER (PARTITION BY crop, feature, y) - 1) / 2.0 AS ry FROM pairs)
SELECT crop, feature, count(*) AS n, {R("corr(rx, ry)", 6)} AS r FROM ranks GROUP BY crop, feature"""


@query("a11_spearman", b.WM.rstrip() + spearman_sql(b.ACTIVE))
def a11(spark, d):
    return rounded(correlation.spearman(cut(b.merged(spark, d)), "commodity_name", "yield_bu_ac", b.ACTIVE), ["r"])


def p_sql(r: str, n: str) -> str:
    """Two-sided Student-t p by Simpson's rule over 2,000 steps."""
    return f"""(SELECT 1 - 2 * exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(({n} - 2) * pi()) * t / 6000
   * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
         * (1 + (t * i / 2000.0) ** 2 / ({n} - 2)) ** (-({n} - 1) / 2.0))
   FROM (SELECT abs({r}) * sqrt(({n} - 2) / (1 - {r} ** 2)) AS t, unnest(range(2001)) AS i) GROUP BY t)"""


@query("a12_correlation_table", b.WM.rstrip() + ", linear AS (" + pearson_sql(b.ACTIVE) + ")"
       + spearman_sql(b.ACTIVE).replace("SELECT crop, feature, count(*) AS n,", ", s AS (SELECT crop, feature,").replace(R("corr(rx, ry)", 6), "corr(rx, ry)")
       + f""")
SELECT crop, feature, {R("linear.r", 3)} AS pearson_r, {R(p_sql("linear.r", "n"), 4)} AS pearson_p, {R("s.r", 3)} AS spearman_r,
       {R(p_sql("s.r", "n"), 4)} AS spearman_p, {R("abs(linear.r)", 6)} AS abs_pearson
FROM linear JOIN s USING (crop, feature) WHERE n >= 20""")
def a12(spark, d):
    table = correlation.correlations(cut(b.merged(spark, d)), b.ACTIVE, groups=b.CROPS)
    return rounded(table, ["abs_pearson"])


@query("a13_event_year_means", b.WS + f"""
SELECT commodity_name, {R("avg(yield_z_robust)", 2)} AS mean_z FROM scored WHERE year = 1998 GROUP BY commodity_name""")
def a13(spark, d):
    return reports.mean_by(b.scored(spark, d).where("year = 1998"), ["commodity_name"], "yield_z_robust", 2, "mean_z")


TYPES = ["UNEXPLAINED", "WEATHER_DRIVEN", "RESIDUAL_ONLY", "ISOLATION_ONLY"]


def pivot_sql(row: str, column: str, values: list[str], where: str) -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE {column} = '{v}') AS \"{v}\"" for v in values)
    return f"SELECT {row}, {cells} FROM scored WHERE {where} GROUP BY {row}"


@query("a14_year_direction_counts", b.WS + pivot_sql("year", "z_direction", ["LOW", "HIGH"], "z_anomaly"))
def a14(spark, d):
    return reports.count_pivot(b.scored(spark, d).where("z_anomaly"), "year", "z_direction", ["LOW", "HIGH"])


@query("a14_crop_type_counts", b.WS + pivot_sql("commodity_name", "anomaly_type", TYPES, "is_anomaly"))
def a14b(spark, d):
    return reports.count_pivot(b.scored(spark, d).where("is_anomaly"), "commodity_name", "anomaly_type", TYPES)


@query("a14_year_type_counts", b.WS + pivot_sql("year", "anomaly_type", TYPES, "is_anomaly"))
def a14c(spark, d):
    return reports.count_pivot(b.scored(spark, d).where("is_anomaly"), "year", "anomaly_type", TYPES)


@query("a15_counts_by_year", b.WS + """
SELECT year, count(*) FILTER (WHERE anomaly_type = 'UNEXPLAINED') AS n_unexplained, count(*) FILTER (WHERE is_anomaly) AS n_flagged
FROM scored GROUP BY year HAVING count(*) FILTER (WHERE anomaly_type = 'UNEXPLAINED') > 0""")
def a15(spark, d):
    rows = b.scored(spark, d)
    some = reports.count_by(rows, ["year"], "n_unexplained", F.col("anomaly_type") == "UNEXPLAINED")
    return some.join(reports.flag_sum(rows, ["year"], "is_anomaly", "n_flagged"), "year")


@query("a16_mean_residual_by_year", b.WS + f"SELECT year, {R('avg(xgb_residual + year / 7.0)', 1)} AS mean_residual FROM scored GROUP BY year")
def a16(spark, d):
    rows = b.scored(spark, d).withColumn("gap", F.col("xgb_residual") + F.col("year") / 7.0)
    return reports.mean_by(rows, ["year"], "gap", 1, "mean_residual")


@query("a17_layer_overlap", b.WS + f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_anomaly) AS flagged, count(*) FILTER (WHERE z_anomaly) AS z_flagged,
       count(*) FILTER (WHERE z_anomaly AND NOT residual_anomaly) AS weather_explained,
       count(*) FILTER (WHERE z_anomaly AND residual_anomaly) AS unexplained,
       {R("100.0 * count(*) FILTER (WHERE is_anomaly) / count(*)", 1)} AS flagged_pct FROM scored""")
def a17(spark, d):
    return reports.layer_overlap(b.scored(spark, d))


@query("a18_type_shares", b.WS + f"""
SELECT anomaly_type, count(*) AS n, {R("100.0 * count(*) / sum(count(*)) OVER ()", 1)} AS pct FROM scored WHERE is_anomaly GROUP BY anomaly_type""")
def a18(spark, d):
    return reports.value_shares(b.scored(spark, d).where("is_anomaly"), "anomaly_type")


@query("a18_type_shares_by_crop", b.WS + f"""
SELECT commodity_name, anomaly_type, count(*) AS n, {R("100.0 * count(*) / sum(count(*)) OVER (PARTITION BY commodity_name)", 1)} AS pct
FROM scored WHERE is_anomaly GROUP BY commodity_name, anomaly_type""")
def a18b(spark, d):
    return reports.value_shares(b.scored(spark, d).where("is_anomaly"), "anomaly_type", ["commodity_name"])


@query("a19_event_review", b.WS + f"""
SELECT commodity_name, count(DISTINCT fips) AS counties, {R("median(yield_bu_ac)", 6)} AS median_yield_bu_ac,
       {R("median(xgb_predicted_yield)", 6)} AS median_xgb_predicted_yield, {R("median(xgb_residual)", 6)} AS median_xgb_residual,
       CASE WHEN abs(median(xgb_residual)) < 10 THEN 'anticipated' ELSE 'missed' END AS verdict
FROM scored WHERE year = 1998 GROUP BY commodity_name""")
def a19(spark, d):
    review = reports.event_review(b.scored(spark, d), 1998)
    return rounded(review, ["median_yield_bu_ac", "median_xgb_predicted_yield", "median_xgb_residual"])


@query("a19_event_flags", b.WS + """
SELECT commodity_name, count(*) AS n_rows, count(*) FILTER (WHERE is_anomaly) AS flagged,
       count(*) FILTER (WHERE anomaly_type = 'UNEXPLAINED') AS unexplained
FROM scored WHERE year = 1998 GROUP BY commodity_name""")
def a19_flags(spark, d):
    return reports.event_flags(b.scored(spark, d), 1998)


YEARS = list(range(1995, 2002))


def mean_pivot_sql(measure: str, fill: str | None) -> str:
    def cell(y):
        value = R(f"avg({measure}) FILTER (WHERE year = {y})", 6)
        return f"coalesce({value}, {fill}) AS \"{y}\"" if fill else f"{value} AS \"{y}\""
    return (b.with_(b.YIELDS, b.COUNTIES, b.DAILY, b.WEATHER, b.MERGED) + "SELECT state_abbr, " + ", ".join(cell(y) for y in YEARS)
            + " FROM merged m JOIN counties c ON m.fips = c.fips WHERE commodity_name = 'BUILDING'"
            " AND state_abbr IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY state_abbr")


def _focus(spark, d):
    rows = joins.lookup_join(b.merged(spark, d), b.counties(spark, d), ["fips"], "inner")
    return rows.where((F.col("commodity_name") == "BUILDING") & F.col("state_abbr").isin("ASIA", "EUROPE", "AFRICA"))


@query("a20_heat_by_state_year", mean_pivot_sql("heat_stress_days", "0"))
def a20(spark, d):
    wide = reports.mean_pivot(_focus(spark, d), "state_abbr", "year", YEARS, "heat_stress_days", missing=0.0)
    return rounded(wide, [str(y) for y in YEARS])


@query("a20_rain_by_state_year", mean_pivot_sql("precip_z", None))
def a20b(spark, d):
    wide = reports.mean_pivot(_focus(spark, d), "state_abbr", "year", YEARS, "precip_z")
    return rounded(wide, [str(y) for y in YEARS])


@query("a21_yearly_band", b.with_(b.YIELDS) + f"""
SELECT commodity_name, year, {R("avg(yield_bu_ac)", 6)} AS mean, {R("stddev_samp(yield_bu_ac)", 6)} AS std,
       {R("avg(yield_bu_ac) - stddev_samp(yield_bu_ac)", 6)} AS low, {R("avg(yield_bu_ac) + stddev_samp(yield_bu_ac)", 6)} AS high
FROM yields GROUP BY commodity_name, year""")
def a21(spark, d):
    return rounded(reports.mean_and_std(b.yields(spark, d), ["commodity_name", "year"], "yield_bu_ac"), ["mean", "std", "low", "high"])


@query("a22_trend_line", b.WM + f"""
SELECT commodity_name, count(*) AS n, {R("regr_slope(gappy_yield, gdd_base10)", 8)} AS slope,
       {R("regr_intercept(gappy_yield, gdd_base10)", 6)} AS intercept, {R("regr_r2(gappy_yield, gdd_base10)", 8)} AS r2
FROM merged WHERE gappy_yield IS NOT NULL AND gdd_base10 IS NOT NULL GROUP BY commodity_name""")
def a22(spark, d):
    line = correlation.trend_line(b.merged(spark, d), "commodity_name", "gdd_base10", "gappy_yield")
    return rounded(rounded(line, ["slope", "r2"], 8), ["intercept"])


@query("a23_box_by_year", b.with_(b.YIELDS) + f"""
SELECT year, count(gappy_yield) AS n, min(gappy_yield) AS low, {R("quantile_cont(gappy_yield, 0.25)", 6)} AS q1,
       {R("median(gappy_yield)", 6)} AS median, {R("quantile_cont(gappy_yield, 0.75)", 6)} AS q3, max(gappy_yield) AS high
FROM yields GROUP BY year""")
def a23(spark, d):
    return rounded(reports.five_numbers(b.yields(spark, d), ["year"], "gappy_yield"), ["q1", "median", "q3"])


@query("a24_yield_trend", b.WM + f"""
SELECT year, commodity_name, {R("avg(yield_bu_ac)", 1)} AS avg_yield_bu_ac, {R("avg(gdd_base10)", 0)} AS avg_gdd,
       {R("avg(heat_stress_days)", 1)} AS avg_heat_days FROM merged GROUP BY year, commodity_name""")
def a24(spark, d):
    return reports.yield_trend(b.merged(spark, d))


@query("a25_regression_metrics", b.WS + f"""
SELECT commodity_name, count(*) AS n, {R("sqrt(avg((yield_bu_ac - xgb_predicted_yield) ** 2))", 6)} AS rmse,
       {R("1 - avg((yield_bu_ac - xgb_predicted_yield) ** 2) / var_pop(yield_bu_ac)", 6)} AS r2 FROM scored GROUP BY commodity_name""")
def a25(spark, d):
    return rounded(reports.regression_metrics(b.scored(spark, d), "yield_bu_ac", "xgb_predicted_yield", ["commodity_name"]), ["rmse", "r2"])

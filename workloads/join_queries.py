"""Joins (J1-J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens.functions.columns import settle
from harvestlens.operators import joins, neighbours, season, windows
from harvestlens.session import cut
from workloads import bases as b
from workloads.bases import R
from workloads.registry import query


def _positions(spark, d):
    """County positions for even nations only in the first two regions, so that some keys do not match."""
    nation = b.table(spark, d, "nation")
    return nation.where("n_regionkey < 3").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("fips"), F.col("n_nationkey").cast("double").alias("lat"),
        (-F.col("n_nationkey").cast("double") - 80).alias("lon"))


POSITIONS = """
positions AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips, CAST(n_nationkey AS DOUBLE) AS lat,
              -CAST(n_nationkey AS DOUBLE) - 80 AS lon FROM nation WHERE n_regionkey < 3)"""


@query("j1_centroid_join", b.with_(b.YIELDS, POSITIONS) + """
SELECT obs_id, y.fips, lat, lon FROM yields y LEFT JOIN positions p ON y.fips = p.fips""")
def j1(spark, d):
    return joins.with_centroids(b.yields(spark, d), _positions(spark, d)).select("obs_id", "fips", "lat", "lon")


@query("j2_group_stats_on_rows", b.with_(b.YIELDS) + f"""
SELECT obs_id, {R("avg(gappy_yield) OVER g", 6)} AS yield_mean, {R("stddev_samp(gappy_yield) OVER g", 6)} AS yield_std,
       min(gappy_yield) OVER g AS low, max(gappy_yield) OVER g AS high, count(gappy_yield) OVER g AS n_years
FROM yields WINDOW g AS (PARTITION BY fips, commodity_name, irr_name)""")
def j2(spark, d):
    rows = windows.with_group_stats(b.yields(spark, d), ["fips", "commodity_name", "irr_name"], "gappy_yield", {
        "mean": "yield_mean", "std": "yield_std", "min": "low", "max": "high", "count": "n_years"})
    return rows.select("obs_id", settle(F.col("yield_mean"), 6).alias("yield_mean"),
                       settle(F.col("yield_std"), 6).alias("yield_std"), "low", "high", "n_years")


@query("j3_yield_weather_merge", b.WM + f"""
SELECT obs_id, fips, year, yield_bu_ac, precip_total_mm, gdd_base10, heat_stress_days, {R("precip_z", 6)} AS precip_z, cwsi FROM merged""")
def j3(spark, d):
    return b.merged(spark, d).select(
        "obs_id", "fips", "year", "yield_bu_ac", "precip_total_mm", "gdd_base10",
        F.col("heat_stress_days").cast("long").alias("heat_stress_days"), settle(F.col("precip_z"), 6).alias("precip_z"), "cwsi")


def _points(spark, d):
    return b.table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lon"))


def _sites(spark, d):
    """One site per label: the mean of its vectors."""
    means = _points(spark, d).groupBy("label").agg(
        F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    return means.select(F.col("label").cast("string").alias("fips"), "lat", "lon")


NEAREST = """
points AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings),
sites AS (SELECT CAST(label AS VARCHAR) AS fips, round(avg(lat), 6) AS slat, round(avg(lon), 6) AS slon FROM points GROUP BY label),
near AS (SELECT vec_id, arg_min(fips, [CAST((slat - lat) ** 2 + (slon - lon) ** 2 AS DOUBLE), CAST(fips AS DOUBLE)]) AS fips
         FROM points, sites GROUP BY vec_id)"""


@query("j4_nearest_county", b.with_(NEAREST) + "SELECT vec_id, fips FROM near")
def j4(spark, d):
    return neighbours.nearest(_points(spark, d), _sites(spark, d)).select("vec_id", "fips")


@query("j4_nearest_with_nan", b.with_(NEAREST) + """
SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN fips END AS fips FROM near""")
def j4_nan(spark, d):
    """Points without a position, given as NaN."""
    lost = F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("lat"))
    return neighbours.nearest(_points(spark, d).withColumn("lat", lost), _sites(spark, d)).select("vec_id", "fips")


@query("j4_nearest_customer_account", f"""
WITH points AS (SELECT o_orderkey, o_totalprice / 50 AS x FROM orders),
sites AS (SELECT s_acctbal AS x, min(lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS k FROM supplier GROUP BY s_acctbal),
up AS (SELECT o_orderkey, points.x AS x, sites.x AS sx, sites.k AS k FROM points ASOF LEFT JOIN sites ON points.x >= sites.x),
dn AS (SELECT o_orderkey, sites.x AS sx, sites.k AS k FROM points ASOF LEFT JOIN sites ON points.x <= sites.x)
SELECT up.o_orderkey AS o_orderkey, CASE
  WHEN up.k IS NULL THEN dn.k WHEN dn.k IS NULL THEN up.k
  WHEN (up.x - up.sx) ** 2 < (dn.sx - up.x) ** 2 THEN up.k
  WHEN (up.x - up.sx) ** 2 > (dn.sx - up.x) ** 2 THEN dn.k ELSE least(up.k, dn.k) END AS fips
FROM up JOIN dn USING (o_orderkey)""")
def j4b(spark, d):
    """Points and sites that both grow with the data, on a line."""
    points = b.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 50).alias("lat"), F.lit(0.0).alias("lon"))
    sites = b.table(spark, d, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("fips"), F.col("s_acctbal").alias("lat"), F.lit(0.0).alias("lon"))
    return neighbours.nearest(points, sites).select("o_orderkey", "fips")


@query("j5_station_lookup", b.with_(b.OBS, b.STATIONS) + """
SELECT o.station_id, fips, date, element, data_value FROM obs o JOIN station_map m ON o.station_id = m.station_id""")
def j5(spark, d):
    return joins.map_rows(b.observations(spark, d), b.station_map(spark, d), ["station_id"]).select(
        "station_id", "fips", "date", "element", "data_value")


@query("j6_mapped_stations_only", b.with_(b.OBS, b.STATIONS) + """
SELECT station_id, date, element, data_value FROM obs SEMI JOIN (SELECT * FROM station_map WHERE fips < '00010') USING (station_id)""")
def j6(spark, d):
    mapping = b.station_map(spark, d).where("fips < '00010'")
    return joins.lookup_join(b.observations(spark, d), mapping, ["station_id"], "left_semi").select(
        "station_id", "date", "element", "data_value")


DAYS = """
days AS (
  SELECT station_id, year, date, avg(data_value) FILTER (WHERE element = 'TMAX') AS tmax,
         avg(data_value) FILTER (WHERE element = 'TMIN') AS tmin, sum(data_value) FILTER (WHERE element = 'PRCP') AS rain,
         count(*) FILTER (WHERE element = 'PRCP' AND data_value < 0.5) AS dry,
         sum(data_value) FILTER (WHERE element = 'AWND') AS wind, count(*) FILTER (WHERE element = 'AWND') AS wind_n
  FROM obs GROUP BY station_id, year, date)"""


@query("j7_common_days", b.with_(b.OBS, DAYS) + f"""
SELECT station_id, date, {R("tmax", 4)} AS tmax, {R("tmin", 4)} AS tmin FROM days WHERE tmax IS NOT NULL AND tmin IS NOT NULL""")
def j7(spark, d):
    days = season.station_days(b.observations(spark, d)).where("tmax is not null and tmin is not null")
    return days.select("station_id", "date", settle(F.col("tmax"), 4).alias("tmax"), settle(F.col("tmin"), 4).alias("tmin"))


@query("j8_explanations_on_rows", b.WS + """
SELECT obs_id, anomaly_type, CASE WHEN is_anomaly THEN anomaly_type || ' in ' || CAST(year AS VARCHAR) END AS note FROM scored""")
def j8(spark, d):
    rows = b.scored(spark, d)
    notes = rows.where("is_anomaly").select("obs_id", F.concat("anomaly_type", F.lit(" in "), F.col("year").cast("string")).alias("note"))
    return joins.lookup_join(rows, cut(notes), ["obs_id"], "left").select("obs_id", "anomaly_type", "note")


@query("j9_not_done", b.with_(b.YIELDS) + """
, done AS (SELECT DISTINCT fips, year FROM yields WHERE yield_bu_ac > 490)
SELECT obs_id, fips, year FROM yields ANTI JOIN done USING (fips, year)""")
def j9(spark, d):
    rows = b.yields(spark, d)
    return joins.not_done(rows, rows.where("yield_bu_ac > 490"), ["fips", "year"]).select("obs_id", "fips", "year")


@query("j10_centroid_on_seasons", b.with_(b.DAILY, b.WEATHER, POSITIONS) + """
SELECT w.fips, year, precip_total_mm, lat, lon FROM weather w LEFT JOIN positions p ON w.fips = p.fips""")
def j10(spark, d):
    first = windows.first_per_key(_positions(spark, d), ["fips"], [F.col("lat"), F.col("lon")])
    return joins.lookup_join(b.weather(spark, d), first, ["fips"], "left").select("fips", "year", "precip_total_mm", "lat", "lon")


@query("j11_work_list", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS fips, s_acctbal AS lat, -s_acctbal AS lon, year
FROM supplier, (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS year) WHERE s_acctbal >= 0""")
def j11(spark, d):
    places = b.table(spark, d, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("fips"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("lat"), (-F.col("s_acctbal")).alias("lon"))
    return joins.work_list(places, list(range(1995, 2002)))


@query("j12_county_snapshot", b.with_(b.YIELDS, b.COUNTIES) + """
SELECT y.fips, obs_id, gappy_yield, county_name, state_abbr FROM yields y JOIN counties c ON y.fips = c.fips
WHERE year = 1998 AND commodity_name = 'BUILDING' AND gappy_yield IS NOT NULL""")
def j12(spark, d):
    rows = joins.lookup_join(b.yields(spark, d), b.counties(spark, d), ["fips"], "inner")
    return joins.county_snapshot(rows, 1998, "BUILDING", ["fips", "obs_id", "gappy_yield", "county_name", "state_abbr"],
                                 required="gappy_yield")

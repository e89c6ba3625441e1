"""The given tables in the roles of the analytics: yields, counties, daily observations, seasons.

Every base has a DataFrame form and the same thing as a SQL common table expression.

yields   one row per order: county = the customer's nation, crop = market segment, irrigation
         practice = order priority, year = order year, yield = price in thousands; a pending order
         ('P') has no measured yield in ``gappy_yield``.
daily    one wide row per line item: station = supplier, county = the supplier's nation.
obs      long daily observations: station = user, element by event type, value in tenths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import zero_pad
from harvestlens.operators import season, windows
from harvestlens.operators.joins import lookup_join, merge_weather
from harvestlens.session import cut

ELEMENTS = {"view": "TMAX", "click": "TMIN", "purchase": "PRCP", "error": "AWND", "signup": "SNOW"}
OBS_MONTHS = [1]
FEATURES = ["tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "precip_total_mm", "gdd_base10", "heat_stress_days",
            "drought_days", "et0_total_mm", "solar_total_mj", "precip_z", "cwsi"]
ACTIVE = [f for f in FEATURES if f not in ("et0_total_mm", "solar_total_mj")]
CROPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EVENTS = {1996: "Dry spring", 1998: "Late frost", 2000: "Wet harvest"}
TRAIN_YEARS = list(range(1995, 2000))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    # Both sides grow with the data: Spark decides from measured sizes whether to broadcast.
    rows = orders.join(customers, "o_custkey")
    return rows.select(
        F.col("o_orderkey").alias("obs_id"), zero_pad(F.col("c_nationkey"), 5).alias("fips"),
        F.col("c_mktsegment").alias("commodity_name"), F.col("o_orderpriority").alias("irr_name"),
        F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"),
        (F.col("o_totalprice") / 1000).alias("yield_bu_ac"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).alias("gappy_yield"))


YIELDS = """
yields AS (
  SELECT o.o_orderkey AS obs_id, lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS fips,
         c.c_mktsegment AS commodity_name, o.o_orderpriority AS irr_name,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(o.o_orderdate AS DATE) AS day,
         o.o_totalprice / 1000 AS yield_bu_ac, o.o_orderstatus AS status,
         CASE WHEN o.o_orderstatus <> 'P' THEN o.o_totalprice / 1000 END AS gappy_yield
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = lookup_join(nation, region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], "inner")
    return joined.select(
        zero_pad(F.col("n_nationkey"), 5).alias("fips"), F.col("n_name").alias("county_name"),
        F.col("r_name").alias("state_abbr"))


COUNTIES = """
counties AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips, n_name AS county_name, r_name AS state_abbr
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lines.join(suppliers, "l_suppkey").where(F.month("l_shipdate").isin(config.GROWING_MONTHS))
    return rows.select(
        F.col("l_suppkey").alias("stn"), zero_pad(F.col("s_nationkey"), 5).alias("fips"),
        F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("tmax_c"), (F.col("l_quantity") - F.round(F.col("l_discount") * 100)).alias("tmin_c"),
        F.when(F.col("l_linestatus") == "O", F.round(F.col("l_tax") * 100)).alias("prcp_mm"),
        F.round(F.col("l_extendedprice") / 1000).alias("wdsp_ms"))


DAILY = """
daily AS (
  SELECT l.l_suppkey AS stn, lpad(CAST(s.s_nationkey AS VARCHAR), 5, '0') AS fips,
         CAST(year(l.l_shipdate) AS INTEGER) AS year, CAST(l.l_shipdate AS DATE) AS date,
         l.l_quantity AS tmax_c, l.l_quantity - round(l.l_discount * 100) AS tmin_c,
         CASE WHEN l.l_linestatus = 'O' THEN round(l.l_tax * 100) END AS prcp_mm,
         round(l.l_extendedprice / 1000) AS wdsp_ms
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE month(l.l_shipdate) BETWEEN 4 AND 10)"""


def observations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw daily rows; a props value below ten stands for a quality flag."""
    labels = F.create_map(*[F.lit(x) for pair in ELEMENTS.items() for x in pair])
    key = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("US"), zero_pad(F.col("user_id"), 9)).alias("station_id"),
        F.date_format("ts", "yyyyMMdd").alias("date"), labels[F.col("event_type")].alias("element"),
        F.floor("value").cast("double").alias("data_value"), F.lit(None).cast("string").alias("m_flag"),
        F.when(key < 10, "S").when(key < 20, " ").alias("q_flag"), F.lit("0").alias("s_flag"),
        F.lit(None).cast("string").alias("obs_time"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.clean_observations(observations_raw(spark, sf_dir), months=OBS_MONTHS)


OBS = """
obs AS (
  SELECT * FROM (
    SELECT 'US' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS station_id, CAST(ts AS DATE) AS date,
           CASE event_type WHEN 'view' THEN 'TMAX' WHEN 'click' THEN 'TMIN' WHEN 'purchase' THEN 'PRCP'
                WHEN 'error' THEN 'AWND' ELSE 'SNOW' END AS element,
           floor(value) / 10 AS data_value, CAST(year(ts) AS INTEGER) AS year,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
    FROM events) AS raw
  WHERE element <> 'SNOW' AND k >= 10 AND month(date) = 1
    AND CASE WHEN element = 'PRCP' THEN data_value BETWEEN 0 AND 2000 ELSE data_value BETWEEN -60 AND 60 END)"""


def station_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station to county: the nation of the customer with the user's number."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("US"), zero_pad(F.col("c_custkey"), 9)).alias("station_id"),
        zero_pad(F.col("c_nationkey"), 5).alias("fips"))


STATIONS = """
station_map AS (
  SELECT 'US' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS station_id,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS fips FROM customer)"""


def derive(seasons: DataFrame) -> DataFrame:
    """Derived indices on top of the season features (Entry 1)."""
    from harvestlens.plans.stages import derive_indices

    return derive_indices(seasons)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County seasons with derived indices; one row per county and year, so it is written out before it is joined."""
    return cut(derive(cut(season.season_pooled(daily(spark, sf_dir)))))


def R(expr: str, digits: int) -> str:
    """Half-up rounding of a double on its decimal value."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, {digits + 6})), {digits}) AS DOUBLE)"


def T(expr: str, digits: int) -> str:
    """Text with a fixed number of decimals."""
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(38, {digits + 6})), {digits}) AS DECIMAL(28, {digits})) AS VARCHAR)"


WEATHER = f"""
season AS (
  SELECT fips, year, avg(tmax_c) AS tmax_mean_c, avg(tmin_c) AS tmin_mean_c, avg((tmax_c + tmin_c) / 2) AS tavg_mean_c,
         sum(coalesce(prcp_mm, 0)) AS precip_total_mm, sum(greatest((tmax_c + tmin_c) / 2 - 10, 0)) AS gdd_base10,
         count(*) FILTER (WHERE tmax_c > 35) AS heat_stress_days,
         count(*) FILTER (WHERE coalesce(prcp_mm, 0) < 0.5) AS drought_days, avg(wdsp_ms) AS wind_mean_ms
  FROM daily GROUP BY fips, year),
weather0 AS (
  SELECT *, (precip_total_mm - avg(precip_total_mm) OVER (PARTITION BY fips))
            / (stddev_samp(precip_total_mm) OVER (PARTITION BY fips) + 1e-6) AS precip_z,
         0.0023 * sqrt(greatest(tmax_mean_c - tmin_mean_c, 0)) * (tavg_mean_c + 17.8) * 30 * 214 AS et0_estimate_mm,
         max(gdd_base10) OVER (PARTITION BY fips) AS top_gdd
  FROM season),
weather AS (
  SELECT *, {R("et0_estimate_mm / greatest(precip_total_mm, 1)", 3)} AS cwsi,
         {R("heat_stress_days / greatest(top_gdd, 1)", 4)} AS heat_fraction,
         CAST(NULL AS DOUBLE) AS et0_total_mm, CAST(NULL AS DOUBLE) AS solar_total_mj
  FROM weather0)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_weather(yields(spark, sf_dir), weather(spark, sf_dir))


MERGED = """
merged AS (SELECT y.*, w.* EXCLUDE (fips, year) FROM yields y JOIN weather w ON y.fips = w.fips AND y.year = w.year)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


WM = with_(YIELDS, DAILY, WEATHER, MERGED)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged rows with the flags of the layers; the model is the yearly crop mean, and a high yield is isolated,
    rules that any engine can repeat."""
    from harvestlens.operators import layers

    rows = cut(merged(spark, sf_dir))  # read four times below
    base = windows.with_group_stats(rows, ["commodity_name", "year"], "yield_bu_ac", {"mean": "xgb_predicted_yield"})
    gaps = base.withColumn("xgb_residual", F.col("yield_bu_ac") - F.col("xgb_predicted_yield"))
    return layers.combine(layers.baseline_layer(layers.flag_residuals(gaps)).withColumns({
        "if_anomaly": F.col("yield_bu_ac") > 480, "if_anomaly_score": F.col("yield_bu_ac") / 500}))


SCORED = """
scored0 AS (
  SELECT *, avg(yield_bu_ac) OVER (PARTITION BY commodity_name, year) AS xgb_predicted_yield,
         yield_bu_ac - avg(yield_bu_ac) OVER (PARTITION BY commodity_name, year) AS xgb_residual FROM merged),
others AS (
  SELECT x.obs_id AS obs_id, median(y.yield_bu_ac) AS med, count(y.yield_bu_ac) AS n,
         quantile_cont(y.yield_bu_ac, 0.75) - quantile_cont(y.yield_bu_ac, 0.25) AS iqr
  FROM merged x JOIN merged y ON x.fips = y.fips AND x.commodity_name = y.commodity_name AND x.obs_id <> y.obs_id
  GROUP BY x.obs_id),
scored1 AS (
  SELECT s.*, (xgb_residual - avg(xgb_residual) OVER g) / (stddev_samp(xgb_residual) OVER g + 1e-6) AS xgb_residual_z,
         CASE WHEN n > 0 AND iqr = 0 THEN 0 WHEN n > 0 THEN (yield_bu_ac - med) / (iqr / 1.349) END AS yield_z_robust
  FROM scored0 s LEFT JOIN others o ON s.obs_id = o.obs_id WINDOW g AS (PARTITION BY fips, commodity_name)),
scored2 AS (
  SELECT *, coalesce(abs(yield_z_robust) > 1.5, FALSE) AS z_anomaly, xgb_residual_z < -1.5 AS residual_anomaly, yield_bu_ac > 480 AS if_anomaly,
         CASE WHEN yield_z_robust < -1.5 THEN 'LOW' WHEN yield_z_robust > 1.5 THEN 'HIGH' ELSE 'NORMAL' END AS z_direction,
         CASE WHEN xgb_residual_z < -1.5 THEN 'UNEXPLAINED_LOW' WHEN xgb_residual_z > 1.5 THEN 'UNEXPLAINED_HIGH'
              ELSE 'WEATHER_EXPLAINED' END AS residual_direction
  FROM scored1),
scored AS (
  SELECT *, z_anomaly OR residual_anomaly OR if_anomaly AS is_anomaly,
         CASE WHEN z_anomaly AND residual_anomaly THEN 'UNEXPLAINED' WHEN z_anomaly THEN 'WEATHER_DRIVEN'
              WHEN residual_anomaly THEN 'RESIDUAL_ONLY' WHEN if_anomaly THEN 'ISOLATION_ONLY' ELSE 'NORMAL' END AS anomaly_type
  FROM scored2)"""
WS = with_(YIELDS, DAILY, WEATHER, MERGED, SCORED)

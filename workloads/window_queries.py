"""Window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import settle
from harvestlens.operators import windows
from workloads import bases as b
from workloads.bases import R
from workloads.registry import query

BAND = ["fips", "commodity_name", "irr_name"]


@query("w1_yield_zscore", b.with_(b.YIELDS) + f"""
SELECT obs_id, {R("(gappy_yield - avg(gappy_yield) OVER g) / nullif(stddev_samp(gappy_yield) OVER g, 0)", 3)} AS yield_zscore
FROM yields WINDOW g AS (PARTITION BY fips, commodity_name, irr_name)""")
def w1(spark, d):
    return windows.group_zscore(b.yields(spark, d), BAND, "gappy_yield", "yield_zscore", digits=3).select("obs_id", "yield_zscore")


@query("w1_rain_zscore", b.with_(b.DAILY, b.WEATHER) + f"SELECT fips, year, {R('precip_z', 6)} AS precip_z FROM weather")
def w1b(spark, d):
    return b.weather(spark, d).select("fips", "year", settle(F.col("precip_z"), 6).alias("precip_z"))


@query("w1_residual_zscore", b.WS + f"SELECT obs_id, {R('xgb_residual_z', 6)} AS xgb_residual_z FROM scored")
def w1c(spark, d):
    return b.scored(spark, d).select("obs_id", settle(F.col("xgb_residual_z"), 6).alias("xgb_residual_z"))


@query("w2_group_max", b.with_(b.YIELDS) + "SELECT obs_id, max(gappy_yield) OVER (PARTITION BY fips, commodity_name) AS top_yield FROM yields")
def w2(spark, d):
    return windows.group_max(b.yields(spark, d), ["fips", "commodity_name"], "gappy_yield", "top_yield").select("obs_id", "top_yield")


@query("w3_fill_gaps", b.with_(b.YIELDS) + f"""
, p AS (SELECT *, row_number() OVER g AS pos FROM yields WINDOW g AS (PARTITION BY fips, commodity_name ORDER BY day, obs_id)),
q AS (SELECT *, last_value(CASE WHEN gappy_yield IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS p0,
             last_value(gappy_yield IGNORE NULLS) OVER back AS v0,
             first_value(CASE WHEN gappy_yield IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS p1,
             first_value(gappy_yield IGNORE NULLS) OVER ahead AS v1
      FROM p WINDOW back AS (PARTITION BY fips, commodity_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    ahead AS (PARTITION BY fips, commodity_name ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT obs_id, {R("CASE WHEN gappy_yield IS NOT NULL THEN gappy_yield WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 "
                  "ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END", 6)} AS filled FROM q""")
def w3(spark, d):
    rows = windows.fill_gaps(b.yields(spark, d), ["fips", "commodity_name"], [F.col("day"), F.col("obs_id")], ["gappy_yield"])
    return rows.select("obs_id", settle(F.col("gappy_yield"), 6).alias("filled"))


LEAVE_ONE_OUT = f"""
, others AS (
  SELECT x.obs_id AS obs_id, any_value(x.gappy_yield) AS v, median(y.gappy_yield) AS med,
         quantile_cont(y.gappy_yield, 0.75) - quantile_cont(y.gappy_yield, 0.25) AS iqr, count(y.gappy_yield) AS n
  FROM yields x LEFT JOIN yields y ON x.fips = y.fips AND x.commodity_name = y.commodity_name AND x.obs_id <> y.obs_id
  GROUP BY x.obs_id)
SELECT obs_id, CASE WHEN v IS NULL OR n = 0 THEN NULL WHEN iqr = 0 THEN 0
                    ELSE {R("(v - med) / (iqr / 1.349)", 6)} END AS yield_z_robust FROM others"""


@query("w4_leave_one_out_z", b.with_(b.YIELDS) + LEAVE_ONE_OUT)
def w4(spark, d):
    rows = windows.leave_one_out_z(b.yields(spark, d), ["fips", "commodity_name"], "gappy_yield", "yield_z_robust")
    return rows.select("obs_id", settle(F.col("yield_z_robust"), 6).alias("yield_z_robust"))


@query("w5_tie_ranks", """
SELECT l_returnflag, l_quantity, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
  + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS quantity_rank FROM lineitem""")
def w5(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return windows.tie_ranks(rows, ["l_returnflag"], "l_quantity", "quantity_rank")


@query("w6_lowest_residuals", b.WS + f"""
SELECT commodity_name, obs_id, rk, {R("xgb_residual", 6)} AS xgb_residual FROM (
  SELECT *, row_number() OVER (PARTITION BY commodity_name ORDER BY xgb_residual, obs_id) AS rk FROM scored
  WHERE anomaly_type = 'UNEXPLAINED') WHERE rk <= 5""")
def w6(spark, d):
    rows = b.scored(spark, d).where("anomaly_type = 'UNEXPLAINED'")
    top = windows.top_n(rows, ["commodity_name"], [F.col("xgb_residual"), F.col("obs_id")], 5, rank="rk")
    return top.select("commodity_name", "obs_id", F.col("rk").cast("long").alias("rk"), settle(F.col("xgb_residual"), 6).alias("xgb_residual"))


@query("w7_first_per_key", b.with_(b.YIELDS) + """
SELECT fips, year, obs_id, yield_bu_ac FROM (
  SELECT *, row_number() OVER (PARTITION BY fips, year ORDER BY day, obs_id) AS rk FROM yields) WHERE rk = 1""")
def w7(spark, d):
    first = windows.first_per_key(b.yields(spark, d), ["fips", "year"], [F.col("day"), F.col("obs_id")])
    return first.select("fips", "year", "obs_id", "yield_bu_ac")


Z_LIMIT = config.Z_THRESHOLD


@query("flagship_anomaly_counts", b.WM.rstrip() + f"""
, base AS (SELECT *, (yield_bu_ac - avg(yield_bu_ac) OVER g) / nullif(stddev_samp(yield_bu_ac) OVER g, 0) AS z FROM merged
  WINDOW g AS (PARTITION BY fips, commodity_name, irr_name))
SELECT year, count(*) FILTER (WHERE {R("z", 3)} < -{Z_LIMIT}) AS "LOW",
       count(*) FILTER (WHERE z IS NULL OR {R("z", 3)} BETWEEN -{Z_LIMIT} AND {Z_LIMIT}) AS "NORMAL",
       count(*) FILTER (WHERE {R("z", 3)} > {Z_LIMIT}) AS "HIGH" FROM base GROUP BY year""")
def flagship(spark, d):
    """Seasons, merge, z-score, label, counts: the whole path in one query."""
    from harvestlens.functions import labels
    from harvestlens.operators import reports

    scored = windows.group_zscore(b.merged(spark, d), BAND, "yield_bu_ac", "z", digits=3)
    labelled = scored.withColumn("direction", labels.direction(F.col("z")))
    return reports.count_pivot(labelled, "year", "direction", ["LOW", "NORMAL", "HIGH"])

"""Ordering, limits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens.functions.columns import settle
from harvestlens.operators import correlation, joins, reports
from workloads import bases as b
from workloads.bases import R
from workloads.registry import query
from workloads.scalar_queries import pearson_sql

RANKS = b.WM.rstrip() + ", r AS (" + pearson_sql(b.ACTIVE) + f"), t AS (SELECT crop, feature, {R('abs(r)', 6)} AS strength FROM r) "


def _strength(spark, d):
    corr = correlation.pearson(b.merged(spark, d), "commodity_name", "yield_bu_ac", b.ACTIVE)
    return corr.select("crop", "feature", settle(F.abs("r"), 6).alias("strength"))


@query("o1_mixed_sort", RANKS + "SELECT crop, feature, strength FROM t ORDER BY crop, strength DESC, feature")
def o1(spark, d):
    return _strength(spark, d).orderBy("crop", F.col("strength").desc(), "feature")


@query("o2_ranked_view", RANKS + "SELECT crop, feature, strength FROM t ORDER BY crop, strength DESC")
def o2(spark, d):
    return reports.ranked_view(_strength(spark, d), ["crop", "feature", "strength"], "strength")


@query("o3_anomaly_feed", b.WS.rstrip() + "," + b.COUNTIES + f"""
SELECT year, obs_id, s.fips, county_name, state_abbr, commodity_name, yield_bu_ac, {R("xgb_residual", 6)} AS xgb_residual, anomaly_type
FROM scored s JOIN counties c ON s.fips = c.fips WHERE is_anomaly
ORDER BY year DESC, abs({R("xgb_residual", 6)}) DESC, obs_id LIMIT 500""")
def o3(spark, d):
    rows = b.scored(spark, d).withColumn("xgb_residual", settle(F.col("xgb_residual"), 6))
    named = joins.lookup_join(rows, b.counties(spark, d), ["fips"], "inner")
    return reports.anomaly_feed(named, ["year", "obs_id", "fips", "county_name", "state_abbr", "commodity_name", "yield_bu_ac",
                                        "xgb_residual", "anomaly_type"], ties=("obs_id",))


@query("o4_top_counties", b.WS + """
SELECT fips, count(*) FILTER (WHERE is_anomaly) AS score FROM scored GROUP BY fips ORDER BY score DESC, fips LIMIT 6""")
def o4(spark, d):
    return reports.top_keys(b.scored(spark, d), "fips", "is_anomaly", 6)


@query("o4_most_frequent", b.with_(b.YIELDS) + "SELECT fips, count(*) AS score FROM yields GROUP BY fips ORDER BY score DESC, fips LIMIT 6")
def o4b(spark, d):
    return reports.top_keys(b.yields(spark, d), "fips", None, 6)


@query("o5_county_series", b.WS + """
SELECT year, obs_id, yield_bu_ac, z_direction <> 'NORMAL' AS is_marked FROM scored
WHERE fips = '00007' AND commodity_name = 'BUILDING' ORDER BY year, obs_id""")
def o5(spark, d):
    return reports.series(b.scored(spark, d), (F.col("fips") == "00007") & (F.col("commodity_name") == "BUILDING"),
                          [F.col("year"), F.col("obs_id")], ["year", "obs_id", "yield_bu_ac"])


@query("o6_seeded_sample", b.with_(b.YIELDS) + """
SELECT obs_id, fips, yield_bu_ac FROM yields ORDER BY md5(CAST(obs_id AS VARCHAR) || '|42'), obs_id LIMIT 500""")
def o6(spark, d):
    return reports.seeded_sample(b.yields(spark, d), ["obs_id"], 500, 42).select("obs_id", "fips", "yield_bu_ac")


@query("o7_head", b.with_(b.YIELDS) + "SELECT obs_id, fips, year, yield_bu_ac FROM yields ORDER BY obs_id LIMIT 10")
def o7(spark, d):
    return reports.head(b.yields(spark, d), [F.col("obs_id")], 10).select("obs_id", "fips", "year", "yield_bu_ac")


@query("u1_union_all", b.with_(b.YIELDS) + """
SELECT obs_id, fips, yield_bu_ac, NULL AS day FROM yields WHERE year < 1998
UNION ALL SELECT obs_id, fips, NULL, day FROM yields WHERE year >= 1998""")
def u1(spark, d):
    rows = b.yields(spark, d)
    return reports.union_all(rows.where("year < 1998").select("obs_id", "fips", "yield_bu_ac"),
                             rows.where("year >= 1998").select("obs_id", "fips", "day"))


@query("u2_distinct_values", b.with_(b.YIELDS) + "SELECT DISTINCT commodity_name FROM yields")
def u2(spark, d):
    return reports.distinct_values(b.yields(spark, d), "commodity_name")

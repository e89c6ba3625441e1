"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions import agronomy, columns, labels
from harvestlens.operators import correlation, joins, reports
from harvestlens.session import cut
from workloads import bases as b
from workloads.bases import R, T
from workloads.registry import query


@query("p1_trim_strings", "SELECT p_partkey, p_name AS padded, p_brand, p_type, p_size, p_retailprice FROM part")
def p1(spark, d):
    rows = b.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("padded"), F.concat("p_brand", F.lit(" ")).alias("p_brand"),
        "p_type", "p_size", "p_retailprice")
    return columns.trim_strings(rows)


@query("p2_rename", "SELECT p_partkey AS part, p_brand AS brand, p_size AS size FROM part")
def p2(spark, d):
    rows = b.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return columns.rename(rows, {"p_partkey": "part", "p_brand": "brand", "p_size": "size"})


@query("p3_casts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
       TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS amount FROM orders""")
def p3(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").when(F.col("o_orderstatus") == "N", "NaN").otherwise(
        F.col("o_totalprice").cast("string"))
    return b.table(spark, d, "orders").select(
        "o_orderkey", columns.strict_cast(F.date_format("o_orderdate", "yyyy"), "int").alias("year"),
        columns.tolerant_cast(F.substring("o_orderpriority", 1, 1), "int").alias("level"),
        columns.tolerant_cast(text, "double").alias("amount"))


@query("p4_zero_pad", """
SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0')
                       ELSE CAST(c_custkey AS VARCHAR) END AS padded FROM customer""")
def p4(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", columns.zero_pad(F.col("c_custkey"), 3).alias("padded"))


@query("p5_composite_key", """
SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code FROM customer""")
def p5(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", columns.composite_key(
        columns.zero_pad(F.col("c_nationkey"), 2), columns.zero_pad(F.col("c_custkey"), 8)).alias("code"))


@query("p6_drop_nulls", b.with_(b.YIELDS) + "SELECT obs_id, fips, gappy_yield FROM yields WHERE gappy_yield IS NOT NULL")
def p6(spark, d):
    return columns.drop_nulls(b.yields(spark, d), ["fips", "gappy_yield"]).select("obs_id", "fips", "gappy_yield")


@query("p7_in_list", b.with_(b.YIELDS) + """
SELECT obs_id, commodity_name, year FROM yields WHERE commodity_name IN ('BUILDING', 'MACHINERY') AND year IN (1996, 1998)""")
def p7(spark, d):
    rows = b.yields(spark, d)
    return rows.where(columns.in_list(F.col("commodity_name"), ["BUILDING", "MACHINERY"])
                      & columns.in_list(F.col("year"), [1996, 1998])).select("obs_id", "commodity_name", "year")


@query("p8_prefix", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')")
def p8(spark, d):
    return b.table(spark, d, "pages").where(columns.has_prefix(F.col("url"), "https://")).select("page_id", "url")


@query("p9_blank_and_present", b.with_(b.YIELDS) + """
SELECT count(*) FILTER (WHERE gappy_yield IS NULL) AS missing, count(*) FILTER (WHERE gappy_yield IS NOT NULL) AS present,
       count(*) FILTER (WHERE status = 'P') AS blanks FROM yields""")
def p9(spark, d):
    flag = F.when(F.col("status") == "P", " ").otherwise(F.col("status"))
    return b.yields(spark, d).agg(
        F.count_if(F.col("gappy_yield").isNull()).alias("missing"), F.count_if(F.col("gappy_yield").isNotNull()).alias("present"),
        F.count_if(columns.blank(flag)).alias("blanks"))


@query("p10_tolerant_date", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day FROM orders
WHERE o_orderstatus = 'P' OR month(o_orderdate) BETWEEN 4 AND 10""")
def p10(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = b.table(spark, d, "orders").select("o_orderkey", columns.parse_date(text).alias("day"))
    return rows.where(F.col("day").isNull() | columns.in_list(F.month("day"), config.GROWING_MONTHS))


@query("p11_unit_scaling", """
SELECT event_id, CASE event_type WHEN 'signup' THEN value ELSE value / 10 END AS scaled FROM events""")
def p11(spark, d):
    names = F.create_map(*[F.lit(x) for pair in b.ELEMENTS.items() for x in pair])
    return b.table(spark, d, "events").select(
        "event_id", agronomy.scale_tenths(names[F.col("event_type")], F.col("value")).alias("scaled"))


@query("p12_plausible", """
SELECT event_id, event_type, value FROM events
WHERE CASE WHEN event_type = 'purchase' THEN value BETWEEN 0 AND 2000 ELSE value BETWEEN -60 AND 60 END""")
def p12(spark, d):
    rows = b.table(spark, d, "events").select("event_id", "event_type", "value")
    return rows.where(agronomy.plausible(F.col("event_type"), F.col("value"), rain="purchase"))


@query("p13_sentinels", f"""
SELECT l_suppkey, sum(CASE WHEN l_quantity < 45 THEN 1 ELSE 0 END) AS warm_n,
       {R("avg(CASE WHEN l_quantity < 45 THEN (l_quantity - 32) * 5 / 9 END)", 6)} AS warm_c,
       {R("sum(CASE WHEN l_quantity < 40 THEN l_quantity * 25.4 ELSE 0 END)", 4)} AS rain_mm,
       {R("max(CASE WHEN l_quantity < 50 THEN l_quantity * 0.514444 END)", 6)} AS wind_ms
FROM lineitem GROUP BY l_suppkey""")
def p13(spark, d):
    q = F.col("l_quantity")
    warm = agronomy.fahrenheit_to_c(q, 45.0)
    return b.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(warm).alias("warm_n"), columns.settle(F.avg(warm), 6).alias("warm_c"),
        columns.settle(F.sum(agronomy.inches_to_mm(q, 40.0)), 4).alias("rain_mm"),
        columns.settle(F.max(agronomy.knots_to_ms(q, 50.0)), 6).alias("wind_ms"))


@query("p14_clip", b.with_(b.YIELDS) + """
SELECT obs_id, CASE WHEN gappy_yield IS NOT NULL THEN greatest(gappy_yield, 100) END AS clipped FROM yields""")
def p14(spark, d):
    return b.yields(spark, d).select("obs_id", columns.clip_lower(F.col("gappy_yield"), 100.0).alias("clipped"))


P15 = ", ".join(f"CAST(round(CAST(yield_bu_ac AS DECIMAL(38, 12)), {n}) AS DOUBLE) AS r{n}" for n in (1, 2, 0))


@query("p15_round", b.with_(b.YIELDS) + f"""
SELECT obs_id, {P15} FROM yields""")
def p15(spark, d):
    y = F.col("yield_bu_ac")
    return b.yields(spark, d).select("obs_id", *[columns.round_to(y, n).alias(f"r{n}") for n in (1, 2, 0)])


@query("p16_active_features", b.with_(b.DAILY, b.WEATHER) + """
SELECT feature FROM (SELECT count(tmax_mean_c) AS tmax_mean_c, count(tmin_mean_c) AS tmin_mean_c, count(tavg_mean_c) AS tavg_mean_c,
  count(precip_total_mm) AS precip_total_mm, count(gdd_base10) AS gdd_base10, count(heat_stress_days) AS heat_stress_days,
  count(drought_days) AS drought_days, count(et0_total_mm) AS et0_total_mm, count(solar_total_mj) AS solar_total_mj,
  count(precip_z) AS precip_z, count(cwsi) AS cwsi FROM weather)
UNPIVOT (n FOR feature IN (tmax_mean_c, tmin_mean_c, tavg_mean_c, precip_total_mm, gdd_base10, heat_stress_days, drought_days,
  et0_total_mm, solar_total_mj, precip_z, cwsi)) WHERE n > 0""")
def p16(spark, d):
    found = columns.active_features(b.weather(spark, d), ["absent", *config.WEATHER_FEATURES])
    return spark.createDataFrame([(f,) for f in found], "feature string")


@query("p17_et0", b.with_(b.DAILY, b.WEATHER) + f"SELECT fips, year, {R('et0_estimate_mm', 4)} AS et0_estimate_mm FROM weather")
def p17(spark, d):
    return b.weather(spark, d).select("fips", "year", columns.settle(F.col("et0_estimate_mm"), 4).alias("et0_estimate_mm"))


@query("p18_water_stress", b.with_(b.DAILY, b.WEATHER) + "SELECT fips, year, cwsi FROM weather")
def p18(spark, d):
    return b.weather(spark, d).select("fips", "year", "cwsi")


@query("p19_heat_share", b.with_(b.DAILY, b.WEATHER) + "SELECT fips, year, heat_fraction FROM weather")
def p19(spark, d):
    return b.weather(spark, d).select("fips", "year", "heat_fraction")


@query("p20_directions", b.WS + "SELECT obs_id, z_direction, residual_direction FROM scored")
def p20(spark, d):
    return b.scored(spark, d).select(
        "obs_id", labels.direction(F.col("yield_z_robust")).alias("z_direction"), "residual_direction")


@query("p21_residual", b.WS + f"SELECT obs_id, {R('xgb_residual', 6)} AS xgb_residual FROM scored")
def p21(spark, d):
    gap = labels.residual(F.col("yield_bu_ac"), F.col("xgb_predicted_yield"))
    return b.scored(spark, d).select("obs_id", columns.settle(gap, 6).alias("xgb_residual"))


@query("p22_any_flag", b.WS + "SELECT obs_id, is_anomaly FROM scored")
def p22(spark, d):
    return b.scored(spark, d).select("obs_id", "is_anomaly")


@query("p23_anomaly_type", b.WS + "SELECT obs_id, anomaly_type FROM scored")
def p23(spark, d):
    return b.scored(spark, d).select("obs_id", "anomaly_type")


CONTEXT = f"""
context AS (
  SELECT *, coalesce(nullif(concat_ws('; ',
    CASE WHEN precip_z < -1.5 THEN 'drought (precip ' || {T("precip_total_mm", 0)} || ' mm, Z=' || {T("precip_z", 1)} || ')'
         WHEN precip_z > 1.5 THEN 'excess moisture (precip ' || {T("precip_total_mm", 0)} || ' mm, Z=' || {T("precip_z", 1)} || ')' END,
    CASE WHEN heat_stress_days > 20 THEN 'heat stress (' || CAST(heat_stress_days AS VARCHAR) || ' days >35°C)' END,
    CASE WHEN gdd_base10 < CASE WHEN commodity_name = 'BUILDING' THEN 1200 ELSE 900 END
         THEN 'low GDD (' || {T("gdd_base10", 0)} || ')' END,
    CASE WHEN cwsi > 2.0 THEN 'water stress (CWSI=' || {T("cwsi", 1)} || ')' END,
    CASE year WHEN 1996 THEN 'Dry spring' WHEN 1998 THEN 'Late frost' WHEN 2000 THEN 'Wet harvest' END), ''),
    'no clear weather signal — investigate non-meteorological factors') AS rule_text
  FROM scored)"""


@query("p24_weather_context", b.WS.rstrip() + "," + CONTEXT + "\nSELECT obs_id, rule_text FROM context")
def p24(spark, d):
    rows = b.scored(spark, d)
    return rows.select("obs_id", labels.weather_context(rows, long_season_crop="BUILDING", events=b.EVENTS).alias("rule_text"))


def _part(i: int) -> str:
    size = T(f"abs(top[{i}].v)", 1)
    return (f"top[{i}].f || CASE WHEN top[{i}].v > 0 THEN ' increased' ELSE ' decreased' END || ' predicted yield by ' || {size}"
            " || ' bu/ac'")


DRIVERS = f"""
drivers AS (
  SELECT *, list_sort([{{'s': -round(abs(v1), 6), 'f': 'gdd base10', 'v': v1}}, {{'s': -round(abs(v2), 6), 'f': 'precip z', 'v': v2}},
                       {{'s': -round(abs(v3), 6), 'f': 'cwsi', 'v': v3}}, {{'s': -round(abs(v4), 6), 'f': 'heat stress days', 'v': v4}}]) AS top
  FROM (SELECT *, yield_bu_ac / 7 - 30 AS v1, precip_z * 3 AS v2, cwsi / 11 AS v3, yield_bu_ac / 13 AS v4 FROM context)),
texts AS (
  SELECT *, {" || '; ' || ".join(_part(i) for i in (1, 2, 3))} AS shap_explanation,
         'After weather effects, actual yield was ' || {T("abs(xgb_residual)", 1)} || ' bu/ac '
           || CASE WHEN xgb_residual < 0 THEN 'below' ELSE 'above' END || ' the model''s prediction (residual Z='
           || {T("xgb_residual_z", 2)} || ') — ' || CASE WHEN abs(xgb_residual_z) > 1.5
              THEN 'this gap is statistically significant and likely non-meteorological.'
              ELSE 'this gap is within normal prediction error.' END AS residual_explanation
  FROM drivers)"""


def _texts(spark, d):
    rows = b.scored(spark, d)
    y = F.col("yield_bu_ac")
    values = {"gdd_base10": y / 7 - 30, "precip_z": F.col("precip_z") * 3, "cwsi": F.col("cwsi") / 11, "heat_stress_days": y / 13}
    found = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()])
    drivers = F.array_sort(found, lambda p, q: F.when(F.abs(p["value"]) > F.abs(q["value"]), -1).otherwise(1))
    return rows.withColumns({
        "shap_explanation": labels.driver_sentence(drivers),
        "residual_explanation": labels.residual_sentence(F.col("xgb_residual"), F.col("xgb_residual_z"))})


@query("p25_driver_sentences", b.WS.rstrip() + "," + CONTEXT + "," + DRIVERS + "\nSELECT obs_id, shap_explanation, residual_explanation FROM texts")
def p25(spark, d):
    return _texts(spark, d).select("obs_id", "shap_explanation", "residual_explanation")


@query("p26_full_explanation", b.WS.rstrip() + "," + CONTEXT + "," + DRIVERS + f"""
SELECT obs_id, 'Unexpectedly ' || CASE WHEN yield_z_robust < 0 THEN 'LOW' ELSE 'HIGH' END || ' yield (Z=' || {T("yield_z_robust", 2)}
       || ') | ' || CASE WHEN status <> 'P' THEN 'Model attribution: ' || shap_explanation || ' | ' || residual_explanation || ' | '
                    ELSE '' END || 'Weather context: ' || rule_text AS explanation
FROM texts WHERE is_anomaly""")
def p26(spark, d):
    rows = _texts(spark, d).where("is_anomaly")
    known = F.col("status") != "P"
    context = labels.weather_context(rows, long_season_crop="BUILDING", events=b.EVENTS)
    text = labels.full_explanation(
        F.col("yield_z_robust"), F.when(known, F.col("shap_explanation")).otherwise(""),
        F.when(known, F.col("residual_explanation")).otherwise(""), context)
    return rows.select("obs_id", text.alias("explanation"))


@query("p27_labels", b.with_(b.YIELDS) + """
SELECT obs_id, CASE commodity_name WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Machines' ELSE commodity_name END
       AS label FROM yields""")
def p27(spark, d):
    return b.yields(spark, d).select("obs_id", labels.label_lookup(
        F.col("commodity_name"), {"BUILDING": "Construction", "MACHINERY": "Machines"}).alias("label"))


@query("p28_event_years", b.with_(b.YIELDS) + """
SELECT year, count(*) AS n, CASE year WHEN 1996 THEN 'Dry spring' WHEN 1998 THEN 'Late frost' WHEN 2000 THEN 'Wet harvest' END AS event
FROM yields GROUP BY year""")
def p28(spark, d):
    return reports.count_by(b.yields(spark, d), ["year"]).withColumn("event", labels.event_name(F.col("year"), b.EVENTS))


@query("p29_present_columns", b.WS + """
SELECT fips, commodity_name, irr_name, year, yield_bu_ac, z_direction, anomaly_type FROM scored WHERE is_anomaly""")
def p29(spark, d):
    return labels.keep_present(b.scored(spark, d).where("is_anomaly"), [
        "fips", "not_there", "commodity_name", "irr_name", "year", "yield_bu_ac", "z_direction", "anomaly_type"])


@query("p30_year_split", b.with_(b.YIELDS) + """
SELECT CASE WHEN year BETWEEN 1995 AND 1999 THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(year) AS first_year,
       max(year) AS last_year FROM yields GROUP BY split""")
def p30(spark, d):
    train, test = columns.split_years(b.yields(spark, d), b.TRAIN_YEARS)
    both = reports.union_all(train.withColumn("split", F.lit("train")), test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def pearson_sql(features: list[str]) -> str:
    one = """SELECT commodity_name AS crop, '{f}' AS feature, count(*) AS n,
       CASE WHEN stddev_pop(yield_bu_ac) > 0 AND stddev_pop({f}) > 0 THEN corr(yield_bu_ac, {f}) END AS r
FROM merged WHERE yield_bu_ac IS NOT NULL AND {f} IS NOT NULL GROUP BY commodity_name"""
    return " UNION ALL ".join(one.format(f=f) for f in features)


@query("p31_effect_direction", b.WM.rstrip() + ", r AS (" + pearson_sql(b.ACTIVE) + """)
SELECT crop, feature, CASE WHEN r < 0 THEN 'reduces yield' ELSE 'increases yield' END AS effect FROM r""")
def p31(spark, d):
    corr = cut(correlation.pearson(b.merged(spark, d), "commodity_name", "yield_bu_ac", b.ACTIVE))
    ranked = corr.select("crop", "feature", (F.abs("r") * 2).alias("importance"))
    signs = corr.select("crop", "feature", "r")
    both = joins.lookup_join(ranked, signs, ["crop", "feature"], "left")
    return both.select("crop", "feature", labels.effect_direction(F.col("r")).alias("effect"))

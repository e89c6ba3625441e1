"""Sources and sinks (S1-S14). Files are written by Spark from the given tables, then read by the source operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens import config
from harvestlens.functions.columns import fixed, settle, zero_pad
from harvestlens.operators import joins, reports, season
from harvestlens.plans import stages
from harvestlens.session import scratch_path
from harvestlens.sources import files, payloads, tables
from workloads import bases as b
from workloads.bases import R
from workloads.registry import query


def _yield_csv(spark, d) -> str:
    rows = b.yields(spark, d).select(
        F.substring("commodity_name", 1, 2).alias("Commodity Code"),
        F.concat(F.lit(" "), "commodity_name", F.lit("  ")).alias("Commodity Name"),
        F.col("fips").cast("int").cast("string").alias("State Code"), F.lit(" North ").alias("State Name"),
        F.lit("NO").alias("State Abbreviation"), F.col("fips").cast("int").cast("string").alias("County Code"),
        F.concat(F.lit("County "), F.col("fips")).alias("County Name"),
        F.substring("irr_name", 1, 1).alias("Irrigation Practice Code"), F.col("irr_name").alias("Irrigation Practice Name"),
        F.col("year").alias("Yield Year"),
        F.coalesce(F.col("gappy_yield").cast("string"), F.lit("n/a")).alias("Yield Amount"))
    path = scratch_path(spark, "yield-csv")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("s1_yield_csv", b.with_(b.YIELDS) + f"""
SELECT substr(commodity_name, 1, 2) AS commodity_code, commodity_name, lpad(CAST(CAST(fips AS INT) AS VARCHAR), 2, '0') AS state_code,
       'North' AS state_name, 'NO' AS state_abbr, substr(fips, 3) AS county_code, 'County ' || fips AS county_name,
       substr(irr_name, 1, 1) AS irr_code, irr_name, year, gappy_yield AS yield_bu_ac,
       lpad(CAST(CAST(fips AS INT) AS VARCHAR), 2, '0') || substr(fips, 3) AS fips
FROM yields""")
def s1(spark, d):
    return files.read_yields(spark, _yield_csv(spark, d))


@query("s2_daily_year_files", b.with_(b.OBS) + "SELECT station_id, date, element, data_value, year FROM obs")
def s2(spark, d):
    folder = scratch_path(spark, "daily")
    b.observations_raw(spark, d).write.option("compression", "gzip").csv(f"{folder}/2024.csv.gz")
    raw = files.read_daily(spark, folder, [2023, 2024])
    return season.clean_observations(raw, months=b.OBS_MONTHS)


@query("s3_station_list", f"""
WITH s AS (SELECT *, ['AL','AR','CO','DE','IA','IL','IN','KS','KY','LA','MD','MI','MN','MO','MS','NC','ND','NE','NJ','NY','OH',
                  'OK','PA','SC','SD','TN','TX','VA','VT','WI','WV','WY'][s_nationkey + 1] AS st FROM supplier)
SELECT 'US' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS station_id, {R("s_acctbal / 100", 4)} AS lat,
       {R("-s_acctbal / 100", 4)} AS lon, st AS state, s_name AS name
FROM s WHERE s_acctbal >= 0 AND s_nationkey < 20""")
def s3(spark, d):
    states = F.array(*[F.lit(x) for x in config.TARGET_STATES])
    lines = b.table(spark, d, "supplier").select(F.when(F.col("s_acctbal") < 0, F.lit("US short line")).otherwise(F.concat(
        F.lit("US"), zero_pad(F.col("s_suppkey"), 9), F.lit(" "), F.lpad(fixed(F.col("s_acctbal") / 100, 4), 8, " "), F.lit(" "),
        F.lpad(fixed(-F.col("s_acctbal") / 100, 4), 9, " "), F.lit("        "),
        F.when(F.col("s_nationkey") < 20, states[F.col("s_nationkey")]).otherwise("ZZ"), F.lit(" "),
        F.rpad("s_name", 30, " "))).alias("value"))
    path = scratch_path(spark, "stations")
    lines.write.text(path)
    return files.read_stations(spark, path)


@query("s4_centroid_csv", f"""
SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 3
         THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS fips,
       lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state_fips,
       CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 3 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0')
            ELSE CAST(s_suppkey AS VARCHAR) END AS county_fips,
       s_acctbal AS lat, -s_acctbal AS lon, s_name AS county_name, 'North' AS state_name
FROM supplier""")
def s4(spark, d):
    rows = b.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("﻿statefp"), F.col("s_suppkey").alias(" CountyFP"),
        F.concat(F.lit(" "), "s_name").alias("CouName"), F.lit("North ").alias("STNAME"),
        F.lit(1).alias("POPULATION"), F.col("s_acctbal").alias("LATITUDE"), (-F.col("s_acctbal")).alias("longitude "))
    path = scratch_path(spark, "centroids")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_centroids(spark, path)


@query("s5_fallback_centroids", """
WITH f(fips, lat, lon) AS (VALUES ('19013', 42.08, -93.54), ('19153', 41.65, -93.60), ('19085', 42.47, -92.32),
  ('17001', 40.16, -88.52), ('17019', 40.56, -88.87), ('18039', 40.20, -86.85), ('31055', 41.55, -97.59),
  ('27049', 44.30, -93.96), ('39047', 40.70, -83.59), ('20035', 38.39, -95.70)),
o AS (SELECT CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 5 THEN lpad(CAST(o_orderkey AS VARCHAR), 5, '0')
             ELSE CAST(o_orderkey AS VARCHAR) END AS fips FROM orders)
SELECT o.fips, substr(o.fips, 1, 2) AS state_fips, substr(o.fips, 3) AS county_fips, CAST(lat AS DOUBLE) AS lat,
       CAST(lon AS DOUBLE) AS lon
FROM o LEFT JOIN f ON o.fips = f.fips""")
def s5(spark, d):
    keys = b.table(spark, d, "orders").select(zero_pad(F.col("o_orderkey"), 5).alias("fips"))
    return joins.with_centroids(files.split_key(keys), files.fallback_centroids(spark))


GSOD_SQL = f"""
SELECT l_suppkey AS stn, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
       CAST(day(l_shipdate) AS INTEGER) AS day, CAST(s_nationkey AS DOUBLE) AS lat, -CAST(s_nationkey AS DOUBLE) AS lon,
       CASE WHEN l_returnflag <> 'R' THEN {R("(l_quantity + 32 - 32) * 5 / 9", 6)} END AS tmax_c,
       {R("(l_quantity - 32) * 5 / 9", 6)} AS tmin_c, {R("(l_quantity + 10 - 32) * 5 / 9", 6)} AS tavg_c,
       CASE WHEN l_linestatus = 'O' THEN {R("l_tax * 25.4", 6)} ELSE 0 END AS prcp_mm,
       CASE WHEN l_linenumber < 7 THEN {R("l_discount * 100 * 0.514444", 6)} END AS wdsp_ms
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE month(l_shipdate) BETWEEN 4 AND 10 AND s_acctbal >= 0"""


def _gsod_view(spark, d) -> str:
    lines = b.table(spark, d, "lineitem")
    suppliers = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal")
    wide = lines.join(suppliers, "l_suppkey").select(
        F.col("l_suppkey").alias("stn"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("mo"),
        F.dayofmonth("l_shipdate").alias("da"), (F.col("l_quantity") + 10).alias("temp"),
        F.when(F.col("l_returnflag") == "R", 9999.9).otherwise(F.col("l_quantity") + 32).alias("max"),
        F.col("l_quantity").alias("min"), F.when(F.col("l_linestatus") == "O", F.col("l_tax")).otherwise(99.99).alias("prcp"),
        F.when(F.col("l_linenumber") < 7, F.col("l_discount") * 100).otherwise(999.9).alias("wdsp"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey").cast("double")).alias("lat"),
        (-F.col("s_nationkey").cast("double")).alias("lon"))
    name = f"gsod_{uuid.uuid4().hex}"
    wide.createOrReplaceTempView(name)
    return name


@query("s6_first_existing_table", GSOD_SQL)
def s6(spark, d):
    rows = season.pooled_units(tables.scan_first(spark, ["no_such_table", _gsod_view(spark, d)]))
    measures = ["tmax_c", "tmin_c", "tavg_c", "prcp_mm", "wdsp_ms"]
    return rows.withColumns({c: F.round(F.round(c, 12), 6) for c in measures})


@query("s6_station_table_seasons", f"""
WITH g AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS fips, CAST(year(l_shipdate) AS INTEGER) AS year,
       CAST(s_nationkey AS DOUBLE) AS lat, -CAST(s_nationkey AS DOUBLE) AS lon,
       CASE WHEN l_returnflag <> 'R' THEN l_quantity * 5 / 9 END AS tmax, (l_quantity - 32) * 5 / 9 AS tmin,
       CASE WHEN l_linestatus = 'O' THEN l_tax * 25.4 ELSE 0 END AS prcp,
       CASE WHEN l_linenumber < 7 THEN l_discount * 100 * 0.514444 END AS wind
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE month(l_shipdate) BETWEEN 4 AND 10 AND s_acctbal >= 0 AND year(l_shipdate) BETWEEN 1996 AND 2000)
SELECT fips, year, {R("avg(tmax)", 4)} AS tmax_mean_c, {R("avg(tmin)", 4)} AS tmin_mean_c, {R("avg((tmax + tmin) / 2)", 4)} AS tavg_mean_c,
       {R("sum(prcp)", 4)} AS precip_total_mm, {R("coalesce(sum(greatest((tmax + tmin) / 2 - 10, 0)) FILTER (WHERE tmax IS NOT NULL), 0)", 4)} AS gdd_base10,
       count(*) FILTER (WHERE tmax > 35) AS heat_stress_days, count(*) FILTER (WHERE prcp < 0.5) AS drought_days,
       {R("avg(wind)", 4)} AS wind_mean_ms, any_value(lat) AS lat, any_value(lon) AS lon
FROM g GROUP BY fips, year HAVING count(tmax) > 0""")
def s6b(spark, d):
    """From the station table to county seasons: units, nearest county, pooled aggregate, centroid."""
    counties = b.table(spark, d, "nation").select(
        zero_pad(F.col("n_nationkey"), 5).alias("fips"), F.col("n_nationkey").cast("double").alias("lat"),
        (-F.col("n_nationkey").cast("double")).alias("lon"))
    seasons = stages.weather_from_station_table(spark, counties, list(range(1996, 2001)), candidates=["no_such_table", _gsod_view(spark, d)])
    measures = ["tmax_mean_c", "tmin_mean_c", "tavg_mean_c", "precip_total_mm", "gdd_base10", "wind_mean_ms"]
    return seasons.drop("et0_total_mm", "solar_total_mj").withColumns({c: settle(F.col(c), 4) for c in measures})


@query("s7_json_arrays", """
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d0 FROM orders)
SELECT o_orderkey AS loc, d0 + i AS date, CASE i WHEN 0 THEN o_totalprice / 1000 WHEN 1 THEN NULL ELSE CAST(36.5 AS DOUBLE) END AS temperature_2m_max,
       CAST(i AS DOUBLE) AS temperature_2m_min, CASE i WHEN 0 THEN NULL ELSE i / 4 END AS precipitation_sum,
       CAST(NULL AS DOUBLE) AS et0_fao_evapotranspiration, CAST(o_custkey AS DOUBLE) AS shortwave_radiation_sum,
       CAST(NULL AS DOUBLE) AS windgusts_10m_max
FROM o, (SELECT unnest([0, 1, 2]) AS i) WHERE o_orderstatus <> 'F'""")
def s7(spark, d):
    day = F.to_date("o_orderdate")
    body = F.struct(
        F.array(*[F.date_add(day, i).cast("string") for i in range(3)]).alias("time"),
        F.array(F.col("o_totalprice") / 1000, F.lit(None).cast("double"), F.lit(36.5)).alias("temperature_2m_max"),
        F.array(*[F.lit(float(i)) for i in range(3)]).alias("temperature_2m_min"),
        F.array(F.lit(None).cast("double"), F.lit(0.25), F.lit(0.5)).alias("precipitation_sum"),
        F.array(*[F.col("o_custkey").cast("double")] * 3).alias("shortwave_radiation_sum"))
    raw = b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("loc"),
        F.when(F.col("o_orderstatus") == "F", F.lit('{"daily": {}}')).otherwise(F.to_json(F.struct(body.alias("daily")))).alias("body"))
    return payloads.daily_from_arrays(raw, "body", ["loc"])


@query("s8_json_maps", """
SELECT o_orderkey AS loc, CAST(o_orderdate AS DATE) + i AS date,
       CASE i WHEN 0 THEN o_totalprice / 1000 END AS "T2M_MAX", CAST(i AS DOUBLE) AS "T2M_MIN",
       CASE WHEN i = 0 AND o_orderstatus <> 'P' THEN CAST(-0.5 AS DOUBLE) END AS "PRECTOTCORR", CAST(NULL AS DOUBLE) AS "ALLSKY_SFC_SW_DWN",
       CAST(NULL AS DOUBLE) AS "RH2M", CASE i WHEN 1 THEN CAST(2.5 AS DOUBLE) END AS "WS2M"
FROM orders, (SELECT unnest([0, 1]) AS i)""")
def s8(spark, d):
    days = [F.date_format(F.date_add(F.to_date("o_orderdate"), i), "yyyyMMdd") for i in range(2)]
    rain = F.when(F.col("o_orderstatus") == "P", -999.0).otherwise(-0.5)
    inner = {
        "T2M_MAX": F.create_map(days[0], F.col("o_totalprice") / 1000, days[1], F.lit(-999.0)),
        "T2M_MIN": F.create_map(days[0], F.lit(0.0), days[1], F.lit(1.0)),
        "PRECTOTCORR": F.create_map(days[0], rain), "WS2M": F.create_map(days[1], F.lit(2.5)),
    }
    parameter = F.create_map(*[x for k, v in inner.items() for x in (F.lit(k), v)])
    body = F.to_json(F.struct(F.struct(parameter.alias("parameter")).alias("properties")))
    raw = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("loc"), body.alias("body"))
    return payloads.daily_from_maps(raw, "body", ["loc"])


TABLE_SQL = b.with_(b.YIELDS) + """
SELECT commodity_name, year, count(*) AS n, count(DISTINCT fips) AS counties, min(obs_id) AS first_obs,
       max(yield_bu_ac) AS top_yield FROM yields GROUP BY commodity_name, year"""


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("commodity_name", "year").agg(
        F.count("*").alias("n"), F.count_distinct("fips").alias("counties"), F.min("obs_id").alias("first_obs"),
        F.max("yield_bu_ac").alias("top_yield"))


def _written(spark, d) -> str:
    path = scratch_path(spark, "yields")
    tables.write_table(b.yields(spark, d), path, partition_by=["commodity_name", "year"])
    return path


@query("s9_table_read", TABLE_SQL)
def s9(spark, d):
    return _summary(tables.read_table(spark, _written(spark, d)))


@query("s9_table_with_nan", b.with_(b.YIELDS) + f"""
SELECT commodity_name, count(*) AS n, count(gappy_yield) AS known, {R("avg(gappy_yield)", 6)} AS mean, max(gappy_yield) AS top
FROM yields GROUP BY commodity_name""")
def s9_nan(spark, d):
    """A table that holds NaN where a value is missing, as other writers leave it."""
    path = scratch_path(spark, "nan")
    rows = b.yields(spark, d).withColumn("gappy_yield", F.coalesce("gappy_yield", F.lit(float("nan"))))
    rows.write.parquet(path)
    return tables.read_table(spark, path).groupBy("commodity_name").agg(
        F.count("*").alias("n"), F.count("gappy_yield").alias("known"), settle(F.avg("gappy_yield"), 6).alias("mean"),
        F.max("gappy_yield").alias("top"))


@query("s10_table_overwrite", TABLE_SQL)
def s10(spark, d):
    path = scratch_path(spark, "yields")
    rows = b.yields(spark, d)
    tables.write_table(rows.where("year < 1998"), path, partition_by=["commodity_name"])
    tables.write_table(rows, path, partition_by=["commodity_name"])
    return _summary(tables.read_table(spark, path))


@query("s11_table_registration", TABLE_SQL)
def s11(spark, d):
    name = f"fields.yields_{uuid.uuid4().hex}"
    tables.register(spark, name, _written(spark, d))
    return _summary(spark.table(name))


@query("s12_resume_by_year", b.with_(b.DAILY) + """
SELECT fips, year, sum(tmax_c) AS heat, count(*) AS days FROM daily GROUP BY fips, year""")
def s12(spark, d):
    path = scratch_path(spark, "seasons")

    def compute(years):
        rows = b.daily(spark, d).where(F.col("year").isin(years))
        return rows.groupBy("fips", "year").agg(F.sum("tmax_c").alias("heat"), F.count("*").alias("days"))

    tables.extend_by_year(spark, path, [1995, 1996, 1997], compute)
    return tables.extend_by_year(spark, path, list(range(1995, 2002)), compute)


@query("s13_resume_by_key", b.with_(b.YIELDS) + """
, done AS (SELECT fips, year, count(*) AS n FROM yields WHERE status = 'F' AND yield_bu_ac > 450 GROUP BY fips, year),
fresh AS (SELECT fips, year, count(*) AS n FROM yields GROUP BY fips, year)
SELECT fips, year, n, 'kept' AS origin FROM done
UNION ALL SELECT fips, year, n, 'new' AS origin FROM fresh ANTI JOIN done USING (fips, year)""")
def s13(spark, d):
    rows = b.yields(spark, d)
    done = rows.where((F.col("status") == "F") & (F.col("yield_bu_ac") > 450)).groupBy("fips", "year").agg(
        F.count("*").alias("n")).withColumn("origin", F.lit("kept"))
    work = rows.groupBy("fips", "year").agg(F.count("*").alias("n"))
    fresh = tables.resume_keys(work, done).withColumn("origin", F.lit("new"))
    return tables.merge_done(done, fresh)


@query("s14_tables_ready", """
SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def s14(spark, d):
    tag = uuid.uuid4().hex
    names = ["orders", "customer", "lineitem"]
    for n in names:
        b.table(spark, d, n).createOrReplaceTempView(f"{n}_{tag}")
    tables.require_tables(spark, [f"{n}_{tag}" for n in names])
    return reports.union_all(*[
        spark.table(f"{n}_{tag}").agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names])

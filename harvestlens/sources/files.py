"""File sources: yields, daily observations, stations, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestlens import config, schemas
from harvestlens.functions.columns import composite_key, rename, strict_cast, tolerant_cast, trim_strings, without_nan, zero_pad
from harvestlens.operators.season import clean_observations


def read_yields(spark: SparkSession, path: str) -> DataFrame:
    """Yield CSV with a header: trimmed, renamed, typed, with the county key.

    Columns are taken by the header's names. A year that is no number fails the read; such a
    yield amount becomes null.
    """
    raw = spark.read.option("header", True).csv(path)
    return clean_yields(raw)


def clean_yields(raw: DataFrame) -> DataFrame:
    df = rename(trim_strings(raw), schemas.YIELD_NAMES)
    typed = df.withColumns({
        "year": strict_cast(F.col("year"), "int"), "yield_bu_ac": tolerant_cast(F.col("yield_bu_ac"), "double"),
        "state_code": zero_pad(F.col("state_code"), 2), "county_code": zero_pad(F.col("county_code"), 3),
    })
    return typed.withColumn("fips", composite_key(F.col("state_code"), F.col("county_code")))


def find_year_files(spark: SparkSession, folder: str, years: list[int]) -> tuple[dict[int, str], list[int]]:
    """Path per year, the compressed file first, and the years without one. Works on any Hadoop path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[int, str] = {}
    for year in years:
        for name in (f"{year}.csv.gz", f"{year}.csv"):
            path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
            if path.getFileSystem(conf).exists(path):
                found[year] = f"{folder.rstrip('/')}/{name}"
                break
    return found, [y for y in years if y not in found]


def read_daily(spark: SparkSession, folder: str, years: list[int]) -> DataFrame:
    """Raw daily rows of the year files that exist, with the year of the file name.

    A gzip file is read by one task. The rows are not spread first: the aggregate by station and day
    that follows combines them in that task and spreads what is left. ``land_daily`` gives a splittable copy.
    """
    found, _ = find_year_files(spark, folder, years)
    if not found:
        return spark.createDataFrame([], schemas.DAILY_CSV).withColumn("year", F.lit(None).cast("int"))
    return _daily_rows(spark.read.schema(schemas.DAILY_CSV).csv(list(found.values())))


def file_year():
    """The year in the name of the file that a row comes from."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})\.csv", 1).cast("int")


def _daily_rows(raw: DataFrame) -> DataFrame:
    return without_nan(raw.withColumn("year", file_year())).where(F.col("element").isin(config.DAILY_ELEMENTS))


def _delivery(path):
    """The year file, or folder of parts of a year, that a file belongs to; schemes and escapes removed."""
    return F.regexp_extract(F.regexp_replace(F.url_decode(path), "^[a-z0-9]+:/+", "/"), r"^(.*?\d{4}\.csv)", 1)


def read_delivered(spark: SparkSession, folder: str, years: list[int], pattern: str) -> DataFrame:
    """Raw daily rows of all deliveries of these years below a folder.

    Of a compressed and a plain file with one name the compressed one is read. Where a station, day and
    element is in several deliveries, the newest that holds it counts: years are published again
    while they last.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    named = listed.select("path", "modificationTime", _delivery(F.col("path")).alias("delivery"))
    one = Window.partitionBy(F.regexp_replace("path", r"\.gz$", "")).orderBy(F.col("path").desc())
    wanted = named.where(F.regexp_extract("delivery", r"(\d{4})\.csv$", 1).try_cast("int").isin(years))
    found = wanted.withColumn("place", F.row_number().over(one)).where("place = 1").collect()  # the files of a few years
    if not found:
        return spark.createDataFrame([], schemas.DAILY_CSV).withColumn("year", F.lit(None).cast("int"))
    raw = spark.read.schema(schemas.DAILY_CSV).csv([r.path for r in found])
    newest: dict = {}
    for r in found:
        newest[r.delivery] = max(newest.get(r.delivery, r.modificationTime), r.modificationTime)
    if len(newest) == len({d[-8:-4] for d in newest}):
        return _daily_rows(raw)
    ranked = sorted(newest, key=lambda d: (newest[d], d))
    age = F.create_map(*[F.lit(x) for pair in zip(ranked, range(len(ranked))) for x in pair])
    aged = _daily_rows(raw.withColumn("__age", age[_delivery(F.col("_metadata.file_path"))]))
    key = ["station_id", "date", "element"]
    return aged.join(aged.groupBy(*key).agg(F.max("__age").alias("__newest")), key).where(
        "__age = __newest").select(*[c for c in aged.columns if c != "__age"])


def land_daily(spark: SparkSession, folder: str, years: list[int], path: str, *,
               months: list[int] = config.GROWING_MONTHS) -> DataFrame:
    """Write the cleaned season observations once as parquet by year; later reads split and prune.

    A packed year file is read by one task, so it is read this once only. Returns the written table.
    """
    clean = clean_observations(read_daily(spark, folder, years), months=months)
    clean.write.mode("overwrite").partitionBy("year").parquet(path)
    return spark.read.schema(clean.schema).parquet(path)


def read_stations(spark: SparkSession, path: str, states: list[str] = config.TARGET_STATES) -> DataFrame:
    """Station list in fixed columns (S3)."""
    return parse_stations(spark.read.text(path), states)


def parse_stations(lines: DataFrame, states: list[str] = config.TARGET_STATES) -> DataFrame:
    """Stations of the wanted states from lines in column ``value``; short or unreadable lines are skipped.

    A line counts its line break, so 39 characters of text are enough.
    """
    line = F.col("value")
    fields = lines.where(F.length(line) >= 39).select(
        F.trim(F.substring(line, 1, 11)).alias("station_id"),
        F.trim(F.substring(line, 13, 8)).try_cast("double").alias("lat"),
        F.trim(F.substring(line, 22, 9)).try_cast("double").alias("lon"),
        F.trim(F.substring(line, 39, 2)).alias("state"), F.trim(F.substring(line, 42, 30)).alias("name"))
    return fields.where(
        F.col("station_id").startswith("US") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
        & F.col("state").isin(states))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """County centroid CSV."""
    return clean_centroids(spark.read.option("header", True).csv(path))


def clean_centroids(raw: DataFrame) -> DataFrame:
    """Clean header names (also of a byte-order mark), pad the key parts and join them."""
    named = raw.toDF(*[c.replace("﻿", "").strip().upper() for c in raw.columns])
    state, county = zero_pad(F.trim("STATEFP"), 2), zero_pad(F.trim("COUNTYFP"), 3)
    return named.select(
        composite_key(state, county).alias("fips"), state.alias("state_fips"), county.alias("county_fips"),
        F.trim("LATITUDE").cast("double").alias("lat"), F.trim("LONGITUDE").cast("double").alias("lon"),
        F.trim("COUNAME").alias("county_name"), F.trim("STNAME").alias("state_name"))


def fallback_centroids(spark: SparkSession) -> DataFrame:
    """The small built-in centroid table."""
    base = spark.createDataFrame(config.FALLBACK_CENTROIDS, "fips string, lat double, lon double")
    return split_key(base.withColumns({"county_name": F.lit(""), "state_name": F.lit("")}))


def split_key(df: DataFrame, key: str = "fips") -> DataFrame:
    return df.withColumns({"state_fips": F.substring(key, 1, 2), "county_fips": F.substring(key, 3, 99)})

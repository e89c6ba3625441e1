"""Columnar tables, catalog registration and incremental runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions.columns import without_nan
from harvestlens.operators.joins import not_done
from harvestlens.operators.windows import first_per_key
from harvestlens.session import cut


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, mode: str = "overwrite",
                fmt: str = "parquet", replace_partitions: bool = False) -> None:
    """Write a table (S10). Rows are grouped by partition value first, to keep files few.

    With adaptive execution the grouping splits partition values that hold too many rows.
    ``replace_partitions`` overwrites the partitions that get rows and leaves the others.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode)
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a table (S9); NaN is read as null."""
    return without_nan(spark.read.format(fmt).load(path))


def register(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> None:
    """Make a written table known under a name, its schema created when absent."""
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING {fmt} LOCATION '{path}'")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first candidate table that exists."""
    return next((name for name in candidates if spark.catalog.tableExists(name)), None)


def scan_first(spark: SparkSession, candidates: list[str]) -> DataFrame:
    name = first_existing(spark, candidates)
    if name is None:
        raise LookupError(f"none of these tables exists: {candidates}")
    return without_nan(spark.table(name))


def require_tables(spark: SparkSession, names: list[str]) -> None:
    """Fail with the list of tables that are missing."""
    missing = [name for name in names if not spark.catalog.tableExists(name)]
    if missing:
        raise RuntimeError(f"missing tables: {missing}; run the earlier stages first")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _data_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, time, year) of a table partitioned by year; only the listing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    year = F.regexp_extract("path", "/year=([0-9]+)/[^/]*$", 1)
    return listed.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("time"),
                         year.try_cast("int").alias("year"))


def _manifest_path(path: str) -> str:
    return f"{path}/_manifest/files"  # names with an underscore are no part of a table


def _known_files(spark: SparkSession, path: str) -> DataFrame | None:
    """The files that hold no key twice, as the last run left them."""
    return spark.read.parquet(_manifest_path(path)) if path_exists(spark, _manifest_path(path)) else None


def _years(files: DataFrame) -> list[int]:
    return sorted(r["year"] for r in files.select("year").where("year is not null").distinct().collect())


def extend_by_year(spark: SparkSession, path: str, years: list[int], compute: Callable[[list[int]], DataFrame], *,
                   keys: tuple[str, ...] = ("fips", "year"), fmt: str = "parquet") -> DataFrame:
    """Compute only the years the table lacks, add them, return the table without repeats.

    ``fmt`` is a file format. New years are freed of repeated keys before they are written, and replace their partition,
    so a run that failed half-way can be repeated. A manifest beside the data names the files known to be free of
    repeats; only years with other files (written by somebody else, or touched since) are read and written anew. So a
    table that did not change is neither scanned nor ranked here, and conditions on the year choose its partitions.
    """
    def put(rows: DataFrame, only: list[int]) -> None:
        one = first_per_key(rows.where(F.col("year").isin(only)), list(keys), [F.col(c) for c in rows.columns if c not in keys])
        write_table(one, path, partition_by=["year"], fmt=fmt, replace_partitions=True)

    held: list[int] = []
    doubtful: list[int] = []
    known = None
    if path_exists(spark, path):
        listed, known = _data_files(spark, path), _known_files(spark, path)
        held = _years(listed)
        doubtful = _years(listed if known is None else listed.join(known, ["file", "length", "time"], "left_anti"))
    if doubtful:
        put(cut(read_table(spark, path, fmt).where(F.col("year").isin(doubtful))), doubtful)
    missing = sorted(set(years) - set(held))
    if missing:
        put(compute(missing), missing)
    if doubtful or missing:
        now = _data_files(spark, path)
        fresh = F.col("year").isin(doubtful + missing)
        kept = now.where(fresh) if known is None else now.where(fresh).unionByName(
            now.where(~fresh).join(known.drop("year"), ["file", "length", "time"], "left_semi").select(now.columns))
        write_table(cut(kept), _manifest_path(path))
    return read_table(spark, path, fmt)


def resume_keys(work: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("fips", "year")) -> DataFrame:
    """Keys still to do."""
    return not_done(work, done, list(keys))


def merge_done(done: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("fips", "year"),
               order: list[Column] | None = None) -> DataFrame:
    """Earlier and new rows together; a key that is in both keeps the earlier row."""
    both = done.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, list(keys), [F.col("__age"), *(order or [])]).drop("__age")

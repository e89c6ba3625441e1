"""Year files as they land, folded into the season cache by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harvestlens import config, schemas
from harvestlens.operators import season
from harvestlens.sources import files, tables

YEAR_FILES = "{[0-9][0-9][0-9][0-9].csv,[0-9][0-9][0-9][0-9].csv.gz}"


def follow_year_files(spark: SparkSession, folder: str, mapping: DataFrame, cache: str, checkpoint: str, *,
                      months: list[int] = config.GROWING_MONTHS, min_days: int = config.MIN_COMMON_DAYS,
                      heat_c: float = config.HEAT_C, pattern: str = YEAR_FILES) -> None:
    """Process the files that are new since the last run, then stop. The year is taken from the path.

    A season is complete within its year, so no state crosses batches. A batch says which years have new
    files; these years are read again from all their files and replace what the cache holds of them.
    So a later delivery of a year is not lost, and a batch can be replayed after a failure.
    """
    raw = spark.readStream.schema(schemas.DAILY_CSV).option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True).csv(folder)

    def fold(batch: DataFrame, _: int) -> None:
        touched = [r.year for r in batch.select("year").distinct().where("year is not null").collect()]
        if not touched:
            return
        clean = season.clean_observations(files.read_delivered(spark, folder, touched, pattern), months=months)
        seasons = season.mapped_seasons(clean, mapping, min_days=min_days, heat_c=heat_c)
        tables.write_table(seasons, cache, partition_by=["year"], replace_partitions=True)

    stream = raw.select(files.file_year().alias("year")).writeStream.trigger(availableNow=True).option(
        "checkpointLocation", checkpoint)
    stream.foreachBatch(fold).start().awaitTermination()

"""Session settings and the shared scratch space used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

# Runtime SQL settings the operators are planned for. Adaptive execution turns shuffle joins
# into broadcasts only when the measured side is small, and splits skewed join partitions.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Merge small shuffle partitions only as far as every core still has one.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "harvestlens", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session somebody else built and give its workers the package."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once per context.

    Functions that run on executors are looked up there by module name. The driver serves the
    archive to every executor, also to those that join later, so nothing has to be installed.
    """
    context = spark.sparkContext
    if getattr(context, "_harvestlens_shipped", False) or not PACKAGE.is_dir():
        return spark
    archive = Path(tempfile.mkdtemp(prefix="harvestlens-package-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._harvestlens_shipped = True
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for local tests."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.getCheckpointDir() is not None:
            return context.getCheckpointDir()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="harvestlens-")
        context.setCheckpointDir(configured)
        return context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


_SPACE: ContextVar[str | None] = ContextVar("scratch_space", default=None)  # of this thread


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    base = _SPACE.get() or f"{shared_root(spark).rstrip('/')}/harvestlens"
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_space(spark: SparkSession, keep: bool = False):
    """Scratch tables written inside go when the block ends, unless ``keep`` is set to look at them.

    What the block gives back must not depend on them any more: a stage writes its results first.
    """
    space = scratch_path(spark, "run")
    outer = _SPACE.set(space)
    try:
        yield space
    finally:
        _SPACE.reset(outer)
        if not keep:
            delete_path(spark, space)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def in_scratch_space(stage):
    """A stage of (spark, ...) that removes its scratch tables; ``keep_scratch=True`` keeps them."""
    @wraps(stage)
    def run(spark: SparkSession, *args, keep_scratch: bool = False, **options):
        with scratch_space(spark, keep_scratch):
            return stage(spark, *args, **options)

    return run


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    The files survive the loss of executors and are the same for every later reader, also when
    ``df`` itself is not deterministic. They are columnar, so later reads prune columns, push
    filters down and know their size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

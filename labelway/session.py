"""Session set-up and intermediate tables in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 << 20
SMALL_BYTES = 1 << 30

_local_dirs: dict[str, str] = {}


def build_session(master: str = "local[*]", app_name: str = "labelway", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the last of repeated JSON fields counts
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="labelway-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(
        shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    )
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        path = tempfile.mkdtemp(prefix="labelway-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_dirs[sc.applicationId] = path
    return _local_dirs[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a re-run
    of everything before, and gives the planner the table's true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of the scratch folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def planned_bytes(df: DataFrame) -> int:
    """Size the optimizer expects for ``df``; exact for a staged table."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spreads a small input with few splits over all cores.

    One file or one row group is one task. Only inputs below one scan split per
    core and below ``SMALL_BYTES`` are moved, so a large table never is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if planned_bytes(df) < min(cores * SPLIT_BYTES, SMALL_BYTES):
        return df.repartition(cores, key)
    return df


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, for when its
    results are saved. DataFrames that read them can no longer run."""
    drop_table(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")

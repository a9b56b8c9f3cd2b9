"""Session settings the operators rely on, and the reliable-checkpoint policy."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for skewed groups: AQE splits a hot join partition even when that
# costs another exchange, and coalesces the small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch for Python is bounded by its bytes, not by ten thousand rows of any length.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "postingflow") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        # Column building records a call site per expression otherwise, which dominates large plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("POSTINGFLOW_DRIVER_MEMORY", "8g"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_settings(spark)


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="postingflow-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach; a temporary one only on a local master without a setting."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """DataFrames that are made and run inside lose their shuffle files as soon as they have run.

    Spark's cleaner otherwise waits until the driver collects its garbage, so that the files of all steps of a query pile up. For steps
    whose rows are kept elsewhere.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def broadcasts_measured(spark: SparkSession):
    """Joins that run inside broadcast a side only once it has been shuffled and its rows are known to be few.

    Before that Spark goes by file sizes: a compressed table, and what is exploded from it, may be a hundred times as large in the
    driver's memory. For steps over stored tables; explicit broadcasts stay.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, limit = spark.conf.get(planned), spark.conf.get(measured, None)
    spark.conf.set(planned, "-1")
    spark.conf.set(measured, limit or before)
    try:
        yield
    finally:
        spark.conf.set(planned, before)
        spark.conf.set(measured, limit) if limit else spark.conf.unset(measured)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder; for wide or many rows, which a checkpoint would hold as they are."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps iterative plans short."""
    _ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, whose shuffles nobody else reads

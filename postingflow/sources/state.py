"""Versioned Parquet tables: a base snapshot plus small deltas, found through a manifest.

A run writes only the rows it touched. The manifest line is written last, so readers see a whole version
or none, and a batch already in the manifest is not written again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postingflow.schema import STATE_SCHEMA

_MANIFEST = "version long, kind string, query_id string, batch_id long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], _MANIFEST)


def has_batch(spark: SparkSession, path: str, query_id: str, batch_id: int) -> bool:
    """Whether this batch of this query is already in the table."""
    done = _manifest(spark, path).filter((F.col("query_id") == query_id) & (F.col("batch_id") == batch_id))
    return not done.isEmpty()


def _bounds(spark: SparkSession, path: str) -> tuple[int, int]:
    """(last base version, last version); zeros when there is none."""
    row = _manifest(spark, path).agg(
        F.coalesce(F.max(F.when(F.col("kind") == "base", F.col("version"))), F.lit(0)).alias("base"),
        F.coalesce(F.max("version"), F.lit(0)).alias("last")).first()
    return row.base, row.last


def _write(df: DataFrame, path: str, kind: str, query_id: str, batch_id: int, partition_by: list[str] | None) -> int:
    spark = df.sparkSession
    version = _bounds(spark, path)[1] + 1
    # A torn attempt leaves files without a manifest line; overwriting them is safe.
    writer = df.withColumn("_version", F.lit(version)).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{kind}/v{version}")
    line = spark.createDataFrame([(version, kind, query_id, batch_id)], _MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def read_versioned(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """Latest row per key over the base and the deltas after it."""
    base, last = _bounds(spark, path)
    names = [f.name for f in schema.fields]
    stored = StructType([*schema.fields, StructField("_version", LongType())])
    frame = spark.read.schema(stored).parquet(f"{path}/base/v{base}") if base else spark.createDataFrame([], stored)
    versions = [r.version for r in _manifest(spark, path).filter(
        (F.col("kind") == "delta") & (F.col("version") > base)).select("version").collect()]
    if not versions:
        return frame.select(*names)
    deltas = spark.read.schema(stored).parquet(*[f"{path}/delta/v{v}" for v in versions])
    newest = deltas.groupBy(key).agg(F.max("_version").alias("_version"))
    fresh = deltas.join(newest, [key, "_version"])
    return frame.join(newest.select(key), key, "left_anti").select(*names).unionByName(fresh.select(*names))


def write_state(df: DataFrame, path: str, query_id: str = "batch", batch_id: int = 0, full: bool = False) -> int:
    """Add touched postings as a delta, or the whole state as a new base; returns the version."""
    return _write(df, path, "base" if full else "delta", query_id, batch_id, None)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The current state table."""
    return read_versioned(spark, path, STATE_SCHEMA)


def compact(spark: SparkSession, path: str, schema: StructType = STATE_SCHEMA) -> int:
    """Fold base and deltas into a new base, so reads stay cheap."""
    return _write(read_versioned(spark, path, schema), path, "base", "compact", _bounds(spark, path)[1], None)


def write_index(docs: DataFrame, path: str, query_id: str = "batch", batch_id: int = 0, full: bool = False) -> int:
    """Upsert search documents by id, laid out by status."""
    return _write(docs, path, "base" if full else "delta", query_id, batch_id, ["status"])


def append_run(runs: DataFrame, path: str, query_id: str = "batch", batch_id: int = 0) -> None:
    """Put the rows of one batch of one query into a log.

    They are a partition of their own, which a repeated batch replaces: a failure between this write and the batch's commit, and the replay
    after it, leave every row once. The other batches are not touched. A batch without rows adds no partition.
    """
    rows = runs.withColumns({"log_query": F.lit(query_id), "log_batch": F.lit(batch_id).cast("long")})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_query", "log_batch").parquet(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A log's rows with log_query and log_batch; an empty table if no batch has had any."""
    whole = StructType([*schema.fields, StructField("log_query", StringType()), StructField("log_batch", LongType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], whole)


def upsert_sources(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources after a run: first sight of a (name, type) adds an enabled row."""
    seen = runs.select(F.col("source_name").alias("name"), F.col("source_type").alias("type")).distinct()
    new = seen.join(sources, ["name", "type"], "left_anti").select(
        F.sha2(F.concat_ws("|", "type", "name"), 256).alias("id"), "name", "type",
        F.lit(None).cast("string").alias("base_url"), F.lit(True).alias("enabled"))
    return sources.select("id", "name", "type", "base_url", "enabled").unionByName(new)

"""Readers of captured pages, sample files, bulk requests and the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postingflow.functions.text import fold_letters, folded_contains, is_blank, let, parse_date
from postingflow.schema import BULK_REQUEST_SCHEMA, RAW_SCHEMA

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("status", T.IntegerType()),
])
SAMPLE_SCHEMA = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("source", "jobId", "title", "company", "location", "url", "description", "postedAt")
])
# Words of a challenge page, and names of sources whose pages need a browser.
CHALLENGE_WORDS = ["verify you are human", "cloudflare", "turnstile", "captcha"]
JS_SOURCES = ["thoughtworks", "redhat", "red hat", "accenture", "totvs"]


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample files `sample_source_*.json` of one folder as raw postings, with their file name and text."""
    files = (
        spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True)
        .option("pathGlobFilter", "[sS][aA][mM][pP][lL][eE]_[sS][oO][uU][rR][cC][eE]_*.json").json(path)
        .select("*", F.col("_metadata.file_name").alias("file_name"))
    )
    values = {
        "source_name": F.coalesce("source", F.lit("Unknown")), "family": F.lit("sample"),
        "ord": F.lit(0), "title": F.coalesce("title", F.lit("Untitled")), "url": F.coalesce("url", F.lit("")),
        "company": F.coalesce("company", F.lit("Unknown")), "location_text": F.coalesce("location", F.lit("")),
        "source_job_id": F.col("jobId"), "description": F.coalesce("description", F.lit("")),
        "posted_at": parse_date(F.col("postedAt")),
    }
    raw = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields]
    return files.select(*raw, "file_name", F.to_json(F.struct(*SAMPLE_SCHEMA.names)).alias("raw_json"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages stored as Parquet."""
    return widen(spark.read.schema(PAGES_SCHEMA).parquet(path))


def widen(df: DataFrame) -> DataFrame:
    """Spread a stored frame whose rows are in fewer partitions than there are cores; others pass unshuffled.

    Text work is heavy per row, and a few large row groups would leave most cores idle. A file is cut by its bytes, but a row group is
    read by one task: parts in which none begins are empty, so that those with rows are counted; no column is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wide = df.rdd.getNumPartitions() >= cores and df.select(F.spark_partition_id().alias("_p")).distinct().count() >= cores
    return df if wide else df.repartition(cores)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Captured pages as a file stream."""
    return spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def page_verdict(pages: DataFrame) -> DataFrame:
    """Add `verdict`: ok, blocked (refused or challenged) or failed (no payload)."""
    status = F.coalesce("status", F.lit(200))
    challenged = let(fold_letters(F.col("html")), lambda body: F.greatest(*[folded_contains(body, w) for w in CHALLENGE_WORDS]))
    workday = F.lower(F.coalesce("source_name", F.lit(""))).contains("workday")
    refused = status.isin(403, 429) | (workday & (status == 401))
    verdict = (
        F.when(refused | (~workday & challenged), "blocked")
        .when(~status.between(200, 299) | is_blank(F.col("html")), "failed").otherwise("ok")
    )
    # A filter on it would else be moved below the shuffle that spreads the pages, and fold whole pages where they are read.
    return pages.withColumn("verdict", F.when(F.spark_partition_id() >= 0, verdict))


def drop_blocked(pages: DataFrame) -> DataFrame:
    """Pages that were served normally."""
    return page_verdict(pages).filter(F.col("verdict") == "ok").drop("verdict")


def blocked_counts(pages: DataFrame) -> DataFrame:
    """Pages per source and verdict."""
    return page_verdict(pages).groupBy("source_name", "verdict").agg(F.count(F.lit(1)).alias("n_pages"))


def read_bulk(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Bulk requests: one JSON object per file (the file is the batch), or one per line with a batchId."""
    schema = T.StructType([T.StructField("batchId", T.StringType()), *BULK_REQUEST_SCHEMA.fields])
    requests = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    arrived = F.col("_metadata.file_modification_time")
    return requests.select(
        F.coalesce("batchId", F.col("_metadata.file_path")).alias("batch_id"), arrived.alias("arrived_at"),
        F.col("sourceName").alias("source_name"),
        F.coalesce("sourceType", F.lit("ExternalIngestion")).alias("source_type"), "items",
    )


def guard_batch(requests: DataFrame, max_items: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): empty batches and batches over the limit are refused whole, with a message."""
    n = F.coalesce(F.size("items"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    over = F.lit(False) if max_items is None else n > max_items
    message = F.when(n == 0, F.lit("items must contain at least 1 item.")).when(over, F.format_string(
        f"Batch size exceeds maximum allowed ({max_items}). Received %d items.", n))
    judged = requests.withColumn("message", message)
    rejected = judged.filter(F.col("message").isNotNull()).select("batch_id", n.alias("received"), "message")
    return judged.filter(F.col("message").isNull()).drop("message"), rejected


def bulk_items(requests: DataFrame) -> DataFrame:
    """One row per item; an item's own source name or type, even blank, overrides the request's."""
    rows = requests.select("batch_id", "arrived_at", "source_name", "source_type", F.posexplode("items").alias("item_index", "item"))
    item = F.col("item")
    names = {
        "source_job_id": "sourceJobId", "source_url": "sourceUrl", "origin_url": "originUrl", "title": "title",
        "location_text": "locationText", "work_mode": "workMode", "seniority": "seniority",
        "employment_type": "employmentType", "description_text": "descriptionText", "tags": "tags",
        "languages": "languages", "posted_at": "postedAt", "metadata": "metadata",
    }
    return rows.select(
        "batch_id", "arrived_at", "item_index",
        F.coalesce(item["sourceName"], F.col("source_name")).alias("source_name"),
        F.coalesce(item["sourceType"], F.col("source_type")).alias("source_type"),
        item["company"]["name"].alias("company_name"), item["company"]["website"].alias("company_website"),
        item["company"]["industry"].alias("company_industry"),
        *[item[theirs].alias(ours) for ours, theirs in names.items()],
    )


def source_registry(registry: DataFrame, only: str | None = None) -> DataFrame:
    """Enabled sources with a name; optionally just one of them, whatever its case."""
    usable = registry.filter(F.coalesce("enabled", F.lit(True)) & ~is_blank(F.col("source_name")))
    if only is None or not only.strip():
        return usable
    return usable.filter(F.lower("source_name") == only.strip().lower())


def skip_js_sources(registry: DataFrame) -> DataFrame:
    """Sources whose pages can be read without a browser."""
    name, url = F.lower(F.col("source_name")), F.lower(F.coalesce("start_url", F.lit("")))
    by_name = F.greatest(*[name.contains(w) for w in JS_SOURCES]) & (F.col("source_type") == "CorporateCareers")
    needs = F.coalesce("requires_js", by_name | url.contains("totvs.app"))
    return registry.filter(~needs)


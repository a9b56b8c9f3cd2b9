"""Incremental crawl and bulk ingest: file streams run through the same plans, one micro-batch at a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postingflow.functions.text import is_blank
from postingflow.operators.posting import to_search_doc
from postingflow.plans.bulk import run_bulk
from postingflow.plans.crawl import run_crawl
from postingflow.schema import BULK_REQUEST_SCHEMA
from postingflow.session import cut_lineage
from postingflow.sources.scans import stream_pages
from postingflow.sources.state import append_run, has_batch, read_state, write_index, write_state


def _store(postings: DataFrame, table: str, query_id: str, batch_id: int) -> None:
    touched = cut_lineage(postings)
    write_index(to_search_doc(touched), f"{table}/index", query_id, batch_id)
    # The state line is the commit of the batch, so it comes last.
    write_state(touched, f"{table}/state", query_id, batch_id)


def _run_at(run_at: datetime | None):
    return F.current_timestamp() if run_at is None else F.lit(run_at)


def _start(stream: DataFrame, handle, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 hour")).start()


def start_crawl(spark: SparkSession, pages_path: str, registry: DataFrame, table: str, checkpoint: str,
                once: bool = True, query_id: str = "crawl", run_at: datetime | None = None, **options) -> StreamingQuery:
    """Ingest new page files. `once` makes one pass over what is there; else a pass every hour.

    A batch that is already in the state table is skipped, so a restart repeats nothing.
    """
    def handle(pages: DataFrame, batch_id: int) -> None:
        session = pages.sparkSession
        if has_batch(session, f"{table}/state", query_id, batch_id):
            return
        state = read_state(session, f"{table}/state")
        result = run_crawl(pages, registry, state, _run_at(run_at), run_id=f"{query_id}:{batch_id}", **options)
        append_run(result.runs, f"{table}/runs", query_id, batch_id)
        _store(result.postings, table, query_id, batch_id)

    return _start(stream_pages(spark, pages_path), handle, checkpoint, once)


def start_bulk(spark: SparkSession, requests_path: str, table: str, checkpoint: str, once: bool = True,
               query_id: str = "bulk", run_at: datetime | None = None, **options) -> StreamingQuery:
    """Ingest new bulk request files (one JSON request each); file arrival and item order give the sequence."""
    stream = spark.readStream.schema(BULK_REQUEST_SCHEMA).option("multiLine", True).json(requests_path).select(
        F.col("_metadata.file_path").alias("batch_id"), F.col("_metadata.file_modification_time").alias("arrived_at"),
        F.col("sourceName").alias("source_name"), F.coalesce("sourceType", F.lit("ExternalIngestion")).alias("source_type"), "items")

    def handle(requests: DataFrame, batch_id: int) -> None:
        session = requests.sparkSession
        if has_batch(session, f"{table}/state", query_id, batch_id):
            return
        state = read_state(session, f"{table}/state")
        result = run_bulk(requests, state, _run_at(run_at), run_id=f"{query_id}:{batch_id}", **options)
        append_run(result.summary, f"{table}/summaries", query_id, batch_id)
        append_run(result.errors, f"{table}/errors", query_id, batch_id)
        _store(result.postings, table, query_id, batch_id)

    return _start(stream, handle, checkpoint, once)


def drop_replays(items: DataFrame, time_column: str = "arrived_at", within: str = "1 hour") -> DataFrame:
    """Drop items whose origin URL was seen within the watermark; matching stays authoritative after it.

    Items without an origin URL, null or blank, have nothing to compare and all pass.
    """
    timed = items.withWatermark(time_column, within)
    without = is_blank(F.col("origin_url"))
    return timed.filter(~without).dropDuplicatesWithinWatermark(["origin_url"]).unionByName(timed.filter(without))

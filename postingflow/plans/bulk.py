"""One bulk pass: external batch requests to touched postings, per-batch summaries and item errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.operators.lifecycle import batch_errors, batch_summary
from postingflow.operators.merge import bulk_records, merge_records
from postingflow.operators.quality import item_error
from postingflow.operators.scan import number_rows
from postingflow.sources.scans import bulk_items, guard_batch


@dataclass
class BulkResult:
    postings: DataFrame
    summary: DataFrame
    errors: DataFrame
    rejected: DataFrame


def run_bulk(requests: DataFrame, state: DataFrame, now: Column, max_items: int | None = 100, run_id: str = "bulk",
             compat: bool = False) -> BulkResult:
    """Guard, validate, match and merge a set of requests in arrival order."""
    accepted, rejected = guard_batch(requests, max_items)
    items = number_rows(bulk_items(accepted), ["arrived_at", "batch_id", "item_index"])
    judged = items.withColumn("message", item_error(*[F.col(c) for c in ("title", "company_name", "source_url", "origin_url")]))
    judged = judged.withColumn("new_id", F.left(F.sha2(F.concat_ws("|", F.lit(run_id), "seq"), 256), F.lit(32)))
    records = bulk_records(judged.filter(F.col("message").isNull()), now, compat)
    postings, outcomes = merge_records(records, state, "bulk")
    labelled = judged.select("seq", "batch_id", "item_index", "source_job_id", "message").join(
        outcomes.select("seq", "outcome"), "seq", "left")
    clash = F.when(F.col("outcome") == "Conflict", "another posting holds this URL or source id")
    labelled = labelled.withColumns({"message": F.coalesce("message", clash), "outcome": F.coalesce("outcome", F.lit("Invalid"))})
    return BulkResult(postings, batch_summary(labelled), batch_errors(labelled), rejected)

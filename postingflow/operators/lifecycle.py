"""Batch summaries, run counters, expiry and per-source metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.operators.scan import option_join


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per batch from item outcomes (Inserted, Updated, Duplicate; anything else is invalid)."""
    def n(label: str) -> Column:
        return F.count(F.when(F.col("outcome") == label, 1))

    done = n("Inserted") + n("Updated") + n("Duplicate")
    return outcomes.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("received"), done.alias("processed"), n("Inserted").alias("inserted"),
        n("Updated").alias("updated"), n("Duplicate").alias("duplicates"), (F.count(F.lit(1)) - done).alias("invalid"))


def batch_errors(outcomes: DataFrame) -> DataFrame:
    """One row per item that was not processed."""
    return outcomes.filter(F.col("message").isNotNull()).select("batch_id", "item_index", "source_job_id", "message")


def run_counters(outcomes: DataFrame, run_at: Column, visited: DataFrame | None = None) -> DataFrame:
    """One run row per source from its outcomes; any error marks that source's run, and only that, as failed.

    Outcomes of items are Inserted, Updated, Duplicate and Conflict; Rejected (by the gate), Blocked (pages) and Malformed
    (blocks) are counted beside them, and Error is anything else that went wrong. Each source in `visited` (source_name,
    source_type) has a row, also one that gave nothing.
    """
    def n(*labels: str) -> Column:
        return F.count(F.when(F.col("outcome").isin(*labels), 1))

    columns = ["source_name", "source_type", "outcome", "message"]
    rows = outcomes.select(*columns)
    if visited is not None:
        rows = rows.unionByName(visited.select("source_name", "source_type", *[F.lit(None).cast("string").alias(c) for c in columns[2:]]).distinct())
    fetched = F.count(F.when(~F.col("outcome").isin("Error", "Rejected", "Blocked", "Malformed"), 1))
    errors = n("Conflict", "Error", "Malformed")
    return rows.groupBy("source_name", "source_type").agg(
        fetched.alias("fetched"), fetched.alias("parsed"), fetched.alias("normalized"),
        n("Inserted", "Updated").alias("indexed"), n("Inserted").alias("inserted"), n("Updated").alias("updated"),
        n("Duplicate").alias("duplicates"), n("Rejected").alias("rejected"), n("Blocked").alias("blocked"), n("Malformed").alias("malformed"),
        errors.alias("errors"), F.min("message").alias("error_sample"),
        F.when(errors > 0, "Failed").otherwise("Success").alias("status"),
    ).withColumns({"started_at": run_at, "finished_at": F.current_timestamp()})


def expire(state: DataFrame, sources: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Mark postings of the given (name, type) sources as expired when not seen for `days` (at least one).

    Adds `expired_now` for the rows this run changed.
    """
    ran = sources.select("source_name", "source_type").distinct().withColumn("_ran", F.lit(True))
    cutoff = now - F.make_interval(days=F.lit(max(days, 1)))
    joined = option_join(state, ran, ["source_name", "source_type"], "left").select(*state.columns, "_ran")
    stale = F.coalesce("_ran", F.lit(False)) & (F.col("status") != "Expired") & (F.col("last_seen_at") < cutoff)
    marked = joined.withColumn("expired_now", F.coalesce(stale, F.lit(False))).drop("_ran")
    return marked.withColumn("status", F.when(F.col("expired_now"), "Expired").otherwise(F.col("status")))


def expired_counts(marked: DataFrame) -> DataFrame:
    """How many postings of each source the last `expire` changed."""
    return marked.filter("expired_now").groupBy("source_name", "source_type").agg(F.count(F.lit(1)).alias("expired"))


def runs_with_source(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Run log with its source row."""
    return runs.join(sources.select(
        F.col("name").alias("source_name"), F.col("type").alias("source_type"), F.col("id").alias("source_id"),
        "base_url", "enabled"), ["source_name", "source_type"])


def orphan_runs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs whose source is not registered."""
    known = sources.select(F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    return runs.join(known, ["source_name", "source_type"], "left_anti")


def source_metrics(runs: DataFrame, state: DataFrame) -> DataFrame:
    """Per source: runs, success rate, last run and postings by status."""
    ran = runs.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.count(F.when(F.col("status") == "Success", 1)) / F.count(F.lit(1)), 6).alias("success_rate"),
        F.max("started_at").alias("last_run"))
    held = state.groupBy("source_name").agg(
        F.count(F.when(F.col("status") == "Active", 1)).alias("active"),
        F.count(F.when(F.col("status") == "Expired", 1)).alias("expired"))
    return ran.join(held, "source_name", "full").select(
        "source_name", F.coalesce("runs", F.lit(0)).alias("runs"), "success_rate", "last_run",
        F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("expired", F.lit(0)).alias("expired"))

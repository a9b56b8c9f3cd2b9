"""Matching of postings to stored ones and duplicate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import null_if_blank
from postingflow.operators.scan import spread_join


def digest(*cols: Column) -> Column:
    """16-byte key of one or more values; null when any of them is null."""
    ready = cols[0].isNotNull()
    for c in cols[1:]:
        ready = ready & c.isNotNull()
    text = F.concat_ws("\u0001", *cols)
    return F.when(ready, F.substring(F.unhex(F.sha2(text, 256)), 1, 16))


def match_keys(policy: str) -> list[tuple[int, Column]]:
    """(rank, key) pairs of a policy over normalised column names, in order of priority."""
    job = null_if_blank(F.col("source_job_id"))
    triple = digest(F.col("source_type"), F.col("source_name"), job)
    url = digest(null_if_blank(F.col("source_url")))
    if policy == "crawl":
        return [(1, triple), (2, url)]
    return [(1, digest(null_if_blank(F.col("origin_url")))), (2, triple), (3, url), (4, digest(F.col("fingerprint")))]


def _exploded(df: DataFrame, policy: str, keep: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(r).alias("rank"), k.alias("key")) for r, k in match_keys(policy)])
    return (
        df.select(*keep, F.explode(pairs).alias("_p"))
        .select(*keep, F.col("_p.rank").alias("rank"), F.col("_p.key").alias("key"))
        .filter(F.col("key").isNotNull())
    )


def _match(incoming: DataFrame, state: DataFrame, policy: str) -> DataFrame:
    stored = _exploded(state, policy, ["id", "captured_at"])
    holders = stored.groupBy("rank", "key").agg(F.min_by("id", F.struct("captured_at", "id")).alias("match_id"))
    hits = spread_join(_exploded(incoming, policy, ["seq"]), holders, ["rank", "key"])
    best = hits.groupBy("seq").agg(F.min(F.struct("rank", "match_id")).alias("_m"))
    return incoming.join(best, "seq", "left").select(
        *incoming.columns, F.col("_m.match_id").alias("match_id"), F.col("_m.rank").alias("match_rank"))


def match_crawl(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Stored posting of each crawled one: by source id, else by URL. Ties go to the earliest captured."""
    return _match(incoming, state, "crawl")


def match_bulk(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Stored posting of each external item: origin URL, source id, source URL, then fingerprint."""
    return _match(incoming, state, "bulk")


def duplicate_groups(postings: DataFrame) -> DataFrame:
    """Fingerprints seen more than once, with how many postings and the sources that carry them."""
    by_source = postings.groupBy("fingerprint", "source_name").agg(F.count(F.lit(1)).alias("n"))
    return (
        by_source.groupBy("fingerprint")
        .agg(F.sum("n").alias("n_postings"), F.count(F.lit(1)).alias("n_sources"),
             F.array_join(F.array_sort(F.collect_list("source_name")), ",").alias("sources"))
        .filter(F.col("n_postings") > 1)
    )

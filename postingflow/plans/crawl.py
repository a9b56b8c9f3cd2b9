"""One crawl pass: captured pages to touched postings, outcomes and run rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import normalize_tags
from postingflow.operators import extract as ex
from postingflow.operators.lifecycle import expire, run_counters
from postingflow.operators.merge import merge_records
from postingflow.operators.posting import to_entity, to_posting, with_run_ts
from postingflow.operators.quality import quality_gate, unkeyed
from postingflow.operators.scan import number_rows, option_join
from postingflow.schema import RAW_SCHEMA, STATE_COLUMNS
from postingflow.session import cut_lineage
from postingflow.sources.scans import drop_blocked, page_verdict, skip_js_sources, source_registry

Extractor = Callable[[DataFrame, DataFrame], DataFrame]

# Page families and how their pages become raw postings: (pages, registry) -> raw postings.
FAMILIES: dict[str, Extractor] = {
    "listing": lambda pages, registry: ex.extract_listing(pages),
    "jsonld": lambda pages, registry: ex.extract_jsonld(pages),
    "anchor_tail": lambda pages, registry: ex.extract_anchor_tail(pages),
    "gupy": ex.extract_gupy,
    "workday": ex.extract_workday,
}


# Families whose pages embed JSON that must be readable.
EMBEDDED = {"listing": "state", "jsonld": "jsonld"}


def register_family(name: str, extractor: Extractor) -> None:
    """Add or replace a page family."""
    FAMILIES[name] = extractor


def extract_all(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw postings of all families; each page goes to the extractor of its source's family."""
    # The registry is configuration: at most one row per family comes back.
    used = {r.family for r in registry.select("family").distinct().collect()}
    out = pages.sparkSession.createDataFrame([], RAW_SCHEMA)
    for family in used & set(FAMILIES):
        mine = registry.filter(F.col("family") == family)
        out = out.unionByName(FAMILIES[family](option_join(pages, mine.select("source_name"), ["source_name"], "left_semi"), mine))
    return out


def page_troubles(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """source_name, source_type, outcome and message of pages that gave nothing: Blocked ones, and blocks of the others that are Malformed."""
    named = registry.select("source_name", "source_type", "family")
    judged = option_join(page_verdict(pages), named, ["source_name"])
    blocked = judged.filter(F.col("verdict") == "blocked").select("source_name", "source_type", F.lit("Blocked").alias("outcome"), F.lit(None).cast("string").alias("message"))
    out = blocked
    for family, kind in EMBEDDED.items():
        read = judged.filter((F.col("verdict") == "ok") & (F.col("family") == family))
        bad = ex.malformed_blocks(read, kind).select("source_name", F.col("error").alias("message"))
        out = out.unionByName(option_join(bad, named.filter(F.col("family") == family), ["source_name"]).select(
            "source_name", "source_type", F.lit("Malformed").alias("outcome"), "message"))
    return out


@dataclass
class CrawlResult:
    postings: DataFrame
    outcomes: DataFrame
    runs: DataFrame
    rejected: DataFrame
    set_aside: DataFrame


def run_crawl(
    pages: DataFrame, registry: DataFrame, state: DataFrame, run_at: Column, details: DataFrame | None = None,
    samples: DataFrame | None = None, run_id: str = "run", max_items: int | None = 20, max_detail: int | None = 20,
    expire_days: int = 14, tag_mode: str = "token",
) -> CrawlResult:
    """Extract, gate, match and merge one pass over captured pages; expire what its sources no longer show.

    `postings` holds every stored row the pass touched, ready to be written as a delta. A source's own cap (else the run's) cuts
    what is parsed, the gate comes next, then the run's cap on what passed it, so rejected items use neither that nor the
    detail budget; None switches a cap off. `runs` has a row for each enabled source, also one that was skipped or gave nothing.
    """
    enabled = source_registry(registry)
    usable = skip_js_sources(enabled)
    # Raw postings are small next to the pages and are read several times below.
    raw = cut_lineage(ex.cap_items(extract_all(drop_blocked(pages), usable), usable, max_items))
    accepted, rejected = quality_gate(raw)
    if max_items is not None:
        accepted = ex.first_items(accepted, F.lit(max(max_items, 1)))
    if details is not None:
        accepted = cut_lineage(ex.enrich_details(accepted, drop_blocked(details), usable, max_detail))
    texts = {"file_name": F.lit(None).cast("string"), "raw_json": F.lit(None).cast("string")}
    accepted, rejected = accepted.withColumns(texts), rejected.withColumns(texts)
    if samples is not None:
        more, refused = quality_gate(samples.select(*[f.name for f in RAW_SCHEMA.fields], "file_name", "raw_json"))
        accepted, rejected = accepted.unionByName(more), rejected.unionByName(refused)
    nested = with_run_ts(to_posting(accepted, usable, tag_mode), run_at)
    # Numbering reads its input twice, for the ranges and for the rows; what is inferred from whole texts is stored before.
    flat = cut_lineage(to_entity(nested, F.lit(""), ["page_id", "ord"]).withColumn("tags", normalize_tags(F.col("tags"))))
    keyed, set_aside = unkeyed(flat)
    order = ["source_type", "source_name", "page_id", "ord", "source_url", "fingerprint"]
    numbered = number_rows(keyed, order)
    numbered = numbered.withColumn("id", F.left(F.sha2(F.concat_ws("|", F.lit(run_id), "seq"), 256), F.lit(32)))
    postings, outcomes = merge_records(numbered.drop("page_id", "ord"), state, "crawl")
    postings = cut_lineage(postings)
    labelled = outcomes.join(numbered.select("seq", "source_name", "source_type"), "seq").withColumn(
        "message", F.when(F.col("outcome") == "Conflict", "another posting holds this URL or source id"))
    types = usable.select("source_name", "source_type")
    refused = option_join(rejected.select("source_name"), types, ["source_name"], "left").select(
        "source_name", "source_type", F.lit("Rejected").alias("outcome"), F.lit(None).cast("string").alias("message"))
    columns = ["source_name", "source_type", "outcome", "message"]
    events = labelled.select(*columns).unionByName(refused).unionByName(page_troubles(pages, usable))
    runs = run_counters(events, run_at, enabled)
    seen = usable.select("source_name", "source_type").unionByName(labelled.select("source_name", "source_type")).distinct()
    rest = state.join(postings.select("id"), "id", "left_anti")
    gone = expire(rest, seen, run_at, expire_days).filter("expired_now").select(*STATE_COLUMNS)
    return CrawlResult(postings.select(*STATE_COLUMNS).unionByName(gone), labelled, runs, rejected, set_aside)

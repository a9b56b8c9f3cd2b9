"""Gates and rules on raw postings, bulk items and stored postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import is_blank, normalize_text, trim_space

MIN_TITLE = 6
SHORT_TEXT = 200
# Titles that say nothing by themselves, and stored length limits.
GENERIC_TITLES = ["vaga", "vagas", "oportunidade", "oportunidades"]
LENGTH_CAPS = {
    "source_name": 120, "source_url": 1024, "source_job_id": 255, "origin_url": 1024, "title": 400,
    "company_name": 240, "company_website": 1024, "company_industry": 120, "location_text": 240, "country": 8,
    "state": 80, "city": 120, "salary_currency": 10, "salary_period": 32, "fingerprint": 80, "cluster_id": 80,
}


def gate_reason(title: Column, company: Column, location: Column) -> Column:
    """Why a listing posting is refused; null when it is accepted."""
    return (
        F.when(F.length(trim_space(F.coalesce(title, F.lit("")))) < MIN_TITLE, "short title")
        .when(F.lower(trim_space(company)) == "unknown", "unknown company")
        .when(is_blank(location), "blank location")
    )


def quality_gate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reject_reason) of listing postings; other families pass."""
    family = F.col("family") if "family" in raw.columns else F.lit("listing")
    judged = raw.withColumn("reject_reason", F.when(
        family == "listing", gate_reason(F.col("title"), F.col("company"), F.col("location_text"))))
    ok = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return ok, judged.filter(F.col("reject_reason").isNotNull())


def item_error(title: Column, company: Column, source_url: Column, origin_url: Column) -> Column:
    """First failing rule of a bulk item; null when valid."""
    return (
        F.when(is_blank(title), "title is required")
        .when(is_blank(company), "company.name is required")
        .when(is_blank(source_url) & is_blank(origin_url), "sourceUrl or originUrl is required")
    )


def validate_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid items, one error row per invalid item); an invalid item never stops its batch."""
    judged = items.withColumn("message", item_error(*[F.col(c) for c in ("title", "company_name", "source_url", "origin_url")]))
    errors = judged.filter(F.col("message").isNotNull()).select("batch_id", "item_index", "source_job_id", "message")
    return judged.filter(F.col("message").isNull()).drop("message"), errors


def unkeyed(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, set aside): a crawled posting needs a URL or a source id to be recognised again."""
    bad = is_blank(F.col("source_url")) & is_blank(F.col("source_job_id"))
    return entities.filter(~bad), entities.filter(bad)


def spam_flags(state: DataFrame) -> DataFrame:
    """Add generic_title and short_text."""
    return state.withColumns({
        "generic_title": normalize_text(F.col("title")).isin(*GENERIC_TITLES),
        "short_text": F.length(F.coalesce("description_text", F.lit(""))) < SHORT_TEXT,
    })


def length_violations(state: DataFrame) -> DataFrame:
    """Fields over their stored length: id, field, length, cap."""
    found = F.array(*[
        F.when(F.length(c) > cap, F.struct(F.lit(c).alias("field"), F.length(c).alias("length"), F.lit(cap).alias("cap")))
        for c, cap in LENGTH_CAPS.items() if c in state.columns
    ])
    over = state.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_v"))
    return over.select("id", "_v.field", "_v.length", "_v.cap")

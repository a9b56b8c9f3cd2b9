"""Ranking score, daily digest and posting cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import is_blank
from postingflow.operators.quality import spam_flags
from postingflow.operators.scan import first_n

# The described score names its parts but no weights; these are ours.
WEIGHTS = {"recency": 0.5, "description": 0.1, "tags": 0.1, "work_mode": 0.1, "match": 0.2, "short": 0.3, "generic": 0.3}
HALF_LIFE_DAYS = 14.0


def rank_score(state: DataFrame, now: Column, match: Column | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Add `score`: recency and completeness, plus filter match, minus spam signs."""
    seen = F.coalesce("posted_at", "captured_at")
    age = F.greatest(F.unix_micros(now) - F.unix_micros(seen), F.lit(0)) / F.lit(86400e6)
    flagged = spam_flags(state)

    def bit(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    parts = {
        "recency": F.exp(-age / F.lit(HALF_LIFE_DAYS)), "description": bit(~is_blank(F.col("description_text"))),
        "tags": bit(F.size("tags") > 0), "work_mode": bit(F.col("work_mode") != "Unknown"),
        "match": bit(match) if match is not None else F.lit(0.0),
        "short": -bit(F.col("short_text")), "generic": -bit(F.col("generic_title")),
    }
    total = sum((F.lit(weights[n]) * c for n, c in list(parts.items())[1:]), F.lit(weights["recency"]) * parts["recency"])
    return flagged.withColumn("score", F.round(total, 6))


def digest(scored: DataFrame, n: int = 10) -> DataFrame:
    """Best postings of each posting day as numbered lines: day, rank, id, line."""
    dated = scored.withColumn("day", F.to_date(F.coalesce("posted_at", "captured_at")))
    top = first_n(dated.select("day", "id", "title", "company_name", "work_mode", "source_url", "score"),
                  ["day"], [F.col("score").desc(), F.col("id")], n)
    line = F.format_string("%d) %s — %s (%s) %s", "rn", "title", "company_name", "work_mode", "source_url")
    return top.select("day", F.col("rn").alias("rank"), "id", line.alias("line"))


def digest_header(day: Column) -> Column:
    """Heading of one day's digest."""
    return F.concat(F.lit("📌 Vagas do dia ("), day.cast("string"), F.lit(")"))


def card(state: DataFrame) -> DataFrame:
    """Message text of one posting with its first five tags."""
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5), ", ")
    lines = [
        F.concat(F.lit("🚀 "), F.col("title")), F.concat(F.lit("🏢 "), F.col("company_name")),
        F.concat(F.lit("📍 "), F.col("location_text"), F.lit(" • "), F.col("work_mode")),
        F.concat(F.lit("🎚️ "), F.col("seniority"), F.lit(" • "), F.col("employment_type")),
        F.concat(F.lit("🏷️ "), tags), F.concat(F.lit("🔗 "), F.col("source_url")),
    ]
    return state.select("id", F.concat_ws("\n", *lines).alias("message"))

"""Read models: detail, list item, display views and query-parameter clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import is_blank, null_if_blank, parse_date, trim_space

DEFAULT_SORT = "postedAt:desc"
DEFAULT_PAGE_SIZE = 20
MAX_TEXT = 200
# Accepted sort orders and employment types, by lower-case spelling.
SORTS = {s.lower(): s for s in ("postedAt:desc", "postedAt:asc", "capturedAt:desc", "capturedAt:asc")}
EMPLOYMENT_TYPES = {s.lower(): s for s in ("CLT", "PJ", "Contractor", "Temporary", "Internship")} | {"contract": "Contractor"}
TEXT_PARAMS = ["q", "tags", "workMode", "seniority", "sourceName", "company", "location"]


def to_detail(state: DataFrame) -> DataFrame:
    """Nested detail record; salary only when an amount is known."""
    salary = F.when(F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull(), F.struct(
        F.col("salary_min").alias("min"), F.col("salary_max").alias("max"),
        F.col("salary_currency").alias("currency"), F.col("salary_period").alias("period")))
    return state.select(
        "id", "title",
        F.struct(F.col("company_name").alias("name"), F.col("company_website").alias("website"),
                 F.col("company_industry").alias("industry")).alias("company"),
        F.col("location_text").alias("locationText"), F.struct("country", "state", "city").alias("location"),
        F.col("work_mode").alias("workMode"), "seniority", F.col("employment_type").alias("employmentType"),
        salary.alias("salary"), F.col("description_text").alias("descriptionText"), "tags", "languages",
        F.struct(F.col("source_name").alias("name"), F.col("source_type").alias("type"), F.col("source_url").alias("url"),
                 F.col("source_job_id").alias("sourceJobId")).alias("source"),
        F.col("posted_at").alias("postedAt"), F.col("captured_at").alias("capturedAt"), F.col("last_seen_at").alias("lastSeenAt"),
        "status", F.struct("fingerprint", F.col("cluster_id").alias("clusterId")).alias("dedupe"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def parse_metadata(text: Column) -> Column:
    """Stored metadata text to a map; unreadable text gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.try_parse_json(text).isNotNull(), F.coalesce(F.from_json(text, "map<string,string>"), empty)).otherwise(empty)


def to_list_item(docs: DataFrame) -> DataFrame:
    """List entry of a search hit."""
    return docs.select(
        "id", "title", F.struct(F.col("company").alias("name")).alias("company"), "locationText", "workMode", "seniority",
        "employmentType", F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tags"),
        "postedAt", "capturedAt", F.struct(F.col("sourceName").alias("name"), F.col("sourceUrl").alias("url")).alias("source"),
    )


def _column(df: DataFrame, name: str) -> Column:
    return null_if_blank(F.col(name)) if name in df.columns else F.lit(None).cast("string")


def to_ui_job(items: DataFrame) -> DataFrame:
    """Display view; accepts flat or nested company, source and location, and tags as an array or a comma list."""
    kinds = dict(items.dtypes)

    def inner(outer: str, field: str) -> Column:
        return null_if_blank(F.col(f"{outer}.{field}")) if kinds.get(outer, "").startswith("struct") and f"{field}:" in kinds[outer] else F.lit(None).cast("string")

    def flat(name: str) -> Column:
        return _column(items, name) if kinds.get(name) in ("string", None) else F.lit(None).cast("string")

    tags = F.lit(None).cast("array<string>")
    if kinds.get("tags") == "string":
        tags = F.transform(F.split("tags", ","), trim_space)
    elif "tags" in kinds:
        tags = F.col("tags")
    tags = F.filter(tags, lambda t: ~is_blank(t))
    posted = F.col("postedAt").cast("string") if "postedAt" in kinds else F.lit(None).cast("string")
    return items.select(
        _column(items, "id").alias("id"), flat("title").alias("title"),
        F.coalesce(flat("company"), inner("company", "name")).alias("company"),
        F.coalesce(flat("locationText"), flat("location"), inner("location", "city"), inner("location", "state")).alias("location"),
        flat("workMode").alias("workMode"), flat("seniority").alias("seniority"), flat("employmentType").alias("employmentType"),
        F.when(F.size(tags) > 0, tags).alias("tags"), F.coalesce(flat("description"), flat("descriptionText")).alias("description"),
        F.coalesce(flat("applyUrl"), inner("source", "url")).alias("applyUrl"),
        F.coalesce(flat("sourceName"), inner("source", "name")).alias("sourceName"), null_if_blank(posted).alias("postedAt"),
    ).filter(F.col("id").isNotNull())


def to_ui_source(sources: DataFrame) -> DataFrame:
    """Display view of sources; rows without a name are dropped."""
    return sources.select(
        null_if_blank(F.col("id")).alias("id"), null_if_blank(F.col("name")).alias("name"),
        null_if_blank(F.col("type")).alias("type"), null_if_blank(F.col("base_url")).alias("baseUrl"), "enabled",
    ).filter(F.col("name").isNotNull())


def to_ui_favorite(items: DataFrame) -> DataFrame:
    """Display view of favourites: six fields."""
    return to_ui_job(items).select("id", "title", "company", "location", "postedAt", "sourceName")


def normalize_query(params: DataFrame) -> DataFrame:
    """Clean a table of saved search parameters (all strings)."""
    def lookup(table: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def whole(name: str, fallback: int) -> Column:
        n = F.floor(trim_space(F.col(name)).try_cast("double"))
        return F.coalesce(F.when(n > 0, n), F.when(trim_space(F.col(name)).try_cast("double") > 0, F.lit(0)), F.lit(fallback)).cast("long")

    text = {c: F.left(null_if_blank(trim_space(F.col(c))), F.lit(MAX_TEXT)) for c in TEXT_PARAMS}
    kind = null_if_blank(trim_space(F.col("employmentType")))
    sort = F.lower(trim_space(F.col("sort")))
    return params.withColumns({
        **text,
        "employmentType": F.coalesce(F.try_element_at(lookup(EMPLOYMENT_TYPES), F.lower(kind)), kind),
        "sort": F.coalesce(F.try_element_at(lookup(SORTS), sort), F.lit(DEFAULT_SORT)),
        "postedFrom": F.date_format(parse_date(F.col("postedFrom")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "page": whole("page", 1),
        "pageSize": F.least(whole("pageSize", DEFAULT_PAGE_SIZE), F.lit(100)),
    })

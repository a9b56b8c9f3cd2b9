"""Raw postings to the common record, the flat state layout and the search document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.identity import fingerprint, stable_job_id
from postingflow.functions import infer
from postingflow.functions.text import is_blank, trim_space
from postingflow.operators.scan import option_join
from postingflow.schema import SALARY_TYPE, STATE_SCHEMA


def _metadata(**pairs: Column) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])


def to_posting(raw: DataFrame, registry: DataFrame, tag_mode: str = "token") -> DataFrame:
    """Nested posting record of each raw posting, with its family's defaults.

    `registry` is the small per-source option table. The fingerprint always uses the parsed company.
    """
    options = registry.select(
        "source_name", F.col("source_type").alias("_type"), F.col("start_url").alias("_start"), "tenant", "site_name",
        "site_path", F.col("company").alias("_company")).dropDuplicates(["source_name"])
    if "file_name" not in raw.columns:
        raw = raw.withColumns({"file_name": F.lit(None).cast("string"), "raw_json": F.lit(None).cast("string")})
    df = option_join(raw, options, ["source_name"], "left")
    family, source = F.col("family"), F.col("source_name")
    listing, gupy, workday, sample = [family == f for f in ("listing", "gupy", "workday", "sample")]
    careers = family.isin("jsonld", "anchor_tail") & (F.coalesce("_type", F.lit("")) != "JsonLd")
    jsonld = family.isin("jsonld", "anchor_tail") & ~careers
    desc = F.coalesce("description", F.lit(""))
    loc = F.coalesce("location_text", F.lit(""))
    title = F.col("title")

    parsed_company = F.when(gupy, source).when(workday, F.coalesce("_company", source)).otherwise(F.col("company"))
    company = F.when(careers & is_blank(F.col("company")), source).when(
        listing & is_blank(F.col("company")), F.coalesce("_company", source)).otherwise(parsed_company)
    mode = F.when(sample, infer.infer_work_mode_location(loc)).otherwise(
        infer.infer_work_mode(F.col("work_mode_text"), loc, desc))
    strict = "compat" if tag_mode == "compat" else "token"
    employment = F.when(jsonld, infer.infer_employment(F.col("employment_text"), desc, strict)).when(
        workday, infer.infer_employment_workday(F.col("employment_text"))).otherwise(F.lit("Unknown"))
    languages = (
        F.when(listing | gupy, F.array(F.lit("pt-BR"))).when(workday, F.array(F.lit("pt-BR"), F.lit("en-US")))
        .when(careers, infer.infer_languages(desc, ["pt-BR"])).when(jsonld, infer.infer_languages(desc, []))
        .otherwise(infer.infer_languages(desc))
    )
    tags = F.when(sample, infer.infer_tags_sample(title, desc)).otherwise(infer.infer_tags(title, desc, tag_mode))
    kind = F.when(sample, infer.source_type_from_name(source)).otherwise(F.coalesce("_type", F.lit("Unknown")))
    list_path = F.concat(F.lit("/wday/cxs/"), trim_space(F.col("tenant")), F.lit("/"), trim_space(F.col("site_name")), F.lit("/jobs"))
    parser = F.when(family == "anchor_tail", F.lit("totvs-html")).otherwise(F.lit("json-ld"))
    metadata = (
        F.when(listing, _metadata(source=source, salaryText=F.col("salary_text"), searchUrl=F.col("page_url")))
        .when(gupy, _metadata(source=source, companyBaseUrl=F.col("_start"), resolvedEndpoint=F.col("page_url"), parser=F.lit("gupy-json")))
        .when(workday, _metadata(source=source, sourceType=F.lit("Workday"), tenant=F.col("tenant"), siteName=F.col("site_name"),
                                 sitePath=F.col("site_path"), listEndpointPath=list_path))
        .when(sample, _metadata(fixtureFile=F.col("file_name"), raw=F.coalesce("raw_json", F.lit("{}"))))
        .otherwise(_metadata(source=source, startUrl=F.col("_start"), parser=parser))
    )
    job_id = F.when(listing, stable_job_id(F.col("source_job_id"), F.col("url"))).otherwise(F.col("source_job_id"))
    df = df.withColumn("_mode", mode)
    none = F.lit(None).cast("string")
    place = F.when(sample & ~is_blank(loc), F.struct(
        infer.infer_country(loc).alias("country"), none.alias("state"), none.alias("city")))
    salary = F.when(listing, infer.parse_salary(F.col("salary_text"))).otherwise(F.lit(None).cast(SALARY_TYPE))
    return df.select(
        "page_id", "ord",
        F.struct(source.alias("name"), kind.alias("type"), F.col("url").alias("url"), job_id.alias("source_job_id")).alias("source"),
        title.alias("title"),
        F.struct(company.alias("name"), none.alias("website"), none.alias("industry")).alias("company"),
        loc.alias("location_text"), place.alias("location"), F.col("_mode").alias("work_mode"),
        F.lit("Unknown").alias("seniority"), employment.alias("employment_type"), salary.alias("salary"),
        desc.alias("description_text"), tags.alias("tags"), languages.alias("languages"), "posted_at",
        F.struct(fingerprint(parsed_company, title, loc, F.col("_mode")).alias("fingerprint"), none.alias("cluster_id")).alias("dedupe"),
        metadata.alias("metadata"),
    )


def with_run_ts(postings: DataFrame, run_at: Column) -> DataFrame:
    """Stamp a run: captured and last seen at the run time, status Active."""
    return postings.withColumns({"captured_at": run_at, "last_seen_at": run_at, "status": F.lit("Active")})


def to_entity(postings: DataFrame, new_id: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Flatten nested postings to the state layout."""
    values = {
        "id": F.uuid() if new_id is None else new_id,
        "source_name": F.col("source.name"), "source_type": F.col("source.type"), "source_url": F.col("source.url"),
        "source_job_id": F.col("source.source_job_id"), "origin_url": F.lit(None), "company_name": F.col("company.name"),
        "company_website": F.col("company.website"), "company_industry": F.col("company.industry"),
        "country": F.col("location.country"), "state": F.col("location.state"), "city": F.col("location.city"),
        "salary_min": F.col("salary.min"), "salary_max": F.col("salary.max"), "salary_currency": F.col("salary.currency"),
        "salary_period": F.col("salary.period"), "fingerprint": F.col("dedupe.fingerprint"), "cluster_id": F.col("dedupe.cluster_id"),
    }
    fields = [values.get(f.name, F.col(f.name) if f.name in postings.columns else F.lit(None)) for f in STATE_SCHEMA.fields]
    return postings.select(*keep, *[c.cast(f.dataType).alias(f.name) for c, f in zip(fields, STATE_SCHEMA.fields)])


def to_search_doc(state: DataFrame) -> DataFrame:
    """The searchable projection of a posting: no description, salary or languages."""
    return state.select(
        "id", "title", F.col("company_name").alias("company"), F.col("company_name").alias("companyName"),
        F.col("location_text").alias("locationText"), F.col("work_mode").alias("workMode"), "seniority",
        F.col("employment_type").alias("employmentType"), "tags", F.col("posted_at").alias("postedAt"),
        F.col("captured_at").alias("capturedAt"), "status", F.col("source_name").alias("sourceName"),
        F.col("source_url").alias("sourceUrl"), "fingerprint",
    )


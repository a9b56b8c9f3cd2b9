"""Record layouts and enum tables shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Enum names and their stored integer codes.
ENUMS: dict[str, dict[str, int]] = {
    "WorkMode": {"Unknown": 0, "Remote": 1, "Hybrid": 2, "Onsite": 3},
    "Seniority": {
        "Unknown": 0, "Intern": 1, "Junior": 2, "Mid": 3, "Senior": 4, "Staff": 5, "Lead": 6, "Principal": 7,
    },
    "EmploymentType": {"Unknown": 0, "CLT": 1, "PJ": 2, "Contractor": 3, "Internship": 4, "Temporary": 5},
    "JobStatus": {"Unknown": 0, "Active": 1, "Expired": 2},
    "SourceType": {
        "Unknown": 0, "LinkedIn": 1, "Greenhouse": 2, "Lever": 3, "Indeed": 4, "CareersPage": 5, "InfoJobs": 6,
        "Vagas": 7, "JsonLd": 8, "CorporateCareers": 9, "Gupy": 10, "Workday": 11, "ExternalIngestion": 50,
        "Fixture": 100,
    },
}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def enum_code(name: Column, enum: str) -> Column:
    """Enum name to stored integer code; null when the name is not defined."""
    return F.try_element_at(_literal_map(ENUMS[enum]), name)


def enum_name(code: Column, enum: str) -> Column:
    """Stored integer code to enum name; null when the code is not defined."""
    return F.try_element_at(_literal_map({v: k for k, v in ENUMS[enum].items()}), code.cast("int"))


# One row per posting as an extractor emits it; absent fields are null.
RAW_SCHEMA = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location_text", T.StringType()),
    T.StructField("source_job_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
    T.StructField("employment_text", T.StringType()),
    T.StructField("work_mode_text", T.StringType()),
    T.StructField("salary_text", T.StringType()),
    T.StructField("external_path", T.StringType()),
])

SALARY_TYPE = T.StructType([
    T.StructField("min", T.DecimalType(18, 2)),
    T.StructField("max", T.DecimalType(18, 2)),
    T.StructField("currency", T.StringType()),
    T.StructField("period", T.StringType()),
])

# The flat state table.
STATE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("source_job_id", T.StringType()),
    T.StructField("origin_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("company_website", T.StringType()),
    T.StructField("company_industry", T.StringType()),
    T.StructField("location_text", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("work_mode", T.StringType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("salary_min", T.DecimalType(18, 2)),
    T.StructField("salary_max", T.DecimalType(18, 2)),
    T.StructField("salary_currency", T.StringType()),
    T.StructField("salary_period", T.StringType()),
    T.StructField("description_text", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("posted_at", T.TimestampType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("last_seen_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("cluster_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
STATE_COLUMNS = [f.name for f in STATE_SCHEMA.fields]

# One external batch request as it arrives: JSON, one object per batch.
BULK_ITEM_TYPE = T.StructType([
    T.StructField("sourceJobId", T.StringType()),
    T.StructField("sourceUrl", T.StringType()),
    T.StructField("originUrl", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("industry", T.StringType()),
    ])),
    T.StructField("locationText", T.StringType()),
    T.StructField("workMode", T.StringType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("employmentType", T.StringType()),
    T.StructField("descriptionText", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("postedAt", T.TimestampType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("sourceName", T.StringType()),
    T.StructField("sourceType", T.StringType()),
])
BULK_REQUEST_SCHEMA = T.StructType([
    T.StructField("sourceName", T.StringType()),
    T.StructField("sourceType", T.StringType()),
    T.StructField("items", T.ArrayType(BULK_ITEM_TYPE)),
])

# Per-source options; a small configuration table.
REGISTRY_SCHEMA = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("start_url", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("requires_js", T.BooleanType()),
    T.StructField("max_items", T.IntegerType()),
    T.StructField("max_detail", T.IntegerType()),
    T.StructField("base_host", T.StringType()),
    T.StructField("tenant", T.StringType()),
    T.StructField("site_name", T.StringType()),
    T.StructField("site_path", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("page_size", T.IntegerType()),
    T.StructField("max_pages", T.IntegerType()),
])

"""The main functions for use in SQL text: `register(spark)` adds them to a session.

They are SQL functions, so Catalyst inlines them; only the JSON walk is a table function in Python.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession, functions as F

from postingflow.functions import text
from postingflow.functions.infer import TAG_WORDS
from postingflow.functions.json_walk import objects


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tag_cases() -> str:
    cases = []
    for needle, tag in TAG_WORDS:
        left = "" if needle.startswith(".") else r"(?<![\p{L}\p{Nd}])"
        pattern = left + needle.replace(".", r"\.") + r"(?![\p{L}\p{Nd}#+])"
        cases.append(f"CASE WHEN contains(raw, {_quote(needle)}) AND raw RLIKE {_quote(pattern)} THEN {_quote(tag)} END")
    return ", ".join(cases)


def _definitions() -> list[str]:
    keep = rf"[^\p{{L}}\p{{Nd}}{text._KEEP_SPACE}]+"
    fold = f"translate(lower(btrim(coalesce(s, ''), {_quote(text._SPACE_CHARS)})), {_quote(text._ACCENTED)}, {_quote(text._BASE)})"
    amount = (
        "try_cast(CASE WHEN x RLIKE '^[^,]*(,[^.,]*)?$' THEN replace(replace(x, '.', ''), ',', '.') "
        r"WHEN x RLIKE '^[^.]*(\\.[^.,]*)?$' THEN replace(x, ',', '') END AS DECIMAL(18,2))")
    numbers = rf"filter(transform(regexp_extract_all(s, '(\\d+[\\d.,]*)', 1), x -> {amount}), n -> n IS NOT NULL)"
    head = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        f"{head} normalize_text(s STRING) RETURNS STRING RETURN trim(regexp_replace({fold}, {_quote(keep)}, ' '))",
        f"{head} fingerprint(company STRING, title STRING, location STRING, mode STRING) RETURNS STRING RETURN "
        "'sha256:' || sha2(concat_ws('|', normalize_text(company), normalize_text(title), normalize_text(location), normalize_text(mode)), 256)",
        f"{head} url_hash_id(url STRING) RETURNS STRING RETURN 'url:' || left(sha2(lower(btrim(url, {_quote(text._SPACE_CHARS)})), 256), 16)",
        f"{head} parse_salary(s STRING) RETURNS STRUCT<min: DECIMAL(18,2), max: DECIMAL(18,2), currency: STRING, period: STRING> RETURN "
        f"named_struct('min', try_element_at({numbers}, 1), 'max', coalesce(try_element_at({numbers}, 2), try_element_at({numbers}, 1)), "
        "'currency', CASE WHEN contains(upper(s), 'R$') THEN 'BRL' END, 'period', CASE WHEN contains(normalize_text(s), 'mes') THEN 'month' END)",
        f"{head} infer_tags(title STRING, description STRING) RETURNS ARRAY<STRING> RETURN element_at(transform("
        "array(lower(concat_ws(' ', coalesce(title, ''), coalesce(description, '')))), "
        f"raw -> array_distinct(filter(array({_tag_cases()}), t -> t IS NOT NULL))), 1)",
    ]


@F.udtf(returnType="ord int, object string")
class JsonObjects:
    """Every object of a JSON text, parents first; text that is not JSON gives no rows."""

    def eval(self, source: str):
        try:
            root = json.loads(source) if source else None
        except (ValueError, RecursionError):
            return
        for i, node in enumerate(objects(root)):
            yield i, json.dumps(node, ensure_ascii=False, separators=(",", ":"))


def register(spark: SparkSession) -> None:
    """Add normalize_text, fingerprint, url_hash_id, parse_salary, infer_tags and the table function json_objects."""
    for definition in _definitions():
        spark.sql(definition)
    spark.udtf.register("json_objects", JsonObjects)

"""Shared inputs and SQL fragments of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postingflow.sources.scans import widen

WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
KEEP = WS.replace(" ", "", 1)


def registrar() -> tuple[dict, Callable]:
    """A query table and the decorator that fills it."""
    table: dict = {}

    def query(sql: str | None = None):
        def add(fn):
            table[fn.__name__] = (fn, sql)
            return fn

        return add

    return table, query


def table(spark: SparkSession, folder: str, name: str, heavy: bool | None = None) -> DataFrame:
    """One of the given tables; `heavy` spreads a table of few row groups before costly work on each row."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    heavy = name in ("documents", "pages") if heavy is None else heavy
    return widen(frame) if heavy else frame


def small(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A constant option table."""
    return spark.createDataFrame(rows, schema)


def s_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def s_norm(x: str) -> str:
    """SQL of normalize_text."""
    folded = f"regexp_replace(strip_accents(lower({s_trim(f'coalesce({x}, $q$$q$)')})), '\\p{{Mn}}+', '', 'g')"
    return f"trim(regexp_replace({folded}, '[^\\p{{L}}\\p{{Nd}}{KEEP}]+', ' ', 'g'))".replace("$q$", "'")


def s_print(company: str, title: str, location: str, mode: str) -> str:
    """SQL of fingerprint."""
    return "'sha256:' || sha256(" + " || '|' || ".join(s_norm(x) for x in (company, title, location, mode)) + ")"


def s_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def s_entities(x: str) -> str:
    """The references that occur in the given pages, ampersand last."""
    for name, char in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{char}')"
    return x


def s_html(x: str) -> str:
    """SQL of html_text."""
    return s_collapse(s_entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def pick(c: Column, *values: str) -> Column:
    """Value by number: the first for 0, the second for 1, and so on around."""
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(F.pmod(c, F.lit(len(values))) == i, F.lit(values[i])).otherwise(out)
    return out


def s_pick(x: str, *values: str) -> str:
    """SQL of pick."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE ({x}) % {len(values)} {whens} ELSE '{values[-1]}' END"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages under the layout the extractors read."""
    return table(spark, folder, "pages").select("page_id", F.col("url").alias("page_url"), F.lit("web").alias("source_name"), "html")

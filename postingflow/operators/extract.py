"""Extraction of raw postings from captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postingflow.functions import json_walk as jw
from postingflow.functions.identity import (
    absolutize, board_job_id, escape_segment, is_board_url, last_segment, stable_job_id, url_hash_id,
    workday_detail_path,
)
from postingflow.functions.text import collapse_space, html_text, is_blank, let, normalize_text, null_if_blank, parse_date, trim_space
from postingflow.operators.scan import first_n, first_per_key, option_join
from postingflow.schema import RAW_SCHEMA

# How pages embed data and mark postings.
JSONLD_BLOCK = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
STATE_BLOCK = r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
STATE_BLOCK_ANY_QUOTE = r"""(?is)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
JSON_BLOCK_ANY_QUOTE = r"""(?is)<script[^>]*type=["']application/(?:ld\+)?json["'][^>]*>(.*?)</script>"""
BOARD_HREF = r'[^"]*vaga-de-[^"]*__\d+\.aspx'
COMPANY_LABEL = r"(?is)(?:empresa|company)[^<:\n]{0,40}[:\-]?\s*([A-Za-z0-9 .&\-]{2,80})"
LOCATION_LABEL = r"(?is)(?:local|location|cidade)[^<:\n]{0,40}[:\-]?\s*([A-Za-z0-9 .,/\-]{2,120})"
SALARY_LABEL = r"(?is)(?:salario|salary)[^<:\n]{0,40}[:\-]?\s*([^<\n]{2,80})"
TAIL_LOCATION = (
    r"(?i)(remote|remoto|hybrid|hibrido|híbrido|onsite|presencial|[A-Za-zÀ-ÿ ]{2,40}\s?,\s?[A-Z]{2})"
)
DETAIL_WORDS = ["job description", "descricao da vaga", "responsabilidades", "requirements", "requisitos"]
DETAIL_BLOCK = (
    r"(?is)<(?:section|div)[^>]*(?:description|descricao|requirements|responsabilidades)[^>]*>(.*?)</(?:section|div)>"
)

PAGE_KEYS = ["page_id", "page_url", "source_name"]


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def blocks(html: Column, kind: str) -> Column:
    """Array of embedded JSON texts: 'jsonld', 'state' (first only) or 'embedded' (state, then JSON, any quote)."""
    if kind == "jsonld":
        return _all(html, JSONLD_BLOCK)
    if kind == "state":
        return F.slice(_all(html, STATE_BLOCK), 1, 1)
    found = F.concat(_all(html, STATE_BLOCK_ANY_QUOTE), _all(html, JSON_BLOCK_ANY_QUOTE))
    return F.filter(F.transform(found, trim_space), looks_like_json)


def script_blocks(pages: DataFrame, kind: str) -> DataFrame:
    """One row per embedded block with its position in the page."""
    return pages.select(*PAGE_KEYS, F.posexplode(blocks(F.col("html"), kind)).alias("block_ord", "block"))


def malformed_blocks(pages: DataFrame, kind: str) -> DataFrame:
    """Embedded blocks that are not JSON; they give error rows instead of stopping the source."""
    found = script_blocks(pages, kind)
    return found.filter(F.try_parse_json("block").isNull()).withColumn("error", F.lit("malformed JSON block"))


def json_objects(pages: DataFrame, kind: str = "embedded") -> DataFrame:
    """Every JSON object of every embedded block, in document order."""
    found = script_blocks(pages, kind)
    rows = jw.pick_rows(jw.object_rows, F.array("block"))
    return found.select(*PAGE_KEYS, "block_ord", F.posexplode(rows).alias("ord", "_o")).select(
        *PAGE_KEYS, "block_ord", "ord", F.col("_o.description").alias("object"))


def looks_like_json(c: Column) -> Column:
    """First visible character opens an object or array."""
    return F.ltrim(trim_space(c)).rlike(r"^[\[{]")


def _conform(df: DataFrame, family: str) -> DataFrame:
    """Project to the raw layout; absent columns become null."""
    present = set(df.columns)
    cols = [
        (F.lit(family) if f.name == "family" else F.col(f.name) if f.name in present else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in RAW_SCHEMA.fields
    ]
    return df.select(*cols)


def _first_date(dates: Column, count: int) -> Column:
    return F.coalesce(*[parse_date(F.get(dates, F.lit(i))) for i in range(count)])


def _walk(pages: DataFrame, rows, found: Column, dates: int, first_hit: bool = False, extra: list[str] = ()) -> DataFrame:
    keep = [*PAGE_KEYS, *extra]
    walked = pages.select(*keep, F.posexplode(jw.pick_rows(rows, found, first_hit)).alias("ord", "_r"))
    fields = [F.col(f"_r.{f}").alias(f) for f in jw.FIELDS]
    return walked.select(
        *keep, F.col("ord").cast("long").alias("ord"), *fields, _first_date(F.col("_r.dates"), dates).alias("posted_at")
    )


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """schema.org postings of a page, first per id."""
    rows = _walk(pages, jw.jsonld_rows, blocks(F.col("html"), "jsonld"), 2)
    rows = (
        rows.withColumn("title", html_text(F.col("title")))
        .withColumn("url", absolutize(F.coalesce("url", "page_url"), F.col("page_url")))
        .withColumn("company", F.when(is_blank(F.col("company")), F.lit("Unknown")).otherwise(html_text(F.col("company"))))
        .withColumn("location_text", html_text(F.col("location_text")))
        .filter(~is_blank(F.col("title")) & ~is_blank(F.col("url")))
        .withColumn("source_job_id", F.coalesce(null_if_blank(F.col("source_job_id")), url_hash_id(F.col("url"))))
    )
    return first_per_key(_conform(rows, "jsonld"), ["page_id"], F.col("source_job_id"), ["ord"])


def _tail_after_anchor(segment: Column, size: int) -> Column:
    cut = F.instr(F.lower(segment), F.lit("</a>"))
    return F.when(cut > 0, segment.substr(cut + F.lit(4), F.lit(size))).otherwise("")


def extract_anchors(pages: DataFrame, posting_href: str = BOARD_HREF) -> DataFrame:
    """Posting links with labelled company, location and salary read between this link and the next one."""
    opening = rf'<a[^>]*href="{posting_href}"'
    cut = F.split(F.col("html"), f"(?i)(?={opening})")
    segments = pages.select(*PAGE_KEYS, F.posexplode(cut).alias("ord", "segment")).filter(
        F.col("segment").rlike(f"(?i)^{opening}"))
    context = F.col("context")

    def label(pattern: str) -> Column:
        return null_if_blank(html_text(F.regexp_extract(context, pattern, 1)))

    link = r'(?is)^<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    rows = (
        segments.withColumn("context", _tail_after_anchor(F.col("segment"), 1200))
        .withColumn("href", F.regexp_extract("segment", link, 1))
        .withColumn("title", html_text(F.regexp_extract("segment", link, 2)))
        .filter(~is_blank(F.col("href")) & ~is_blank(F.col("title")))
        .withColumn("url", absolutize(F.col("href"), F.col("page_url")))
        .withColumn("company", F.coalesce(label(COMPANY_LABEL), F.lit("Unknown")))
        .withColumn("location_text", F.coalesce(label(LOCATION_LABEL), F.lit("")))
        .withColumn("salary_text", label(SALARY_LABEL))
        .withColumn("source_job_id", board_job_id(F.col("url")))
        .withColumn("ord", F.col("ord").cast("long"))
    )
    return _conform(rows, "listing")


def extract_listing(pages: DataFrame, url_pattern: str | None = None, posting_href: str = BOARD_HREF) -> DataFrame:
    """Postings of a listing page from page state, structured data and links; first per URL in that order."""
    def accepted(df: DataFrame) -> DataFrame:
        url = F.col("url")
        good = is_board_url(url) if url_pattern is None else F.coalesce(url.rlike(url_pattern), F.lit(False))
        return df.filter(~is_blank(F.col("title")) & ~is_blank(url) & good)

    def tier(rows, kind: str, number: int, dates: int) -> DataFrame:
        found = _walk(pages, rows, blocks(F.col("html"), kind), dates)
        found = (
            found.filter(~is_blank(F.col("title")) & ~is_blank(F.col("url")))
            .withColumn("url", absolutize(F.col("url"), F.col("page_url")))
            .withColumn("title", html_text(F.col("title")))
            .withColumn("company", F.coalesce(null_if_blank(html_text(F.col("company"))), F.lit("Unknown")))
            .withColumn("location_text", html_text(F.col("location_text")))
        )
        return _conform(found, "listing").withColumn("tier", F.lit(number))

    tiers = (
        tier(jw.listing_rows, "state", 1, 3)
        .unionByName(tier(jw.listing_jsonld_rows, "jsonld", 2, 1))
        .unionByName(extract_anchors(pages, posting_href).withColumn("tier", F.lit(3)))
    )
    return first_per_key(accepted(tiers), ["page_id"], F.col("url"), ["tier", "ord"]).drop("tier")


def extract_anchor_tail(pages: DataFrame, company: str = "TOTVS") -> DataFrame:
    """Job-looking links followed by a short tail that names the place; first per URL."""
    cut = pages.select(*PAGE_KEYS, F.posexplode(F.split("html", "(?i)(?=<a)")).alias("ord", "segment"))
    link = r'(?i)^<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    href = F.lower(F.col("href"))
    looks = href.contains("/job/") | href.contains("/jobs/") | href.contains("oportunidade") | href.contains("vaga")
    rows = (
        cut.withColumn("href", F.regexp_extract("segment", link, 1))
        .filter(~is_blank(F.col("href")) & looks)
        .withColumn("title", html_text(F.regexp_extract("segment", link, 2)))
        .filter(F.length("title") >= 4)
        .withColumn("work_mode_text", html_text(_tail_after_anchor(F.col("segment"), 300)))
        .withColumn("location_text", F.trim(F.regexp_extract("work_mode_text", TAIL_LOCATION, 1)))
        .withColumn("url", absolutize(F.col("href"), F.col("page_url")))
        .withColumn("source_job_id", stable_job_id(F.lit(None).cast("string"), F.col("url")))
        .withColumn("company", F.lit(company))
        .withColumn("ord", F.col("ord").cast("long"))
    )
    return first_per_key(_conform(rows, "anchor_tail"), ["page_id"], F.col("url"), ["ord"])


def extract_workday(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Listing entries of Workday pages; host and site come from the registry."""
    options = registry.select("source_name", "base_host", "site_path", "site_name")
    located = option_join(pages, options, ["source_name"])
    rows = _walk(located, jw.workday_rows, F.array("html"), 1, extra=["base_host", "site_path", "site_name"])
    path, host = F.col("external_path"), trim_space(F.col("base_host"))
    site = F.when(is_blank(F.col("site_path")), F.concat(F.lit("/en-US/"), F.col("site_name"))).otherwise(
        F.regexp_replace("site_path", "/+$", ""))
    by_id = F.concat(F.lit("https://"), host, site, F.lit("/job/"),
                     escape_segment(F.coalesce(null_if_blank(F.col("url")), F.lit("unknown"))))
    url = (
        F.when(path.rlike("(?i)^https?://"), path)
        .when(path.startswith("/"), F.concat(F.lit("https://"), host, path))
        .otherwise(by_id)
    )
    rows = (
        rows.withColumn("url", url)
        .withColumn("title", trim_space(F.col("title")))
        .withColumn("employment_text", trim_space(F.col("employment_text")))
        .withColumn("source_job_id", F.coalesce(
            null_if_blank(trim_space(F.col("source_job_id"))), null_if_blank(last_segment(path)),
            null_if_blank(last_segment(F.col("url"))), F.col("url")))
        .filter(~is_blank(F.col("title")) & ~is_blank(F.col("source_job_id")))
    )
    return _conform(rows, "workday")


def extract_detail_workday(details: DataFrame) -> DataFrame:
    """Longest cleaned description of each detail payload; the first of equal length."""
    rows = details.select(*PAGE_KEYS, F.posexplode(jw.pick_rows(jw.description_rows, F.array("html"))).alias("ord", "_r"))
    rows = rows.select(*PAGE_KEYS, "ord", html_text(F.col("_r.description")).alias("description"))
    return rows.filter(F.col("description") != "").groupBy(*PAGE_KEYS).agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"))


def endpoint_candidates(registry: DataFrame) -> DataFrame:
    """Ordered distinct payload URLs to look for, per Gupy company base."""
    base = F.col("start_url")
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    whole = absolutize(base, base)
    on_host = F.lower(origin).contains("gupy.io")
    low = F.lower(path)

    def at(tail: Column | str, when: Column) -> Column:
        return F.when(when & on_host, F.concat(origin, F.lit(tail) if isinstance(tail, str) else tail))

    has_path = path != ""
    urls = F.array(
        F.when(origin != "", whole),
        at("/jobs.json", F.lit(True)), at("/jobs", F.lit(True)), at("/", F.lit(True)),
        at(F.concat(path, F.lit(".json")), has_path & ~low.endswith(".json")),
        at(F.concat(path, F.lit("/jobs")), has_path & ~low.endswith("/jobs")),
        at(F.concat(path, F.lit("/jobs.json")), has_path & ~low.endswith("/jobs")),
    )
    ordered = F.filter(urls, lambda u: u.isNotNull())
    lowered = F.transform(ordered, F.lower)
    distinct = F.filter(F.transform(ordered, lambda u, i: F.when(
        F.array_position(lowered, F.lower(u)) == i + 1, u)), lambda u: u.isNotNull())
    return registry.select("source_name", base.alias("base_url"), F.posexplode(distinct).alias("position", "endpoint"))


def sniff_payload(html: Column) -> Column:
    """The JSON texts of a payload: itself when it is JSON, else its embedded blocks in order."""
    return F.when(looks_like_json(html), F.array(html)).otherwise(blocks(html, "embedded"))


def extract_gupy(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Postings of the first candidate endpoint that has any, per company; first per id."""
    candidates = endpoint_candidates(registry)
    hits = pages.drop("source_name").join(candidates, F.lower("page_url") == F.lower("endpoint"))
    rows = _walk(hits, jw.gupy_rows, sniff_payload(F.col("html")), 3, first_hit=True, extra=["position", "base_url"])
    base = F.col("page_url")
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    rows = rows.withColumn("url", absolutize(
        F.coalesce(F.col("url"), F.concat(origin, F.lit("/job/"), F.col("source_job_id"))), base)
    ).withColumn("location_text", F.coalesce("location_text", F.lit(""))).filter(~is_blank(F.col("url")))
    best = rows.groupBy("source_name").agg(F.min("position").alias("_best"))
    chosen = rows.join(best, "source_name").filter(F.col("position") == F.col("_best"))
    mode = F.when(F.lower("work_mode_text").rlike("^on.?site$"), F.lit("onsite")).otherwise(F.col("work_mode_text"))
    rows = _conform(chosen.withColumn("work_mode_text", mode), "gupy")
    return first_per_key(rows, ["page_id", "source_name"], F.col("source_job_id"), ["ord"])


def detail_description(html: Column) -> Column:
    """Text of a detail page: the marked section when the page names one, else everything."""
    page = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<script.*?</script>", " ")
    # The folded text is only needed where a section could be taken at all.
    marked = let(normalize_text(page), lambda folded: F.greatest(*[folded.contains(w) for w in DETAIL_WORDS]))
    return html_text(let(page, lambda p: F.when(
        p.rlike(DETAIL_BLOCK), F.when(marked, F.regexp_extract(p, DETAIL_BLOCK, 1)).otherwise(p)).otherwise(p)))


def first_items(df: DataFrame, limit: Column) -> DataFrame:
    """The first `limit` rows of each source by (page_id, ord); all where `limit` is null.

    Pages are counted first. Only a source's first `limit` pages can hold its first rows, so its cut falls into one of those; rows of whole
    pages pass, and only rows of one page are ever ordered together. Sources without a limit aren't looked at.
    """
    marked = df.withColumn("_limit", limit)
    free = marked.filter(F.col("_limit").isNull()).drop("_limit")
    capped = marked.filter(F.col("_limit") > 0)
    pages = capped.groupBy("source_name", "page_id").agg(F.count(F.lit(1)).alias("_n"), F.first("_limit").alias("_limit"))
    begun = first_n(pages, ["source_name"], [F.col("page_id")], F.col("_limit"))
    before = Window.partitionBy("source_name").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = begun.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_start") < F.col("_limit")).select(
        F.col("source_name").alias("_s"), F.col("page_id").alias("_p"), "_start")
    hit = capped.join(starts, F.col("source_name").eqNullSafe(F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p")))
    at = F.row_number().over(Window.partitionBy("source_name", "page_id").orderBy("ord"))
    kept = hit.withColumn("_at", at + F.col("_start")).filter(F.col("_at") <= F.col("_limit")).select(*df.columns)
    return kept.unionByName(free)


def _options(registry: DataFrame, *names: str) -> DataFrame:
    """One row per source name: of several the least by these values, whatever order they come in."""
    return registry.groupBy("source_name").agg(F.min(F.struct(*names)).alias("_o")).select("source_name", "_o.*")


def enrich_details(raw: DataFrame, details: DataFrame, registry: DataFrame, budget: int | None = 20) -> DataFrame:
    """Fill blank descriptions from detail pages, at most the source's budget of rows, in list order; None is no budget.

    `details` holds page_id, page_url, source_name and html of captured detail pages; of several captures of
    one page the newest counts, by fetched_at where there is one, else by page_id.
    """
    keys = ["source_name", "page_id", "ord", "url"]
    run = F.lit(None if budget is None else max(budget, 0)).cast("int")
    own = F.when(F.col("family") == "workday", F.least(run, F.greatest(F.coalesce("max_detail", run), F.lit(0)))).otherwise(
        F.when(F.col("max_detail") > 0, F.col("max_detail")).otherwise(run))
    needing = raw.filter(is_blank(F.col("description"))).select(*keys, "family", "external_path", "source_job_id")
    options = _options(registry, "max_detail", "base_host", "tenant", "site_name")
    picked = first_items(option_join(needing, options, ["source_name"], "left"), own)
    workday_url = F.concat(F.lit("https://"), trim_space(F.col("base_host")), workday_detail_path(
        F.col("tenant"), F.col("site_name"), F.col("external_path"), F.col("source_job_id")))
    picked = picked.select(*keys, F.when(F.col("family") == "workday", workday_url).otherwise(F.col("url")).alias("_at"))
    asked = details.join(picked.select(F.col("_at").alias("page_url")).distinct(), "page_url", "left_semi")
    newest = F.struct(*[c for c in ("fetched_at", "page_id") if c in details.columns])
    pages = asked.groupBy("page_url").agg(F.max_by(F.struct(*[c for c in details.columns if c != "page_url"]), newest).alias("_row")).select("page_url", "_row.*")
    structured = extract_jsonld(pages).groupBy("page_url").agg(F.min_by("description", "ord").alias("_ld"))
    longest = extract_detail_workday(pages).select("page_url", F.col("description").alias("_wd"))
    text = F.when(looks_like_json(F.col("html")), F.lit(None)).otherwise(detail_description(F.col("html")))
    texts = (
        pages.select("page_url", text.alias("_txt"))
        .join(structured, "page_url", "left").join(longest, "page_url", "left")
        .select(F.col("page_url").alias("_at"), F.coalesce("_ld", "_wd", "_txt").alias("_text"))
    )
    filled = picked.join(texts, "_at").select(*[F.col(k).alias(f"_{k}") for k in keys], "_text")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = raw.join(filled, on, "left")
    return joined.withColumn("description", F.coalesce(null_if_blank(F.col("description")), F.col("_text"), F.col("description"))).select(*raw.columns)


def page_grid(registry: DataFrame) -> DataFrame:
    """One row per listing page to ask for, with its offset."""
    size = F.greatest(F.coalesce("page_size", F.lit(50)), F.lit(1))
    last = F.greatest(F.coalesce("max_pages", F.lit(3)), F.lit(1))
    grid = registry.select("source_name", size.alias("page_size"), F.explode(F.sequence(F.lit(1), last)).alias("page_no"))
    return grid.withColumn("offset", (F.col("page_no") - 1) * F.col("page_size"))


def truncate_pages(listing: DataFrame) -> DataFrame:
    """Keep listing pages before a source's first empty or blocked one; unreadable pages are passed over.

    `listing` has source_name, page_no, n_items (null when unreadable) and blocked.
    """
    ends = listing.filter((F.col("n_items") == 0) | F.col("blocked")).groupBy("source_name").agg(
        F.min("page_no").alias("_end"))
    kept = option_join(listing, ends, ["source_name"], "left").filter(F.col("_end").isNull() | (F.col("page_no") < F.col("_end")))
    return kept.filter(F.col("n_items").isNotNull()).drop("_end")


def cap_items(raw: DataFrame, registry: DataFrame, default: int | None = 20) -> DataFrame:
    """Keep the first items of each source: its own cap when set, else the run's, at least one; None is no cap."""
    run = F.lit(None if default is None else max(default, 1)).cast("int")
    limit = F.when(F.col("max_items") > 0, F.col("max_items")).otherwise(run)
    return first_items(option_join(raw, _options(registry, "max_items"), ["source_name"], "left"), limit).select(*raw.columns)

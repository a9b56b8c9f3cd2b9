"""Keys of a posting: fingerprint, URL ids and URL resolution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postingflow.functions.text import is_blank, let, normalize_text, null_if_blank, trim_space

# Fixed value: the listing board's posting URL.
BOARD_URL = r"(?i)^https://www\.infojobs\.com\.br/vaga-de-.*__\d+\.aspx$"


def fingerprint(company: Column, title: Column, location: Column, work_mode: Column) -> Column:
    """Content key of a posting: hash of its four folded fields."""
    parts = [normalize_text(c) for c in (company, title, location, work_mode)]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def url_hash_id(url: Column) -> Column:
    """Fallback id derived from the URL."""
    return F.concat(F.lit("url:"), F.left(F.sha2(F.lower(trim_space(url)), 256), F.lit(16)))


def is_board_url(url: Column) -> Column:
    """Whether the URL is a posting page of the listing board."""
    return F.coalesce(url.rlike(BOARD_URL), F.lit(False))


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def board_job_id(url: Column) -> Column:
    """Numeric id inside a board posting URL, else null."""
    return F.when(is_board_url(url), _group(url, r"(?i)__(\d+)\.aspx$"))


def stable_job_id(job_id: Column, url: Column) -> Column:
    """Board id, given id, id-like query parameter, long digit run, then URL hash."""
    return F.coalesce(
        board_job_id(url),
        null_if_blank(job_id),
        _group(url, r"(?i)[?&](id|iv|jobid)=(\d+)", 2),
        _group(url, r"(\d{5,})"),
        url_hash_id(url),
    )


def last_segment(url: Column) -> Column:
    """Last path segment without query; null for blank input."""
    path = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    return F.when(~is_blank(url), F.substring_index(path, "/", -1))


def _squash_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    def step(acc: Column, seg: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(seg == "..", up).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    segments = F.split(path, "/")
    walked = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")).cast("array<string>"), step
    )
    trailing = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(walked, "/"), trailing)


def absolutize(url: Column, base: Column) -> Column:
    """Resolve a reference against the page URL; references with a scheme stay as they are."""
    page = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)(//[^/?#]*)?([^?#]*)"
    parts = F.struct(
        trim_space(url).alias("ref"), base.alias("base"), F.regexp_extract(base, page, 1).alias("scheme"),
        F.regexp_extract(base, page, 2).alias("host"), F.coalesce(_group(base, page, 3), F.lit("/")).alias("path"))

    def resolved(p: Column) -> Column:
        ref = p["ref"]
        origin = F.concat(p["scheme"], p["host"])
        path = F.regexp_extract(ref, r"^([^?#]*)", 1)
        merged = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(p["path"], "[^/]*$", ""), path))
        clean = let(merged, lambda m: F.when(m.contains("/."), _squash_dots(m)).otherwise(m))
        return (
            F.when(ref.rlike(r"(?i)^https?://[^/?#]+$"), F.concat(ref, F.lit("/")))
            .when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(p["scheme"], ref))
            .when(ref == "", p["base"])
            .when(ref.startswith("?"), F.concat(origin, p["path"], ref))
            .when(ref.startswith("#"), F.concat(F.substring_index(p["base"], "#", 1), ref))
            .otherwise(F.concat(origin, clean, F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)))
        )

    return let(parts, resolved)


def workday_detail_path(tenant: Column, site: Column, external_path: Column, job_id: Column) -> Column:
    """Path of a posting's detail payload on a Workday host."""
    prefix = F.concat(F.lit("/wday/cxs/"), trim_space(tenant), F.lit("/"), trim_space(site))
    low = F.lower(F.coalesce(external_path, F.lit("")))
    return (
        F.when(low.startswith("/wday/cxs/"), external_path)
        .when(low.startswith("/job/"), F.concat(prefix, external_path))
        .otherwise(F.concat(prefix, F.lit("/job/"), escape_segment(job_id)))
    )


def escape_segment(c: Column) -> Column:
    """Percent-encode one path segment (blank encodes as %20, not '+')."""
    text = F.url_encode(trim_space(F.coalesce(c, F.lit(""))))
    return F.replace(F.replace(F.replace(text, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")),
                     F.lit("*"), F.lit("%2A"))

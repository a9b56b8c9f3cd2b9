"""Arrow-batched walk over JSON payloads of unknown nesting.

Spark has no operator for "every object at any depth, in document order", so this one step runs in
Python. It only picks fields; all cleaning, joining and deduplication stays in column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F


def _load(text: str | None):
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def objects(root) -> Iterator[dict]:
    """Every object, parents before children, in document order."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack.extend(reversed(node.values()))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def find_key(root, key: str):
    """Value of the first object holding `key`; an object's own key comes before its children."""
    return next((node[key] for node in objects(root) if key in node), None)


def first_string(node, keys: list[str], nested: tuple[str, ...] = ()) -> str | None:
    """First string among `keys`; an object value is searched by the `nested` keys; numbers are passed over."""
    if not isinstance(node, dict):
        return None
    for key in keys:
        value = node.get(key)
        if isinstance(value, str):
            return value
        if nested and isinstance(value, dict):
            inner = first_string(value, list(nested), nested)
            if inner and inner.strip():
                return inner
    return None


def _strings(values) -> list[str]:
    return [" ".join(v.split()) for v in values if isinstance(v, str) and v.strip()]


# The keys each payload family uses, in order of preference.
LISTING_KEYS = {
    "title": ["title", "jobTitle", "titulo"],
    "url": ["url", "jobUrl", "link"],
    "company": ["company", "companyName", "employer", "nomeEmpresa"],
    "location_text": ["location", "locationText", "cidade", "localizacao"],
    "salary_text": ["salary", "salaryText", "remuneration"],
    "work_mode_text": ["workMode", "modality", "modeloTrabalho"],
    "source_job_id": ["jobId", "id", "sourceJobId"],
}
LISTING_DATES = ["postedAt", "publishedAt", "publicationDate"]
GUPY_DATES = ["publishedAt", "createdAt", "datePublished"]
WORKDAY_DATES = ["postedOn", "postedOnDate", "postedDate", "postedDateTime"]
LISTING_NESTED = ("name", "value", "text")
JSONLD_NESTED = ("name", "value", "@id")
WORKDAY_NESTED = ("name", "value", "label", "text")


def listing_rows(root) -> Iterator[dict]:
    """Objects of an embedded page-state block that carry a title and a link."""
    for node in objects(root):
        row = {out: first_string(node, keys, LISTING_NESTED) for out, keys in LISTING_KEYS.items()}
        if row["title"] and row["url"]:
            yield {**row, "dates": [node.get(k) for k in LISTING_DATES]}


def listing_jsonld_rows(root) -> Iterator[dict]:
    """Structured-data postings as a listing page uses them."""
    for node in objects(root):
        if (first_string(node, ["@type", "type"], LISTING_NESTED) or "").lower() != "jobposting":
            continue
        yield {
            "title": first_string(node, ["title"], LISTING_NESTED),
            "url": first_string(node, ["url"], LISTING_NESTED),
            "company": first_string(node.get("hiringOrganization"), ["name"]),
            "location_text": first_string(node, ["jobLocation", "address", "location"], LISTING_NESTED),
            "salary_text": first_string(node, ["baseSalary"], LISTING_NESTED),
            "dates": [node.get("datePosted")],
        }


def _place(node) -> str:
    address = node.get("address") if isinstance(node, dict) else None
    keys = ("addressLocality", "addressRegion", "addressCountry")
    parts = _strings(first_string(address, [k], JSONLD_NESTED) for k in keys)
    return ", ".join(parts) or " ".join(_strings([first_string(node, ["name"], JSONLD_NESTED)]))


def jsonld_rows(root) -> Iterator[dict]:
    """schema.org JobPosting objects."""
    for node in objects(root):
        kinds = node.get("@type")
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(isinstance(k, str) and k.lower() == "jobposting" for k in kinds):
            continue
        places = node.get("jobLocation")
        places = places if isinstance(places, list) else [places]
        remote = first_string(node.get("applicantLocationRequirements"), ["name"], JSONLD_NESTED)
        identifier = node.get("identifier")
        if not isinstance(identifier, str):
            identifier = first_string(identifier, ["value", "name"], JSONLD_NESTED)
        yield {
            "title": first_string(node, ["title"], JSONLD_NESTED),
            "url": first_string(node, ["url"], JSONLD_NESTED),
            "company": first_string(node.get("hiringOrganization"), ["name", "legalName"], JSONLD_NESTED),
            "location_text": " | ".join(filter(None, map(_place, places))) or remote,
            "source_job_id": identifier,
            "description": first_string(node, ["description"], JSONLD_NESTED),
            "employment_text": first_string(node, ["employmentType"], JSONLD_NESTED),
            "work_mode_text": first_string(node, ["jobLocationType"], JSONLD_NESTED),
            "dates": [node.get("datePosted"), node.get("validFrom")],
        }


def gupy_rows(root) -> Iterator[dict]:
    """Objects with an id and a name, as Gupy payloads list postings."""
    for node in objects(root):
        job_id = first_string(node, ["id", "jobId", "code", "slug"])
        if job_id is None:
            numbers = (node.get(k) for k in ("id", "jobId"))
            job_id = next((str(n) for n in numbers if isinstance(n, int) and not isinstance(n, bool)), None)
        title = first_string(node, ["name", "title", "jobTitle"])
        if not (job_id and job_id.strip() and title and title.strip()):
            continue
        workplace = node.get("workplace") if isinstance(node.get("workplace"), dict) else {}
        address = workplace.get("address")
        parts = [first_string(address, keys) for keys in (["city"], ["stateShortName", "state"], ["country"])]
        location = first_string(node, ["location", "locationText", "city"])
        if location is None:
            location = ", ".join(p for p in parts if p and p.strip()) or first_string(workplace, ["workplaceType"])
        yield {
            "title": title.strip(),
            "url": first_string(node, ["jobUrl", "url", "absoluteUrl"]),
            "location_text": location,
            "source_job_id": job_id,
            "description": first_string(node, ["description", "jobDescription"]),
            "work_mode_text": first_string(workplace, ["workplaceType"]),
            "dates": [node.get(k) for k in GUPY_DATES],
        }


def workday_rows(root) -> Iterator[dict]:
    """Entries of the first jobPostings list."""
    postings = find_key(root, "jobPostings")
    for item in postings if isinstance(postings, list) else []:
        if not isinstance(item, dict):
            continue
        listed = item.get("locations") if isinstance(item.get("locations"), list) else []
        names = [v if isinstance(v, str) else first_string(v, ["name", "location"], WORKDAY_NESTED) for v in listed]
        bullets = item.get("bulletFields") if isinstance(item.get("bulletFields"), list) else []
        choices = [
            first_string(item, ["locationsText", "location"], WORKDAY_NESTED),
            " | ".join(n.strip() for n in names if n and n.strip()),
            next((b for b in bullets if isinstance(b, str) and b.strip() and ("," in b or "-" in b)), None),
        ]
        yield {
            "title": first_string(item, ["title", "jobTitle"], WORKDAY_NESTED),
            "external_path": first_string(item, ["externalPath"], WORKDAY_NESTED),
            "location_text": next((c.strip() for c in choices if c and c.strip()), "Unknown"),
            "employment_text": first_string(item, ["timeType", "employmentType", "workerSubType"], WORKDAY_NESTED),
            "source_job_id": first_string(
                item, ["id", "jobReqId", "jobRequisitionId", "requisitionId"], WORKDAY_NESTED),
            "url": first_string(item, ["id", "jobReqId", "requisitionId"], WORKDAY_NESTED),
            "dates": [first_string(item, WORKDAY_DATES, WORKDAY_NESTED)],
        }


def description_rows(root) -> Iterator[dict]:
    """Every description text anywhere in a detail payload."""
    for node in objects(root):
        for key in ("jobDescription", "description", "jobDescriptionHtml"):
            if isinstance(node.get(key), str):
                yield {"description": node[key]}


def object_rows(root) -> Iterator[dict]:
    """Every object itself, as JSON text."""
    for node in objects(root):
        yield {"description": json.dumps(node, ensure_ascii=False, separators=(",", ":"))}


FIELDS = ["title", "url", "company", "location_text", "source_job_id", "description", "employment_text",
          "work_mode_text", "salary_text", "external_path"]
ROW_TYPE = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",dates:array<string>>>"


def _shape(row: dict) -> dict:
    out = {f: row[f] for f in FIELDS if row.get(f) is not None}
    out["dates"] = [d if isinstance(d, str) else None for d in row.get("dates", [])]
    return out


def pick_rows(rows: Callable, blocks: Column, first_hit: bool = False) -> Column:
    """Rows found in an array of JSON texts, in order; with `first_hit` only those of the first text that has any.

    Texts that are not JSON give no rows. Rows come back as one JSON text per input row, which Arrow moves
    and the JVM parses much faster than nested values.
    """

    @F.pandas_udf("string")
    def walk(batch: pd.Series) -> pd.Series:
        def one(texts):
            found: list[dict] = []
            for text in texts if texts is not None else []:
                found.extend(_shape(r) for r in rows(_load(text)))
                if found and first_hit:
                    break
            return json.dumps(found) if found else None

        return batch.map(one)

    return F.from_json(walk(blocks), ROW_TYPE)

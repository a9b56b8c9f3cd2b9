"""Plain sequential statement of the matching and merge rules, used as the truth in property tests."""

from __future__ import annotations

import hashlib
import re
import unicodedata

FILL = ("company_website", "company_industry")
ENUMS = ("work_mode", "seniority", "employment_type")


def blank(x):
    return x is None or not x.strip()


def norm(s):
    s = unicodedata.normalize("NFD", (s or "").strip().lower())
    s = "".join(c for c in s if unicodedata.category(c) != "Mn")
    return re.sub(r"[^\w\s]|_", " ", s).strip()


def print_of(r):
    text = "|".join(" ".join(norm(r[c]).split(" ")) for c in ("company_name", "title", "location_text", "work_mode"))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def better(cur, new):
    return not blank(new) and (blank(cur) or len(new) > len(cur) + 40)


def union(cur, new):
    return list(dict.fromkeys(t.strip().lower() for t in [*cur, *new] if not blank(t)))


def filled(e):
    return sum(e[f"salary_{p}"] is not None for p in ("min", "max", "currency", "period"))


def clash(state, me, r):
    for e in state:
        if e is me:
            continue
        if not blank(r["source_url"]) and e["source_url"] == r["source_url"]:
            return True
        if not blank(r["source_job_id"]) and all(e[c] == r[c] for c in ("source_type", "source_name", "source_job_id")):
            return True
        if not blank(r["origin_url"]) and e["origin_url"] == r["origin_url"]:
            return True
    return False


def find(state, r, policy):
    order = sorted(state, key=lambda e: (e["_seq"] >= 0, e["captured_at"] if e["_seq"] < 0 else 0, e["id"] if e["_seq"] < 0 else "", e["_seq"]))
    tests = []
    if policy == "bulk" and not blank(r["origin_url"]):
        tests.append(lambda e: e["origin_url"] == r["origin_url"])
    if not blank(r["source_job_id"]):
        tests.append(lambda e: all(e[c] == r[c] for c in ("source_type", "source_name", "source_job_id")))
    if not blank(r["source_url"]):
        tests.append(lambda e: e["source_url"] == r["source_url"])
    if policy == "bulk":
        tests.append(lambda e: e["fingerprint"] == r["fingerprint"])
    for t in tests:
        hit = next((e for e in order if t(e)), None)
        if hit:
            return hit
    return None


def run(state, records, policy):
    """Apply records in order; returns outcomes by seq and leaves the result in `state`."""
    out = {}
    for r in records:
        e = find(state, r, policy)
        if e is None:
            state.append({**r, "_seq": r["seq"], "tags": union([], r["tags"])})
            out[r["seq"]] = (r["id"], "Inserted", True)
            continue
        want = dict(e)
        for c in ("source_name", "source_type", "source_url"):
            want[c] = r[c]
        if policy == "crawl":
            want["source_job_id"] = r["source_job_id"]
        elif e["source_job_id"] is None:
            want["source_job_id"] = r["source_job_id"]
        if policy == "bulk" and e["origin_url"] is None:
            want["origin_url"] = r["origin_url"]
        if clash(state, e, want):
            out[r["seq"]] = (e["id"], "Conflict", False)
            continue
        real = formal = False
        if policy == "bulk":
            real |= want["origin_url"] != e["origin_url"]
        if better(e["description_text"], r["description_text"]):
            want["description_text"], real = r["description_text"], True
        tags = union(e["tags"], r["tags"])
        if tags != e["tags"]:
            want["tags"], real = tags, True
        if policy == "bulk":
            for c in FILL:
                if blank(e[c]) and not blank(r[c]):
                    want[c], real = r[c], True
            for c in ENUMS:
                if e[c] == "Unknown":
                    formal |= r[f"_given_{c}"]
                    real |= r[c] != "Unknown"
                    want[c] = r[c]
            if e["posted_at"] is None and r["posted_at"] is not None:
                want["posted_at"], real = r["posted_at"], True
            want["metadata"] = {**e["metadata"], **r["metadata"]}
            if not (real or formal):
                want["captured_at"] = r["captured_at"]
        else:
            if filled(r) > filled(e):
                real = True
                for p in ("min", "max", "currency", "period"):
                    want[f"salary_{p}"] = r[f"salary_{p}"]
            if r["posted_at"] is not None and (e["posted_at"] is None or r["posted_at"] < e["posted_at"]):
                want["posted_at"], real = r["posted_at"], True
            if r["fingerprint"] != e["fingerprint"]:
                want["fingerprint"], real = r["fingerprint"], True
            if r["captured_at"] != e["captured_at"]:
                want["captured_at"], formal = r["captured_at"], True
            want["metadata"] = r["metadata"]
        want["last_seen_at"], want["status"] = r["last_seen_at"], "Active"
        e.update(want)
        out[r["seq"]] = (e["id"], "Updated" if real or formal else "Duplicate", bool(real))
    return out

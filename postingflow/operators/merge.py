"""Field-level merge of incoming records into postings, for the crawl and the bulk policy.

Matching (`resolve_entities`) decides where each record goes; here every field is one aggregate over a
posting's records, and per-record outcomes come from two-level prefix scans. No step gathers the records
of a posting: what is collected per posting is bounded by its distinct text lengths, tags or metadata keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.identity import fingerprint
from postingflow.functions.infer import parse_enum
from postingflow.functions.text import is_blank, normalize_tags, null_if_blank
from postingflow.operators.resolve import resolve_entities
from postingflow.operators.scan import prefix_scan
from postingflow.schema import STATE_COLUMNS, STATE_SCHEMA
from postingflow.session import cut_lineage

# A text replaces the stored one only when it is this much longer.
BETTER_BY = 40


def better_text(current: Column, new: Column) -> Column:
    """Whether `new` should replace `current`."""
    return ~is_blank(new) & (is_blank(current) | (F.length(new) > F.length(current) + BETTER_BY))


def merge_metadata(old: Column, new: Column) -> Column:
    """Shallow union; incoming keys win; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    fresh = F.coalesce(new, empty)
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_concat(kept, fresh)


def stamp_origin(metadata: Column, origin_url: Column) -> Column:
    """Metadata with the origin URL noted, when there is one."""
    note = F.when(~is_blank(origin_url), F.create_map(F.lit("originUrl"), origin_url))
    return merge_metadata(metadata, note)


def salary_filled(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """How many of the four salary fields are present."""
    present = [low.isNotNull(), high.isNotNull(), ~is_blank(currency), ~is_blank(period)]
    return sum((p.cast("int") for p in present[1:]), present[0].cast("int"))


def bulk_records(items: DataFrame, now: Column, compat: bool = False) -> DataFrame:
    """Bulk items (already valid, with seq) in the state layout.

    The fingerprint uses the parsed work mode; `compat` keeps the raw text there instead.
    """
    mode = parse_enum(F.col("work_mode"), "WorkMode")
    raw_mode = F.coalesce("work_mode", F.lit(""))
    none = F.lit(None).cast("string")
    fields = {
        "id": F.col("new_id") if "new_id" in items.columns else F.uuid(),
        "source_name": F.col("source_name"),
        "source_type": parse_enum(F.col("source_type"), "SourceType", "ExternalIngestion"),
        "source_url": F.coalesce(null_if_blank(F.col("source_url")), F.col("origin_url")),
        "source_job_id": F.col("source_job_id"),
        "origin_url": null_if_blank(F.col("origin_url")),
        "title": F.col("title"), "company_name": F.col("company_name"),
        "company_website": null_if_blank(F.col("company_website")),
        "company_industry": null_if_blank(F.col("company_industry")),
        "location_text": F.coalesce("location_text", F.lit("")),
        "country": none, "state": none, "city": none,
        "work_mode": mode,
        "seniority": parse_enum(F.col("seniority"), "Seniority"),
        "employment_type": parse_enum(F.col("employment_type"), "EmploymentType"),
        "salary_min": F.lit(None), "salary_max": F.lit(None), "salary_currency": none, "salary_period": none,
        "description_text": F.coalesce("description_text", F.lit("")),
        "tags": normalize_tags(F.col("tags")),
        "languages": F.coalesce("languages", F.array().cast("array<string>")),
        "posted_at": F.col("posted_at"), "captured_at": now, "last_seen_at": now, "status": F.lit("Active"),
        "fingerprint": fingerprint(F.col("company_name"), F.col("title"), F.coalesce("location_text", F.lit("")),
                                   raw_mode if compat else F.when(is_blank(raw_mode), F.lit("")).otherwise(mode)),
        "cluster_id": none,
        "metadata": stamp_origin(F.col("metadata"), F.col("origin_url")),
    }
    given = {f"_given_{c}": ~is_blank(F.col(c)) for c in ("work_mode", "seniority", "employment_type")}
    return items.select("seq", *[c.alias(n) for n, c in given.items()], *[
        fields[f.name].cast(f.dataType).alias(f.name) for f in STATE_SCHEMA.fields])


def _first(c: str, present: Column | None = None) -> Column:
    held = F.col(c).isNotNull() if present is None else present
    return F.min_by(c, F.when(held, F.col("seq"))).alias(c)


def _last(c: str) -> Column:
    return F.max_by(c, "seq").alias(c)


def _text_winners(lengths: DataFrame, span: int) -> DataFrame:
    """Records whose text was taken, per posting: each longer than the one before it by the margin.

    Only a text strictly longer than all before it can be taken. A scan of running maxima, by chunks, leaves these; in records
    of random order they are about the logarithm of their number, and never more than there are lengths. The margin is
    applied to what is left.
    """
    firsts = lengths.groupBy("ent", "len").agg(F.min("seq").alias("seq"))
    scanned = prefix_scan(firsts, ["ent"], "seq", {"_longest": ("max", F.col("len"))}, span=span)
    rising = scanned.filter(F.col("_longest").isNull() | (F.col("len") > F.col("_longest")))
    ordered = rising.groupBy("ent").agg(F.array_sort(F.collect_list(F.struct("seq", "len"))).alias("steps"))
    start = F.array().cast("array<struct<seq:bigint,len:int>>")

    def step(taken: Column, row: Column) -> Column:
        last = F.coalesce(F.try_element_at(taken, F.lit(-1))["len"], F.lit(-BETTER_BY - 1))
        return F.when(row["len"] > last + BETTER_BY, F.concat(taken, F.array(row))).otherwise(taken)

    taken = ordered.select("ent", F.aggregate("steps", start, step).alias("taken"))
    return taken.select("ent", F.explode("taken").alias("_t")).select("ent", F.col("_t.seq").alias("seq"))


def _tag_firsts(records: DataFrame) -> DataFrame:
    exploded = records.select("ent", "seq", F.posexplode(normalize_tags(F.col("tags"))).alias("pos", "tag"))
    return exploded.groupBy("ent", "tag").agg(F.min(F.struct("seq", "pos")).alias("at"))


def merge_records(records: DataFrame, state: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """Fold records (state layout plus seq) into the state.

    Returns (postings, outcomes): the touched postings after the fold, and one row per record with
    seq, id, outcome (Inserted, Updated, Duplicate or Conflict) and content_changed, which leaves out
    changes of capture time and of unreadable enum texts.
    """
    bulk = policy == "bulk"
    assigned = cut_lineage(resolve_entities(records, state, policy))
    span = assigned.agg(F.max("seq")).first()[0]
    placed = records.join(assigned, "seq")
    owners = assigned.filter(F.col("ok") & F.col("ent").startswith("s:")).select("ent").distinct()
    stored = state.withColumns({"ent": F.concat(F.lit("s:"), F.col("id")), "seq": F.lit(-1).cast("long")}).join(
        owners, "ent", "left_semi")
    extra = [c for c in records.columns if c.startswith("_given_")]
    stored = stored.withColumns({c: F.lit(False) for c in extra})
    columns = ["ent", "seq", *extra, *STATE_COLUMNS]
    # Maps cannot be part of wide shuffles keyed by value; they travel as entries until the end.
    rows = placed.filter("ok").select(*columns).unionByName(stored.select(*columns)).withColumn(
        "metadata", F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    rows = cut_lineage(rows)

    narrow = rows.select(
        "ent", "seq", *extra, "work_mode", "seniority", "employment_type", "posted_at", "captured_at", "fingerprint",
        F.col("origin_url").isNotNull().alias("_org"), F.col("company_website").isNotNull().alias("_web"),
        F.col("company_industry").isNotNull().alias("_ind"),
        salary_filled(*[F.col(f"salary_{p}") for p in ("min", "max", "currency", "period")]).alias("_filled"),
        (F.size(normalize_tags(F.col("tags"))) > 0).alias("_tagged"),
        (F.col("tags") != normalize_tags(F.col("tags"))).alias("_untidy"),
    )
    enums = ["work_mode", "seniority", "employment_type"]
    specs = {"_any": ("min", F.col("seq")), "_was_untidy": ("max", F.col("_untidy"))}
    if bulk:
        specs |= {f"_had{c}": ("max", F.col(c)) for c in ("_org", "_web", "_ind")}
        specs |= {f"_known_{e}": ("max", F.col(e) != "Unknown") for e in enums}
        specs |= {"_had_posted": ("max", F.col("posted_at").isNotNull()),
                  "_tidied": ("max", (F.col("seq") >= 0) & F.col("_tagged"))}
    else:
        specs |= {"_prev_captured": ("last", F.col("captured_at")), "_prev_print": ("last", F.col("fingerprint")),
                  "_prev_posted": ("min", F.col("posted_at")), "_prev_filled": ("max", F.col("_filled")),
                  "_tidied": ("max", F.col("_any_item"))}
        narrow = narrow.withColumn("_any_item", F.col("seq") >= 0)
    seen = prefix_scan(narrow, ["ent"], "seq", specs, span=span)

    texts = rows.filter(~is_blank(F.col("description_text"))).select("ent", "seq", F.length("description_text").alias("len"))
    winners = cut_lineage(_text_winners(texts, span))
    firsts = cut_lineage(_tag_firsts(rows))

    def had(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    untidy = had("_was_untidy") & ~had("_tidied")
    if bulk:
        real = [F.col(c) & ~had(f"_had{c}") for c in ("_org", "_web", "_ind")]
        real += [(F.col(e) != "Unknown") & ~had(f"_known_{e}") for e in enums]
        real += [F.col("posted_at").isNotNull() & ~had("_had_posted"), untidy & F.col("_tagged")]
        formal = [F.col(f"_given_{e}") & ~had(f"_known_{e}") for e in enums]
    else:
        real = [
            F.col("posted_at").isNotNull() & (F.col("_prev_posted").isNull() | (F.col("posted_at") < F.col("_prev_posted"))),
            F.col("_filled") > F.coalesce("_prev_filled", F.lit(0)),
            F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("_prev_print")),
            untidy,
        ]
        formal = [~F.col("captured_at").eqNullSafe(F.col("_prev_captured"))]

    def either(flags: list[Column]) -> Column:
        return F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))

    flagged = (
        seen.join(winners.select("seq", "ent", F.lit(True).alias("_text")), ["seq", "ent"], "left")
        .join(firsts.select(F.col("at.seq").alias("seq"), "ent").distinct().withColumn("_tag", F.lit(True)), ["seq", "ent"], "left")
        .filter(F.col("seq") >= 0)
        .withColumn("content_changed", either([*real, F.col("_text"), F.col("_tag")]))
        .withColumn("outcome", F.when(F.col("_any").isNull(), "Inserted").when(
            F.col("content_changed") | either(formal), "Updated").otherwise("Duplicate"))
        .select("ent", "seq", "outcome", "content_changed", "captured_at")
    )
    flagged = cut_lineage(flagged)

    postings = _fold(rows, winners, firsts, flagged, bulk).select(*STATE_COLUMNS)
    born = rows.filter(F.col("ent") == F.concat(F.lit("n:"), F.col("seq"))).select("seq", F.col("id").alias("_born"))
    outcomes = (
        assigned.join(flagged.select("seq", "outcome", "content_changed"), "seq", "left")
        .withColumn("_root", F.when(F.col("ent").startswith("n:"), F.substring("ent", 3, 20).cast("long")))
    )
    from postingflow.operators.scan import spread_join
    named = spread_join(outcomes, born.withColumnRenamed("seq", "_root"), ["_root"], "left", rows=span + 1)
    outcomes = named.select(
        "seq", F.coalesce("_born", F.expr("substring(ent, 3)")).alias("id"),
        F.coalesce("outcome", F.lit("Conflict")).alias("outcome"),
        F.coalesce("content_changed", F.lit(False)).alias("content_changed"))
    return postings, outcomes


def _fold(rows: DataFrame, winners: DataFrame, firsts: DataFrame, flagged: DataFrame, bulk: bool) -> DataFrame:
    """One row per posting from all its records."""
    keep = ["id", "title", "company_name", "location_text", "country", "state", "city", "languages", "cluster_id"]
    last = ["source_name", "source_type", "source_url"]
    salary = ["salary_min", "salary_max", "salary_currency", "salary_period"]
    filled = salary_filled(*[F.col(c) for c in salary])
    aggs = [
        F.min_by(F.struct(*keep), "seq").alias("_keep"),
        F.max_by(F.struct(*last), "seq").alias("_last"),
        F.max_by("last_seen_at", "seq").alias("last_seen_at"),
    ]
    if bulk:
        known = {e: F.col(e) != "Unknown" for e in ("work_mode", "seniority", "employment_type")}
        aggs += [_first(c) for c in ("source_job_id", "origin_url", "company_website", "company_industry", "posted_at")]
        aggs += [F.coalesce(F.min_by(e, F.when(k, F.col("seq"))), F.lit("Unknown")).alias(e) for e, k in known.items()]
        aggs += [F.min_by(F.struct("fingerprint", *salary), "seq").alias("_fixed")]
        fixed = {c: F.col(f"_fixed.{c}") for c in ("fingerprint", *salary)}
    else:
        held = ["origin_url", "company_website", "company_industry", "work_mode", "seniority", "employment_type"]
        aggs += [
            _last("source_job_id"), F.min("posted_at").alias("posted_at"),
            F.max_by("fingerprint", F.when(~is_blank(F.col("fingerprint")), F.col("seq"))).alias("fingerprint"),
            F.min_by(F.struct(*held), "seq").alias("_held"),
            F.max_by(F.struct(*salary), F.struct(filled.alias("n"), (-F.col("seq")).alias("s"))).alias("_salary"),
            _last("metadata"), _last("captured_at"),
        ]
        fixed = {**{c: F.col(f"_held.{c}") for c in held}, **{c: F.col(f"_salary.{c}") for c in salary},
                 "metadata": F.map_from_entries("metadata")}
    out = rows.groupBy("ent").agg(*aggs).withColumns(fixed).withColumns(
        {**{c: F.col(f"_keep.{c}") for c in keep}, **{c: F.col(f"_last.{c}") for c in last}, "status": F.lit("Active")})

    final = winners.groupBy("ent").agg(F.max("seq").alias("seq"))
    texts = rows.select("ent", "seq", "description_text").join(final, ["ent", "seq"]).select("ent", "description_text")
    tags = firsts.groupBy("ent").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("_t")).select(
        "ent", F.col("_t.tag").alias("tags"))
    out = out.join(texts, "ent", "left").join(tags, "ent", "left").withColumns({
        "description_text": F.coalesce("description_text", F.lit("")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
    })
    if bulk:
        entries = rows.select("ent", "seq", F.explode("metadata").alias("_e"))
        latest = entries.groupBy("ent", F.col("_e.key").alias("key")).agg(F.max_by("_e.value", "seq").alias("value"))
        maps = latest.groupBy("ent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
        # Capture time moves only when a record changed nothing.
        touched = flagged.filter(F.col("outcome") != "Updated").groupBy("ent").agg(F.max_by("captured_at", "seq").alias("_cap"))
        stored = rows.filter(F.col("seq") < 0).select("ent", F.col("captured_at").alias("_old"))
        out = out.join(maps, "ent", "left").join(touched, "ent", "left").join(stored, "ent", "left").withColumns({
            "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
            "captured_at": F.coalesce("_cap", "_old"),
        })
    return out


def apply_to_state(state: DataFrame, postings: DataFrame) -> DataFrame:
    """The state after a merge: untouched rows as they are, touched ones replaced, new ones added."""
    untouched = state.join(postings.select("id"), "id", "left_anti")
    return untouched.select(*STATE_COLUMNS).unionByName(postings.select(*STATE_COLUMNS))


def key_conflicts(state: DataFrame) -> DataFrame:
    """Unique keys held by more than one posting: kind, key, n."""
    pairs = F.array(
        F.struct(F.lit("source_url").alias("kind"), null_if_blank(F.col("source_url")).alias("key")),
        F.struct(F.lit("origin_url").alias("kind"), null_if_blank(F.col("origin_url")).alias("key")),
        F.struct(F.lit("source_job_id").alias("kind"), F.when(F.col("source_job_id").isNotNull(), F.concat_ws(
            "|", "source_type", "source_name", "source_job_id")).alias("key")),
    )
    rows = state.select(F.explode(pairs).alias("_p")).select("_p.kind", "_p.key").filter(F.col("key").isNotNull())
    return rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)

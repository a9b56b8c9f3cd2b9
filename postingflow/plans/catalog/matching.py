"""Queries over matching, merging and the posting lifecycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from postingflow.functions.identity import fingerprint
from postingflow.operators import dedupe, lifecycle as lc, merge, posting, similar
from postingflow.operators.scan import number_rows
from postingflow.plans.bulk import run_bulk
from postingflow.plans.catalog.common import WS, pick, registrar, s_norm, s_pick, s_print, s_trim, table
from postingflow.plans.catalog.extraction import HOST, documents_as_jsonld, registry
from postingflow.plans.crawl import run_crawl
from postingflow.schema import STATE_COLUMNS, STATE_SCHEMA

QUERIES, query = registrar()

DAY = "2024-05-01"


def day(offset=None):
    start = F.lit(DAY).cast("timestamp")
    return start if offset is None else start + F.make_interval(days=offset.cast("int"))


def as_state(df, **columns):
    """State layout from a few columns; the rest take plain defaults."""
    defaults = {
        "company_name": F.lit("c"), "location_text": F.lit(""), "work_mode": F.lit("Unknown"), "seniority": F.lit("Unknown"),
        "employment_type": F.lit("Unknown"), "description_text": F.lit(""), "tags": F.array(), "languages": F.array(),
        "status": F.lit("Active"), "captured_at": day(), "last_seen_at": day(), "metadata": F.create_map(),
    }
    values = {**defaults, **columns}
    keep = [c for c in df.columns if c == "seq"]
    return df.select(*keep, *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA.fields])


# Documents as sightings of 50 roles: one fingerprint and source id per role, own URL per document.
def sightings(spark, folder):
    key = F.col("doc_id")
    df = table(spark, folder, "documents").withColumns({"seq": key, "role": (key % 50).cast("string")})
    title = F.concat(F.lit("Rôle "), F.col("role"))
    return as_state(
        df, id=F.concat(F.lit("p"), key.cast("string")), title=title, source_name=F.col("source"), source_type=F.lit("Gupy"),
        source_url=F.concat(F.lit(f"{HOST}/"), key.cast("string")), location_text=F.lit("x"),
        description_text=F.coalesce("text", F.lit("")),
        tags=F.array(F.concat(F.lit("t"), ((key * 7) % 9).cast("string"))),
        work_mode=F.when((key * 3) % 16 == 5, "Remote").otherwise("Unknown"),
        posted_at=F.when(key % 4 != 1, day((key * 13) % 90)), captured_at=day(), last_seen_at=day(),
        fingerprint=fingerprint(F.lit("c"), title, F.lit("x"), F.lit("")), metadata=F.create_map(F.lit("last"), key.cast("string")))


def split(df, n: int = 7):
    """(stored, incoming): of each role the first document whose number ``n`` divides is stored; all other documents come in."""
    firsts = df.filter(F.col("seq") % n == 0).groupBy("fingerprint").agg(F.min("seq").alias("seq")).select("seq")
    stored = df.join(firsts, "seq", "left_semi").withColumn("captured_at", F.col("captured_at") - F.make_interval(days=F.lit(30)))
    return stored.select(*STATE_COLUMNS), df.join(firsts, "seq", "left_anti")


def _taken(source: str, group: str, seq: str, text: str) -> str:
    """The records of a group whose text is taken, each longer than the one taken before it by more than 40: group, t.seq, t.len."""
    return f"""(SELECT {group}, unnest(list_reduce(list_prepend([{{'seq': CAST(-2 AS BIGINT), 'len': CAST(-41 AS BIGINT)}}],
    list([{{'seq': CAST({seq} AS BIGINT), 'len': CAST(length({text}) AS BIGINT)}}] ORDER BY {seq}) FILTER ({s_trim(text)} <> '')),
    lambda a, b: CASE WHEN b[1].len > a[-1].len + 40 THEN list_concat(a, b) ELSE a END)) AS t FROM {source} GROUP BY {group})"""


_SIGHT = f"""sight AS (SELECT doc_id AS k, doc_id % 50 AS role, source, '{HOST}/' || doc_id AS url, coalesce(text, '') AS descr,
  't' || ((doc_id * 7) % 9) AS tag, CASE WHEN (doc_id * 3) % 16 = 5 THEN 'Remote' ELSE 'Unknown' END AS mode,
  CASE WHEN doc_id % 4 <> 1 THEN TIMESTAMP '{DAY}' + to_days(CAST((doc_id * 13) % 90 AS INTEGER)) END AS posted,
  {s_print("'c'", "'Rôle ' || (doc_id % 50)", "'x'", "''")} AS fp FROM documents),
rows AS (SELECT *, CASE WHEN k IN (SELECT min(k) FROM sight WHERE k % 7 = 0 GROUP BY fp) THEN -1 ELSE k END AS seq FROM sight),
c AS {_taken("rows", "fp", "seq", "descr")},
best AS (SELECT fp, descr FROM (SELECT fp, max(t.seq) AS seq FROM c GROUP BY fp) JOIN rows USING (fp, seq))"""
_BETTER = "coalesce((SELECT descr FROM best b WHERE b.fp = r.fp), '')"
_TAGS = "(SELECT string_agg(tag, ',' ORDER BY s) FROM (SELECT fp, tag, min(seq) AS s FROM rows GROUP BY fp, tag) t WHERE t.fp = r.fp)"


@query(f"""WITH {_SIGHT}
SELECT fp AS fingerprint, arg_max(url, seq) AS source_url, arg_max(source, seq) AS source_name, {_BETTER} AS description, {_TAGS} AS tags,
  CASE WHEN bool_or(mode = 'Remote') THEN 'Remote' ELSE 'Unknown' END AS work_mode,
  strftime(arg_min(posted, seq) FILTER (posted IS NOT NULL), '%Y-%m-%d') AS posted, CAST(arg_max(k, seq) AS VARCHAR) AS last_key,
  'p' || arg_min(k, seq) AS id FROM rows r GROUP BY fp""")
def merge_bulk(spark, folder):
    stored, incoming = split(sightings(spark, folder))
    records = incoming.withColumns({f"_given_{c}": F.col(c) != "Unknown" for c in ("work_mode", "seniority", "employment_type")})
    postings, _ = merge.merge_records(records, stored, "bulk")
    return postings.select(
        "fingerprint", "source_url", "source_name", F.col("description_text").alias("description"), F.array_join("tags", ",").alias("tags"),
        "work_mode", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), F.col("metadata")["last"].alias("last_key"), "id")


def crawled(spark, folder):
    """The same sightings as crawl records: one source id per role, salary of growing detail."""
    key = F.col("seq")
    filled = key % 5
    return sightings(spark, folder).withColumns({
        "source_name": F.lit("site"), "source_job_id": F.concat(F.lit("J"), (key % 50).cast("string")),
        "salary_min": F.when(filled > 0, (key % 1000).cast("decimal(18,2)")), "salary_max": F.when(filled > 1, (key % 1000 + 1).cast("decimal(18,2)")),
        "salary_currency": F.when(filled > 2, "BRL"), "salary_period": F.when(filled > 3, "month"),
    })


@query(f"""WITH {_SIGHT}
SELECT fp AS fingerprint, arg_max(url, seq) AS source_url, {_BETTER} AS description, {_TAGS} AS tags, strftime(min(posted), '%Y-%m-%d') AS posted,
  CAST(arg_max(k, seq) AS VARCHAR) AS last_key, CAST(arg_max(CASE WHEN k % 5 > 0 THEN k % 1000 END, (k % 5) * 10000000 - seq) AS BIGINT) AS salary_min,
  max(k % 5) AS salary_filled, arg_min(mode, seq) AS work_mode, 'p' || arg_min(k, seq) AS id FROM rows r GROUP BY fp""")
def merge_crawl(spark, folder):
    stored, incoming = split(crawled(spark, folder))
    postings, _ = merge.merge_records(incoming, stored, "crawl")
    filled = merge.salary_filled(*[F.col(f"salary_{p}") for p in ("min", "max", "currency", "period")])
    return postings.select(
        "fingerprint", "source_url", F.col("description_text").alias("description"), F.array_join("tags", ",").alias("tags"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), F.col("metadata")["last"].alias("last_key"),
        F.col("salary_min").cast("long").alias("salary_min"), filled.cast("long").alias("salary_filled"), "work_mode", "id")


@query(f"""WITH {_SIGHT}, o AS (SELECT *, min(seq) OVER (PARTITION BY fp) AS first_seq, min(posted) OVER w AS earlier, max(k % 5) OVER w AS filled,
    CASE WHEN lag(seq) OVER (PARTITION BY fp ORDER BY seq) < 0 THEN 1 ELSE 0 END AS after_stored, row_number() OVER (PARTITION BY fp, tag ORDER BY seq) AS tag_seen
  FROM rows WINDOW w AS (PARTITION BY fp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o.k AS seq, CASE WHEN o.seq = first_seq THEN 'Inserted' WHEN after_stored = 1 OR tag_seen = 1 OR c.t IS NOT NULL OR (posted IS NOT NULL AND (earlier IS NULL OR posted < earlier))
  OR k % 5 > filled THEN 'Updated' ELSE 'Duplicate' END AS outcome FROM o LEFT JOIN c ON c.fp = o.fp AND c.t.seq = o.seq WHERE o.seq >= 0""")
def crawl_outcomes(spark, folder):
    stored, incoming = split(crawled(spark, folder))
    _, outcomes = merge.merge_records(incoming, stored, "crawl")
    return outcomes.select("seq", "outcome")


def linked_orders(spark, folder):
    """Orders as items whose keys overlap irregularly, so that arrival order decides."""
    key = F.col("o_orderkey")
    df = table(spark, folder, "orders").withColumn("seq", key)
    cust = F.col("o_custkey").cast("string")

    def some(base, modulus, when):
        return F.when(when, F.concat(cust, F.lit(base), (key % modulus).cast("string")))

    title = F.concat(cust, F.lit(" "), F.col("o_orderstatus"))
    return as_state(
        df, id=F.concat(F.lit("o"), key.cast("string")), title=title, source_name=F.col("o_orderstatus"), source_type=F.lit("Gupy"),
        source_url=F.coalesce(some("u", 3, key % 3 > 0), F.concat(F.lit("only"), key.cast("string"))), source_job_id=some("j", 2, key % 5 == 0),
        origin_url=some("o", 4, key % 7 == 0), fingerprint=fingerprint(F.lit("c"), title, F.lit(""), F.lit(""))), df


@query()
def arrival_order_outcomes(spark, folder):
    records, _ = linked_orders(spark, folder)
    given = records.withColumns({f"_given_{c}": F.lit(False) for c in ("work_mode", "seniority", "employment_type")})
    _, outcomes = merge.merge_records(given, spark.createDataFrame([], STATE_SCHEMA), "bulk")
    return outcomes.select("seq", "id", "outcome", "content_changed")


_KEYS = f"""m AS (SELECT doc_id AS k, 'src' || doc_id % 3 AS name, CASE WHEN doc_id % 4 = 1 THEN 'o' || doc_id // 8 END AS o, CASE WHEN doc_id % 3 = 0 THEN 'j' || doc_id // 12 END AS j,
  'u' || doc_id // 2 AS u, {s_print("'c'", "text", "''", "''")} AS fp FROM documents)"""


def _keyed(spark, folder):
    key = F.col("doc_id")
    df = table(spark, folder, "documents").withColumn("seq", key)
    whole = lambda d: F.floor(key / d).cast("string")
    keyed = as_state(
        df, id=F.lpad(key.cast("string"), 9, "0"), source_name=F.concat(F.lit("src"), (key % 3).cast("string")), source_type=F.lit("Gupy"),
        origin_url=F.when(key % 4 == 1, F.concat(F.lit("o"), whole(8))), source_job_id=F.when(key % 3 == 0, F.concat(F.lit("j"), whole(12))),
        source_url=F.concat(F.lit("u"), whole(2)), fingerprint=fingerprint(F.lit("c"), F.col("text"), F.lit(""), F.lit("")))
    return keyed.filter("seq % 2 = 1"), keyed.filter("seq % 2 = 0").drop("seq")


def _sql_match(conditions: list[str]) -> str:
    tests = ", ".join(f"(SELECT min(k) FROM m s WHERE s.k % 2 = 0 AND {c})" for c in conditions)
    return f"WITH {_KEYS} SELECT k AS seq, lpad(CAST(coalesce({tests}) AS VARCHAR), 9, '0') AS match_id FROM m WHERE k % 2 = 1"


_TRIPLE = "s.j = m.j AND s.name = m.name"


@query(_sql_match(["s.o = m.o", _TRIPLE, "s.u = m.u", "s.fp = m.fp"]))
def match_bulk(spark, folder):
    incoming, state = _keyed(spark, folder)
    return dedupe.match_bulk(incoming, state).select("seq", "match_id")


@query(_sql_match([_TRIPLE, "s.u = m.u"]))
def match_crawl(spark, folder):
    incoming, state = _keyed(spark, folder)
    return dedupe.match_crawl(incoming, state).select("seq", "match_id")


@query(f"""WITH {_KEYS}, x AS (SELECT 'source_url' AS kind, u AS key FROM m UNION ALL SELECT 'origin_url', o FROM m WHERE o IS NOT NULL
  UNION ALL SELECT 'source_job_id', 'Gupy|' || name || '|' || j FROM m WHERE j IS NOT NULL)
SELECT kind, key, count(*) AS n FROM x GROUP BY kind, key HAVING count(*) > 1""")
def unique_key_conflicts(spark, folder):
    a, b = _keyed(spark, folder)
    return merge.key_conflicts(a.drop("seq").unionByName(b))


@query(f"""WITH t AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 4 = 1 THEN p_name || repeat('x', 40) WHEN p_partkey % 4 = 2 THEN p_name || repeat('x', 41) ELSE p_brand END AS b FROM part)
SELECT p_partkey, trim(b) <> '' AND length(b) > length(a) + 40 AS better, 'a=1;k=' || CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END || CASE WHEN p_partkey % 3 = 0 THEN ';originUrl=o' ELSE '' END AS metadata FROM t""")
def field_rules(spark, folder):
    key, name = F.col("p_partkey"), F.col("p_name")
    new = F.when(key % 4 == 0, " ").when(key % 4 == 1, F.concat(name, F.repeat(F.lit("x"), 40))).when(
        key % 4 == 2, F.concat(name, F.repeat(F.lit("x"), 41))).otherwise(F.col("p_brand"))
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("k"), F.lit("old"))
    fresh = F.when(key % 2 == 0, F.create_map(F.lit("k"), F.lit("new")))
    merged = merge.merge_metadata(old, merge.stamp_origin(fresh, F.when(key % 3 == 0, "o")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return table(spark, folder, "part").select("p_partkey", merge.better_text(name, new).alias("better"), shown.alias("metadata"))


def bulk_requests(spark, folder):
    """Documents as bulk requests of up to 100 items with whole texts; every fifth title is blank."""
    key = F.col("doc_id")
    item = F.struct(
        F.lit(None).cast("string").alias("sourceJobId"), F.concat(F.lit(f"{HOST}/"), key.cast("string")).alias("sourceUrl"),
        F.lit(None).cast("string").alias("originUrl"), F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("Role "), (key % 40).cast("string"))).alias("title"),
        F.struct(F.lit("c").alias("name"), F.lit(None).cast("string").alias("website"), F.lit(None).cast("string").alias("industry")).alias("company"),
        *[F.lit(None).cast("string").alias(n) for n in ("locationText", "workMode", "seniority", "employmentType")],
        F.col("text").alias("descriptionText"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("array<string>").alias("languages"),
        F.lit(None).cast("timestamp").alias("postedAt"), F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(None).cast("string").alias("sourceName"), F.lit(None).cast("string").alias("sourceType"))
    docs = table(spark, folder, "documents").withColumn("batch", F.floor(key / 100))
    grouped = docs.groupBy("batch").agg(F.array_sort(
        F.collect_list(F.struct("doc_id", item.alias("item"))), lambda a, b: (a["doc_id"] - b["doc_id"]).cast("int")).alias("rows"))
    return grouped.select(
        F.format_string("b%06d", "batch").alias("batch_id"), day(F.col("batch")).alias("arrived_at"), F.lit("feed").alias("source_name"),
        F.lit("ExternalIngestion").alias("source_type"), F.col("rows.item").alias("items"))


_FEED = """i AS (SELECT doc_id, doc_id % 40 AS role, coalesce(text, '') AS text, 'b' || lpad(CAST(doc_id // 100 AS VARCHAR), 6, '0') AS batch_id, doc_id % 5 = 0 AS bad,
  row_number() OVER (PARTITION BY doc_id % 40, doc_id % 5 = 0 ORDER BY doc_id) AS rn FROM documents)"""


@query(f"""WITH {_FEED}, c AS {_taken("(SELECT * FROM i WHERE NOT bad)", "role", "doc_id", "text")},
j AS (SELECT i.*, i.doc_id IN (SELECT t.seq FROM c) AS longer FROM i)
SELECT batch_id, count(*) AS received, count(*) FILTER (NOT bad) AS processed, count(*) FILTER (NOT bad AND rn = 1) AS inserted,
  count(*) FILTER (NOT bad AND rn > 1 AND longer) AS updated, count(*) FILTER (NOT bad AND rn > 1 AND NOT longer) AS duplicates, count(*) FILTER (bad) AS invalid FROM j GROUP BY batch_id""")
def bulk_summary(spark, folder):
    return run_bulk(bulk_requests(spark, folder), spark.createDataFrame([], STATE_SCHEMA), day()).summary


@query(f"""WITH {_FEED} SELECT batch_id, CAST(doc_id % 100 AS INTEGER) AS item_index, 'title is required' AS message FROM i WHERE bad""")
def bulk_item_errors(spark, folder):
    errors = run_bulk(bulk_requests(spark, folder), spark.createDataFrame([], STATE_SCHEMA), day()).errors
    return errors.select("batch_id", "item_index", "message")


def postings_from_orders(spark, folder):
    """Orders as stored postings."""
    key = F.col("o_orderkey")
    return as_state(
        table(spark, folder, "orders"), id=key.cast("string"), source_name=F.col("o_orderpriority"), source_type=F.lit("Gupy"),
        title=F.concat(F.lit("Order "), key.cast("string")), last_seen_at=F.col("o_orderdate"), captured_at=F.col("o_orderdate"),
        status=F.when(F.col("o_orderstatus") == "F", "Expired").otherwise("Active"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' OR (o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 14 DAY)
  THEN 'Expired' ELSE 'Active' END AS status FROM orders""")
def expire(spark, folder):
    ran = spark.createDataFrame([("1-URGENT", "Gupy"), ("5-LOW", "Gupy")], "source_name string, source_type string")
    now = F.lit("1998-01-01").cast("timestamp")
    return lc.expire(postings_from_orders(spark, folder), ran, now).select("id", "status")


@query("""SELECT o_orderpriority AS source_name, 'Gupy' AS source_type, count(*) AS expired FROM orders
WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 1 DAY GROUP BY o_orderpriority""")
def expired_counts(spark, folder):
    state = postings_from_orders(spark, folder)
    marked = lc.expire(state, state.select("source_name", "source_type"), F.lit("1998-01-01").cast("timestamp"), 0)
    return lc.expired_counts(marked)


def runs_from_events(spark, folder):
    """Events as run outcomes: one source per event type, one run per day."""
    label = pick(F.col("event_id"), "Inserted", "Updated", "Duplicate", "Duplicate", "Duplicate", "Inserted", "Conflict")
    ev = table(spark, folder, "events")
    return ev.select(F.col("event_type").alias("source_name"), F.date_format("ts", "yyyy-MM-dd").alias("source_type"), label.alias("outcome"),
                     F.when(label == "Conflict", F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0"))).alias("message"))


_RUNS = """r AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS d, event_id, event_id % 7 AS x FROM events)"""


@query(f"""WITH {_RUNS} SELECT event_type AS source_name, d AS source_type, count(*) AS fetched, count(*) FILTER (x IN (0, 1, 5)) AS indexed, count(*) FILTER (x IN (2, 3, 4)) AS duplicates,
  count(*) FILTER (x = 6) AS errors, min('e' || lpad(CAST(event_id AS VARCHAR), 9, '0')) FILTER (x = 6) AS error_sample, CASE WHEN count(*) FILTER (x = 6) > 0 THEN 'Failed' ELSE 'Success' END AS status
FROM r GROUP BY event_type, d""")
def run_counters(spark, folder):
    runs = lc.run_counters(runs_from_events(spark, folder), day())
    return runs.select("source_name", "source_type", "fetched", "indexed", "duplicates", "errors", "error_sample", "status")


@query(f"""WITH {_RUNS}, g AS (SELECT event_type, d, count(*) FILTER (x = 6) = 0 AS ok FROM r GROUP BY event_type, d)
SELECT event_type AS source_name, count(*) AS runs, round(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE), 6) AS success_rate, max(d) AS last_run, 0 AS active, 0 AS expired FROM g GROUP BY event_type
UNION ALL SELECT o_orderpriority, 0, NULL, NULL, count(*) FILTER (o_orderstatus <> 'F'), count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY o_orderpriority""")
def source_metrics(spark, folder):
    runs = lc.run_counters(runs_from_events(spark, folder), day()).withColumn("started_at", F.col("source_type").cast("timestamp"))
    found = lc.source_metrics(runs, postings_from_orders(spark, folder))
    return found.withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd"))


@query("""SELECT DISTINCT e.event_type AS source_name, e.event_type <> 'error' AS known, (SELECT count(*) FROM events x WHERE x.event_type = e.event_type) AS n FROM events e""")
def runs_and_sources(spark, folder):
    from postingflow.sources.state import upsert_sources

    runs = table(spark, folder, "events").select(F.col("event_type").alias("source_name"), F.lit("T").alias("source_type"))
    empty = spark.createDataFrame([], "id string, name string, type string, base_url string, enabled boolean")
    sources = upsert_sources(runs.filter("source_name <> 'error'"), empty)
    known = lc.runs_with_source(runs, sources).select("source_name", F.lit(True).alias("known"))
    orphan = lc.orphan_runs(runs, sources).select("source_name", F.lit(False).alias("known"))
    return known.unionByName(orphan).groupBy("source_name", "known").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH j AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS rn, CASE WHEN doc_id % 3 > 0 THEN 'R' || doc_id END AS rid FROM documents),
kept AS (SELECT d.*, {s_norm("d.lang || ', BR ' || d.text")} AS t FROM documents d JOIN j USING (doc_id) WHERE rn <= 50 OR doc_id % 4 = 3)
SELECT 'Job ' || doc_id || ' at ' || source AS title, '{HOST}/jobs/' || doc_id AS source_url, lang || ', BR' AS location_text, text AS description,
  CASE WHEN regexp_matches(lower(text), '[ãõçáéíóú]') THEN 'pt-BR' ELSE CASE WHEN trim(text) = '' THEN '' ELSE 'en' END END AS languages,
  CASE WHEN t LIKE '%remote%' OR t LIKE '%remoto%' THEN 'Remote' WHEN t LIKE '%hybrid%' OR t LIKE '%hibrido%' THEN 'Hybrid' WHEN t LIKE '%onsite%' OR t LIKE '%presencial%' THEN 'Onsite' ELSE 'Unknown' END AS work_mode
FROM kept""")
def crawl_pass(spark, folder):
    key = F.col("page_id")
    found = documents_as_jsonld(spark, folder).select(
        "page_id", "page_url", "html", F.concat(F.lit("ld"), (key % 4).cast("string")).alias("source_name"),
        F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(200).alias("status"))
    options = registry(spark, *[{"source_name": f"ld{i}", "source_type": "JsonLd", "family": "jsonld", "start_url": f"{HOST}/list",
                                 "max_items": 50 if i < 3 else None} for i in range(4)])
    result = run_crawl(found, options, spark.createDataFrame([], STATE_SCHEMA), F.lit(datetime(2024, 5, 1)), max_items=None)
    return result.postings.select("title", "source_url", "location_text", F.col("description_text").alias("description"),
                                  F.array_join("languages", ",").alias("languages"), "work_mode")


@query("""WITH d AS (SELECT CASE doc_id % 8 WHEN 0 THEN 'ld0' WHEN 7 THEN 'ld0' WHEN 1 THEN 'ld1' WHEN 2 THEN 'Corp' WHEN 3 THEN 'off' WHEN 4 THEN 'TOTVS jobs' WHEN 5 THEN 'bad' ELSE 'walled' END AS s FROM documents),
n AS (SELECT s, count(*) AS n FROM d WHERE s NOT IN ('off', 'TOTVS jobs') GROUP BY s UNION ALL SELECT 'quiet', 0 UNION ALL SELECT 'TOTVS jobs', 0)
SELECT s AS source_name, CASE WHEN s IN ('Corp', 'TOTVS jobs') THEN 'CorporateCareers' ELSE 'JsonLd' END AS source_type, CASE WHEN s IN ('bad', 'walled') THEN 0 ELSE n END AS fetched,
  CASE WHEN s IN ('bad', 'walled') THEN 0 ELSE n END AS inserted, CASE s WHEN 'walled' THEN n ELSE 0 END AS blocked, CASE s WHEN 'bad' THEN n ELSE 0 END AS malformed,
  CASE s WHEN 'bad' THEN n ELSE 0 END AS errors, CASE s WHEN 'bad' THEN 'malformed JSON block' END AS error_sample, CASE s WHEN 'bad' THEN 'Failed' ELSE 'Success' END AS status FROM n""")
def crawl_runs(spark, folder):
    """Runs of sources that give postings, nothing, unreadable blocks or challenges, and of ones that are skipped or off."""
    names = ["ld0", "ld1", "Corp", "off", "TOTVS jobs", "bad", "walled"]
    name = pick(F.col("page_id") % 8, *names, "ld0")
    broken = F.lit('<script type="application/ld+json">{"@type": "JobPosting", </script>')
    html = F.when(name == "bad", broken).when(name == "walled", F.concat(F.lit("<p>Cloudflare</p>"), F.col("html"))).otherwise(F.col("html"))
    found = documents_as_jsonld(spark, folder).select(
        "page_id", "page_url", html.alias("html"), name.alias("source_name"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(200).alias("status"))
    rows = [{"source_name": n, "source_type": "CorporateCareers" if n in ("Corp", "TOTVS jobs") else "JsonLd", "family": "jsonld", "start_url": f"{HOST}/list",
             "enabled": n != "off"} for n in [*names, "quiet"]]
    runs = run_crawl(found, registry(spark, *rows), spark.createDataFrame([], STATE_SCHEMA), F.lit(datetime(2024, 5, 1)), max_items=None).runs
    return runs.select("source_name", "source_type", "fetched", "inserted", "blocked", "malformed", "errors", "error_sample", "status")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS seq FROM events""")
def numbered_events(spark, folder):
    ev = table(spark, folder, "events").select("event_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("_back"))
    return number_rows(ev, ["_back", "event_id"]).select("event_id", "seq")


@query(f"""WITH RECURSIVE n AS (SELECT doc_id::VARCHAR AS id, list_sort(list_distinct([x FOR x IN regexp_split_to_array({s_norm('text')}, '[{WS}]+') IF x <> ''])) AS w FROM documents),
s AS (SELECT min(id) AS a, w FROM n GROUP BY w), t AS (SELECT a, len(w) AS n, unnest(w) AS x FROM s),
e AS (SELECT t.a, u.a AS b FROM t JOIN t u ON t.x = u.x AND t.a <> u.a GROUP BY t.a, u.a, t.n, u.n HAVING count(*) / (t.n + u.n - count(*)) >= 0.8),
r AS (SELECT a, a AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.id, c.cluster_id FROM n JOIN s USING (w) JOIN (SELECT a, min(b) AS cluster_id FROM r GROUP BY a) c USING (a)""")
def similar_clusters(spark, folder):
    df = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("").alias("title"), F.lit("").alias("company_name"), F.col("text").alias("description_text"))
    return similar.cluster_similar(df)


@query(f"""SELECT doc_id, 'ld' AS source_name, 'p' || doc_id AS id, {s_pick('doc_id', 'Active', 'Active')} AS status FROM documents""")
def entity_flatten(spark, folder):
    key = F.col("page_id")
    raw = documents_as_jsonld(spark, folder)
    from postingflow.operators.extract import extract_jsonld

    options = registry(spark, {"source_name": "ld", "source_type": "JsonLd"})
    nested = posting.with_run_ts(posting.to_posting(extract_jsonld(raw), options), day())
    flat = posting.to_entity(nested, F.concat(F.lit("p"), key.cast("string")), ["page_id"])
    return flat.select(F.col("page_id").alias("doc_id"), "source_name", "id", "status")

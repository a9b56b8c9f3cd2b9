"""Queries over search, views, favourites, sign-ins, digests and admission."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from postingflow.operators import favorites as fav, quality, rank, search as se, views
from postingflow.operators.posting import to_search_doc
from postingflow.plans.catalog.common import pick, registrar, s_norm, s_pick, table
from postingflow.plans.catalog.matching import as_state
from postingflow.streaming.admission import admit, client_key

QUERIES, query = registrar()

FROM = date(1997, 6, 1)


def postings(spark, folder, heavy=False):
    """Orders with their customers as stored postings."""
    key = F.col("o_orderkey")
    df = table(spark, folder, "orders", heavy).join(
        table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey"), "o_custkey")
    return as_state(
        df, id=key.cast("string"), source_name=F.col("o_orderpriority"), source_type=F.lit("Gupy"), title=F.concat(F.lower("c_mktsegment"), F.lit(" job "), (key % 17).cast("string")),
        company_name=F.col("c_name"), location_text=F.concat(F.lit("Zone "), F.col("c_nationkey").cast("string")),
        work_mode=pick(key, "Remote", "Hybrid", "Unknown"), seniority=pick(key, "Senior", "Junior", "Mid", "Unknown", "Lead"),
        tags=F.array(F.lower("c_mktsegment"), pick(key, "java", "python")), posted_at=F.when(key % 10 > 0, F.col("o_orderdate")),
        status=F.when(F.col("o_orderstatus") == "P", "Expired").otherwise("Active"), source_url=F.concat(F.lit("https://h/"), key.cast("string")),
        description_text=F.repeat(F.lit("d"), (key % 300).cast("int")), salary_min=F.when(key % 4 == 0, F.floor("o_totalprice")),
        salary_currency=F.lit("BRL"), captured_at=F.col("o_orderdate"), fingerprint=key.cast("string"))


def docs(spark, folder, heavy=False):
    return to_search_doc(postings(spark, folder, heavy))


_DOCS = f"""docs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, lower(c_mktsegment) || ' job ' || o_orderkey % 17 AS title, c_name AS company, 'Zone ' || c_nationkey AS loc,
  {s_pick('o_orderkey', 'Remote', 'Hybrid', 'Unknown')} AS mode, {s_pick('o_orderkey', 'Senior', 'Junior', 'Mid', 'Unknown', 'Lead')} AS seniority,
  lower(c_mktsegment) AS seg, {s_pick('o_orderkey', 'java', 'python')} AS lang, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS posted, o_orderdate AS captured,
  CASE WHEN o_orderstatus = 'P' THEN 'Expired' ELSE 'Active' END AS status, o_orderpriority AS source, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query(f"""WITH {_DOCS} SELECT id FROM docs WHERE status = 'Active' AND mode = 'Remote' AND lower(source) = '1-urgent' AND (seg = 'building' OR lang = 'java')
  AND posted >= TIMESTAMP '{FROM}'""")
def search_filters(spark, folder):
    return se.filter_docs(docs(spark, folder), work_mode="REMOTE", seniority="nonsense", source_name="1-urgent", tags="Building, java,", posted_from=FROM).select("id")


@query(f"""WITH {_DOCS} SELECT id, title FROM docs WHERE status = 'Active' AND seniority = 'Senior' ORDER BY posted DESC NULLS LAST, captured DESC, id LIMIT 25 OFFSET 50""")
def search_sort_page(spark, folder):
    return se.search(docs(spark, folder), seniority="senior", page=3, page_size=25).select("id", "title")


@query(f"""WITH {_DOCS}, a AS (SELECT 1 AS ask, id, row_number() OVER (ORDER BY posted DESC NULLS LAST, captured DESC, id) AS n FROM docs WHERE status = 'Active' AND seniority = 'Senior'
UNION ALL SELECT 2, id, row_number() OVER (ORDER BY CASE WHEN title LIKE '% job 1%' THEN 8 WHEN loc LIKE 'Zone 1%' THEN 5 ELSE 1 END DESC, posted ASC NULLS LAST, captured DESC, id)
  FROM docs WHERE status = 'Active' AND seg = 'machinery' AND (title LIKE '% job 1%' OR loc LIKE 'Zone 1%' OR source LIKE '1-%'))
SELECT ask, id FROM a WHERE n > 50 AND n <= 75""")
def search_pages_by_cursor(spark, folder):
    found = docs(spark, folder)

    def third(**asked):
        cursor = None
        for _ in range(2):
            cursor = se.search_after(found, cursor, page_size=25, **asked).collect()[-1].cursor  # a page
        return se.search_after(found, cursor, page_size=25, **asked)

    pages = [third(seniority="senior"), third(q="machinery 1", sort="postedAt:asc")]
    return reduce(lambda a, b: a.unionByName(b), [p.select(F.lit(n + 1).alias("ask"), "id") for n, p in enumerate(pages)])


@query(f"""WITH {_DOCS} SELECT id FROM docs WHERE status = 'Active' ORDER BY posted ASC NULLS LAST, captured DESC, id LIMIT 20""")
def search_oldest_first(spark, folder):
    return se.search(docs(spark, folder), sort="postedAt:ASC", page=0, page_size=500).select("id")


@query(f"""WITH {_DOCS} SELECT id, CAST(8 + CASE WHEN title LIKE '% job 1%' THEN 8 WHEN loc LIKE 'Zone 1%' THEN 5 ELSE 1 END AS DOUBLE) AS score FROM docs
WHERE status = 'Active' AND seg = 'machinery' AND (title LIKE '% job 1%' OR loc LIKE 'Zone 1%' OR source LIKE '1-%')""")
def search_text(spark, folder):
    return se.match_text(se.filter_docs(docs(spark, folder, heavy=True)), "Machinery 1").select("id", "score")


@query(f"""WITH {_DOCS}, d AS (SELECT * FROM docs WHERE status = 'Active') SELECT 1 AS ask, id, 15.5::DOUBLE AS score FROM d WHERE seg = 'household'
UNION ALL SELECT 2, id, 7.5 FROM d WHERE seg = 'household' UNION ALL SELECT 3, id, 8 FROM d WHERE seg = 'machinery'
UNION ALL SELECT 4, id, 7.5 + CASE WHEN title LIKE '% job 1%' THEN 8 WHEN loc LIKE 'Zone 1%' THEN 5 ELSE 1 END FROM d
  WHERE seg = 'furniture' AND (title LIKE '% job 1%' OR loc LIKE 'Zone 1%' OR source LIKE '1-%')
UNION ALL SELECT 5, id, 6.5 FROM d WHERE lang = 'python' AND 0 = 1 UNION ALL SELECT 6, id, 11 FROM d WHERE lang = 'python'""")
def search_with_typos(spark, folder):
    live = se.filter_docs(docs(spark, folder, heavy=True))
    index = se.build_index(live)
    asked = ["housahold job", "housihuld", "MACH", "furnitur 1", "pythonesk", "pythom pythn"]
    found = [se.match_index(live, index, q).select(F.lit(n + 1).alias("ask"), "id", "score") for n, q in enumerate(asked)]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(f"""WITH {_DOCS}, d AS (SELECT * FROM docs WHERE status = 'Active') SELECT 'workMode' AS attribute, mode AS value, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'seniority', seniority, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'employmentType', 'Unknown', count(*) FROM d UNION ALL SELECT 'company', company, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'locationText', loc, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'sourceName', source, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'tags', seg, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'tags', lang, count(*) FROM d GROUP BY 2""")
def facets(spark, folder):
    return se.facets(docs(spark, folder))


@query(f"""WITH {_DOCS} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM docs WHERE status = 'Active' AND mode = 'Hybrid'""")
def count_hits(spark, folder):
    return se.count_hits(docs(spark, folder), work_mode="hybrid")


@query(f"""WITH {_DOCS} SELECT id, title, status FROM docs WHERE k = 42""")
def posting_by_id(spark, folder):
    return se.get_posting(postings(spark, folder), "42").select("id", "title", "status")


@query("""SELECT s_name AS name FROM supplier ORDER BY s_name""")
def source_list(spark, folder):
    sources = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("Gupy").alias("type"), F.lit(None).cast("string").alias("base_url"), F.lit(True).alias("enabled"))
    return se.list_sources(sources).select("name")


@query(f"""WITH {_DOCS}, r AS (SELECT c.c_custkey AS query_id, d.id, row_number() OVER (PARTITION BY c.c_custkey ORDER BY d.posted DESC NULLS LAST, d.captured DESC, d.id) AS rank
  FROM customer c JOIN docs d ON d.status = 'Active' AND c.c_custkey % 11 > 2 AND d.loc = 'Zone ' || c.c_nationkey AND d.seg = lower(c.c_mktsegment)
   AND (c.c_custkey % 2 = 1 OR d.lang = 'java') AND (c.c_custkey % 3 > 0 OR d.mode = 'Remote')),
newest AS (SELECT id, posted, k, row_number() OVER (ORDER BY posted DESC NULLS LAST, captured DESC, id) AS rank FROM docs WHERE status = 'Active'),
long AS (SELECT id, row_number() OVER (ORDER BY posted DESC NULLS LAST, captured DESC, id) AS rank FROM docs WHERE status = 'Active' AND k % 1000 = 7),
o AS (SELECT c_custkey AS query_id, id, rank FROM customer JOIN newest ON c_custkey % 11 = 0 OR (c_custkey % 11 = 1 AND posted >= TIMESTAMP '{FROM}')
  UNION ALL SELECT c_custkey, id, rank FROM customer JOIN long ON c_custkey % 11 = 2
  UNION ALL SELECT query_id, id, rank FROM r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM o WHERE rank <= 5""")
def saved_searches(spark, folder):
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")
    full = key % 11 > 2  # the others have no condition, only a date, or only a very long word
    queries = table(spark, folder, "customer").select(
        key.alias("query_id"), F.when(full, F.initcap("c_mktsegment")).when(key % 11 == 2, F.repeat(F.lit("y"), 500)).alias("q"), F.when(full & (key % 2 == 0), "java").alias("tags"),
        F.when(full & (key % 3 == 0), "remote").alias("workMode"), none.alias("seniority"), none.alias("employmentType"), none.alias("company"),
        F.when(full, F.concat(F.lit("zone "), F.col("c_nationkey").cast("string"))).alias("location"), none.alias("sourceName"), F.when(key % 11 == 1, str(FROM)).alias("postedFrom"))
    found = docs(spark, folder, heavy=True)
    long = F.when(F.col("id").cast("long") % 1000 == 7, F.concat("title", F.lit(" "), F.repeat(F.lit("Y"), 600))).otherwise(F.col("title"))
    return se.batch_search(queries, found.withColumn("title", long), 5).select("query_id", "rank", "id")


@query(f"""WITH {_DOCS} SELECT id, title, company, CASE WHEN k % 4 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS salary_min, CASE WHEN k % 4 = 0 THEN 'BRL' END AS currency,
  seg || ',' || lang AS tags, source FROM docs""")
def detail_view(spark, folder):
    found = views.to_detail(postings(spark, folder))
    return found.select("id", "title", F.col("company.name").alias("company"), F.col("salary.min").cast("long").alias("salary_min"),
                        F.col("salary.currency").alias("currency"), F.array_join("tags", ",").alias("tags"), F.col("source.name").alias("source"))


@query(f"""WITH {_DOCS} SELECT id, title, company, loc AS location, CASE WHEN mode = '' THEN NULL ELSE mode END AS work_mode, seg || ',' || lang AS tags,
  'https://h/' || id AS apply_url, source FROM docs""")
def display_jobs(spark, folder):
    ui = views.to_ui_job(views.to_list_item(docs(spark, folder)))
    return ui.select("id", "title", "company", "location", F.col("workMode").alias("work_mode"), F.array_join("tags", ",").alias("tags"),
                     F.col("applyUrl").alias("apply_url"), F.col("sourceName").alias("source"))


@query(f"""WITH {_DOCS} SELECT id, title, company, loc AS location, source FROM docs""")
def display_favorites(spark, folder):
    ui = views.to_ui_favorite(views.to_list_item(docs(spark, folder)))
    return ui.select("id", "title", "company", "location", F.col("sourceName").alias("source"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 > 0""")
def display_sources(spark, folder):
    key = F.col("s_suppkey")
    sources = table(spark, folder, "supplier").select(key.cast("string").alias("id"), F.when(key % 3 > 0, F.col("s_name")).otherwise(" ").alias("name"),
                                                      F.lit("T").alias("type"), F.lit("").alias("base_url"), F.lit(True).alias("enabled"))
    return views.to_ui_source(sources).select("id", "name")


@query(f"""SELECT c_custkey, c_mktsegment AS q, {s_pick('c_custkey', 'Contractor', 'CLT', 'odd', '-')} AS kind, {s_pick('c_custkey', 'postedAt:desc', 'capturedAt:asc', 'postedAt:desc')} AS sort,
  CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 1 END AS page, CASE c_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 20 ELSE 30 END AS page_size,
  CASE WHEN c_custkey % 2 = 0 THEN '2024-01-02T00:00:00.000Z' ELSE '-' END AS floor FROM customer""")
def query_clean_up(spark, folder):
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    raw = table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("q"), none.alias("tags"), F.lit(" ").alias("workMode"), none.alias("seniority"),
        pick(key, "CONTRACT", "clt", "odd ", " ").alias("employmentType"), none.alias("sourceName"), none.alias("company"), none.alias("location"),
        pick(key, "2024-01-02", "soon").alias("postedFrom"), pick(key, "recent", "CapturedAt:ASC", "x").alias("sort"), pick(key, "-4", "7.9", "abc").alias("page"),
        pick(key, "5000", "", "30", "30.2").alias("pageSize"))
    clean = views.normalize_query(raw)
    return clean.select("c_custkey", "q", F.coalesce("employmentType", F.lit("-")).alias("kind"), "sort", F.col("page").cast("int").alias("page"),
                        F.col("pageSize").cast("int").alias("page_size"), F.coalesce("postedFrom", F.lit("-")).alias("floor"))


def commands(spark, folder, kinds: list[str]):
    """Events as favourite commands of users on orders."""
    ev = table(spark, folder, "events").filter(F.col("event_type").isin(*kinds))
    return ev.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), ((F.col("event_id") * 7) % 1000).cast("string").alias("job_id"),
        F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"))


_CMDS = """cmds AS (SELECT event_id AS seq, 'u' || user_id AS user_id, CAST((event_id * 7) % 1000 AS VARCHAR) AS job_id, ts AS tm, event_type,
  CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action, user_id AS n FROM events)"""


def _users(spark, folder):
    return table(spark, folder, "customer").filter("c_custkey % 5 > 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"))


def _jobs(spark, folder):
    return table(spark, folder, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"))


@query(f"""WITH {_CMDS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY seq) AS rn FROM cmds WHERE event_type = 'click'),
held AS (SELECT DISTINCT user_id, job_id FROM cmds WHERE event_type = 'view')
SELECT seq, CASE WHEN n % 5 = 0 OR n NOT IN (SELECT c_custkey FROM customer) THEN 'UserNotFound' WHEN CAST(job_id AS INTEGER) % 3 = 0 OR CAST(job_id AS INTEGER) NOT IN (SELECT o_orderkey FROM orders) THEN 'JobNotFound'
  WHEN rn > 1 OR (user_id, job_id) IN (SELECT (user_id, job_id) FROM held) THEN 'AlreadyExists' ELSE 'Added' END AS status FROM f""")
def favorites_add(spark, folder):
    held = commands(spark, folder, ["view"]).groupBy("user_id", "job_id").agg(F.min("at").alias("created_at"))
    _, status = fav.add_favorites(commands(spark, folder, ["click"]), held, _users(spark, folder), _jobs(spark, folder))
    return status.select("seq", "status")


@query(f"""WITH {_CMDS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY seq) AS rn FROM cmds WHERE event_type = 'error')
SELECT seq, CASE WHEN rn = 1 AND (user_id, job_id) IN (SELECT (user_id, job_id) FROM cmds WHERE event_type = 'view') THEN 'Removed' ELSE 'NotFound' END AS status FROM f""")
def favorites_remove(spark, folder):
    held = commands(spark, folder, ["view"]).groupBy("user_id", "job_id").agg(F.min("at").alias("created_at"))
    _, status = fav.remove_favorites(commands(spark, folder, ["error"]), held)
    return status.select("seq", "status")


_STORED = "held AS (SELECT user_id, job_id, min(tm) AS created_at FROM cmds WHERE event_type = 'view' GROUP BY 1, 2)"


@query(f"""WITH {_CMDS}, {_STORED}, log AS (SELECT * FROM cmds WHERE event_type IN ('click', 'error')),
e AS (SELECT user_id, job_id, arg_max(action, seq) AS final, max(seq) FILTER (action = 'remove') AS gone FROM log GROUP BY 1, 2),
fresh AS (SELECT l.user_id, l.job_id, arg_min(l.tm, l.seq) AS tm FROM log l JOIN e USING (user_id, job_id) WHERE e.final = 'add' AND l.action = 'add' AND (e.gone IS NULL OR l.seq > e.gone) GROUP BY 1, 2),
kept AS (SELECT h.* FROM held h LEFT JOIN e USING (user_id, job_id) WHERE e.final IS NULL OR (e.final = 'add' AND e.gone IS NULL))
SELECT user_id, job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM kept UNION ALL
SELECT user_id, job_id, strftime(tm, '%Y-%m-%d %H:%M:%S') FROM fresh WHERE (user_id, job_id) NOT IN (SELECT (user_id, job_id) FROM kept)""")
def favorites_replay(spark, folder):
    held = commands(spark, folder, ["view"]).groupBy("user_id", "job_id").agg(F.min("at").alias("created_at"))
    after = fav.replay_favorites(commands(spark, folder, ["click", "error"]), held)
    return after.select("user_id", "job_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(f"""WITH {_CMDS}, {_STORED} SELECT h.user_id, h.job_id, o.o_orderpriority AS title FROM held h JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = h.job_id WHERE o_orderkey % 3 > 0""")
def favorites_list(spark, folder):
    held = commands(spark, folder, ["view"]).groupBy("user_id", "job_id").agg(F.min("at").alias("created_at"))
    return fav.list_favorites(held, _jobs(spark, folder)).select("user_id", "job_id", "title")


@query(f"""WITH {_CMDS}, i AS (SELECT DISTINCT user_id, job_id, n FROM cmds WHERE event_type = 'signup'),
s AS (SELECT user_id, n % 5 > 0 AND n IN (SELECT c_custkey FROM customer) AND CAST(job_id AS INTEGER) % 3 > 0 AND CAST(job_id AS INTEGER) IN (SELECT o_orderkey FROM orders) AS ok FROM i)
SELECT user_id, count(*) FILTER (ok) AS imported, count(*) FILTER (NOT ok) AS failed FROM s GROUP BY user_id""")
def favorites_import(spark, folder):
    ids = commands(spark, folder, ["signup"]).withColumn("job_id", F.concat(F.lit(" "), F.col("job_id"), F.lit("\t")))
    held = commands(spark, folder, ["view"]).groupBy("user_id", "job_id").agg(F.min("at").alias("created_at"))
    _, _, counts = fav.import_favorites(ids, held, _users(spark, folder), _jobs(spark, folder))
    return counts


@query("""WITH s AS (SELECT event_id AS seq, user_id, event_type, CASE WHEN event_type = 'error' THEN 'MissingProviderSubject' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'MissingEmail'
  WHEN event_id % 9 = 0 THEN 'EmailNotVerified' ELSE 'Success' END AS status FROM events)
SELECT seq, status, CASE WHEN status <> 'Success' THEN NULL WHEN user_id % 3 = 0 THEN 'linked' || user_id WHEN user_id % 3 = 1 AND user_id IN (SELECT c_custkey FROM customer) THEN 'customer' || user_id
  ELSE 'u:' || left(sha256('user' || user_id || '@x.com'), 32) END AS user_id FROM s""")
def link_identities(spark, folder):
    n = F.col("user_id")
    ev = table(spark, folder, "events")
    sign_ins = ev.select(
        F.col("event_id").alias("seq"), F.lit(" github ").alias("provider"), F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit("s"), n.cast("string"))).alias("subject"),
        F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "").otherwise(F.concat(F.lit(" User"), n.cast("string"), F.lit("@X.com"))).alias("email"),
        (F.col("event_id") % 9 > 0).alias("email_verified"), F.lit("N").alias("display_name"), F.lit(None).cast("string").alias("avatar_url"), F.col("ts").cast("timestamp").alias("at"))
    identities = ev.filter("user_id % 3 = 0").select(F.lit("github").alias("provider"), F.concat(F.lit("s"), n.cast("string")).alias("subject"),
                                                     F.concat(F.lit("linked"), n.cast("string")).alias("user_id")).distinct()
    key = F.col("c_custkey").cast("string")
    users = table(spark, folder, "customer").filter("c_custkey % 3 = 1").select(
        F.concat(F.lit("customer"), key).alias("id"), F.concat(F.lit("user"), key, F.lit("@x.com")).alias("email"), F.concat(F.lit("user"), key, F.lit("@x.com")).alias("normalized_email"),
        F.lit("").alias("display_name"), F.lit(None).cast("string").alias("avatar_url"), F.lit(None).cast("timestamp").alias("email_verified_at"), F.lit(None).cast("timestamp").alias("last_login_at"))
    status, _ = fav.link_identities(sign_ins, identities, users)
    return status.select("seq", "status", "user_id")


_REQ = "r AS (SELECT event_id, ts, 'u' || user_id AS key, CASE WHEN event_type IN ('click', 'view') THEN 'reset' ELSE 'login' END AS policy FROM events)"


@query(f"""WITH {_REQ}, n AS (SELECT *, row_number() OVER (PARTITION BY policy, key, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM r)
SELECT event_id AS request_id, rn <= CASE policy WHEN 'reset' THEN 2 ELSE 3 END AS admitted FROM n""")
def admission(spark, folder):
    key = client_key(F.concat(F.lit(" , u"), F.col("user_id").cast("string"), F.lit(" ,proxy")), F.lit("remote"))
    ev = table(spark, folder, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), key.alias("key"),
                                              F.when(F.col("event_type").isin("click", "view"), "reset").otherwise("login").alias("policy"))
    return admit(ev, {"reset": 2, "login": 3}, "1 day").select("request_id", "admitted")


@query(f"""WITH {_DOCS}, s AS (SELECT *, CAST(coalesce(posted, captured) AS DATE) AS day, 0.1 * CAST(k % 300 > 0 AS DOUBLE) + 0.1 + 0.1 * CAST(mode <> 'Unknown' AS DOUBLE) - 0.3 * CAST(k % 300 < 200 AS DOUBLE) AS score FROM docs),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 6) DESC, id) AS rn FROM s)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(rn AS INTEGER) AS rank, id, rn || ') ' || title || ' — ' || company || ' (' || mode || ') https://h/' || id AS line FROM r WHERE rn <= 3""")
def daily_digest(spark, folder):
    weights = dict(rank.WEIGHTS, recency=0.0)
    scored = rank.rank_score(postings(spark, folder), F.lit("2002-01-01").cast("timestamp"), weights=weights)
    return rank.digest(scored, 3).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "rank", "id", "line")


@query(f"""WITH {_DOCS} SELECT id, concat_ws(e'\\n', '🚀 ' || title, '🏢 ' || company, '📍 ' || loc || ' • ' || mode, '🎚️ ' || seniority || ' • Unknown', '🏷️ ' || seg || ', ' || lang, '🔗 https://h/' || id) AS message FROM docs""")
def posting_cards(spark, folder):
    return rank.card(postings(spark, folder))


@query(f"""SELECT doc_id AS id, {s_norm("text")} IN ('vaga', 'vagas', 'oportunidade', 'oportunidades') OR doc_id % 6 = 0 AS generic_title, length(text) < 200 AS short_text FROM documents""")
def spam_signs(spark, folder):
    key = F.col("doc_id")
    df = table(spark, folder, "documents").select(
        key.alias("id"), F.when(key % 6 == 0, "¡Vagas!").otherwise(F.col("text")).alias("title"), F.col("text").alias("description_text"))
    return quality.spam_flags(df).select("id", "generic_title", "short_text")


@query("""SELECT doc_id AS id, 'title' AS field, length(text) AS length, 400 AS cap FROM documents WHERE length(text) > 400
UNION ALL SELECT doc_id, 'country', length(source || lang), 8 FROM documents WHERE length(source || lang) > 6 AND length(source || lang) > 8""")
def over_long_fields(spark, folder):
    df = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.concat("source", "lang").alias("country"))
    found = quality.length_violations(df)
    return found.select("id", "field", F.col("length").cast("long").alias("length"), "cap")

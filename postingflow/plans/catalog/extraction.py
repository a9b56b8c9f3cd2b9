"""Queries over the extraction operators. Payloads are built from the given tables inside the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingflow.operators import extract as ex
from postingflow.operators.quality import quality_gate, validate_items
from postingflow.plans.catalog.common import pages, pick, registrar, s_collapse, s_html, s_norm, s_pick, s_trim, small, table
from postingflow.schema import REGISTRY_SCHEMA
from postingflow.sources import scans

QUERIES, query = registrar()

HOST = "https://jobs.example.com"


def registry(spark, *rows: dict):
    names = [f.name for f in REGISTRY_SCHEMA.fields]
    return small(spark, [tuple(r.get(n) for n in names) for r in rows], REGISTRY_SCHEMA)


def documents_as_jsonld(spark, folder):
    """One page per document with its text as a structured posting, next to an unrelated object."""
    key = F.col("doc_id")
    job = F.to_json(F.struct(
        F.when(key % 2 == 0, F.lit("JobPosting")).otherwise("jobposting").alias("@type"),
        F.concat(F.lit("Job "), key.cast("string"), F.lit(" at <b>"), F.col("source"), F.lit("</b>")).alias("title"),
        F.concat(F.lit("/jobs/"), key.cast("string")).alias("url"), F.struct(F.col("source").alias("name")).alias("hiringOrganization"),
        F.when(key % 3 > 0, F.struct(F.concat(F.lit("R"), key.cast("string")).alias("value"))).alias("identifier"),
        F.struct(F.struct(F.col("lang").alias("addressLocality"), F.lit("BR").alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.col("text").alias("description"), F.lit("2024-03-01").alias("datePosted"), pick(key, "CLT", "PJ").alias("employmentType"),
    ))
    graph = F.concat(F.lit('{"@graph":[{"@type":"Organization","title":"x"},'), job, F.lit("]}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), graph, F.lit("</script><script>var a=1;</script></html>"))
    return table(spark, folder, "documents").select(
        key.alias("page_id"), F.lit(f"{HOST}/list").alias("page_url"), F.lit("ld").alias("source_name"), html.alias("html"))


@query(f"""SELECT doc_id AS page_id, 'Job ' || doc_id || ' at ' || source AS title, '{HOST}/jobs/' || doc_id AS url, source AS company,
  lang || ', BR' AS location_text, CASE WHEN doc_id % 3 > 0 THEN 'R' || doc_id ELSE 'url:' || left(sha256('{HOST}/jobs/' || doc_id), 16) END AS source_job_id,
  text AS description, '2024-03-01' AS posted, {s_pick('doc_id', 'CLT', 'PJ')} AS employment_text FROM documents""")
def jsonld_roundtrip(spark, folder):
    raw = ex.extract_jsonld(documents_as_jsonld(spark, folder))
    return raw.select("page_id", "title", "url", "company", "location_text", "source_job_id", "description",
                      F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "employment_text")


@query(f"""SELECT doc_id AS page_id, 0 AS block_ord, 5 AS n_objects FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 0, 6 FROM documents WHERE doc_id % 3 > 0""")
def json_object_walk(spark, folder):
    objects = ex.json_objects(documents_as_jsonld(spark, folder), "jsonld")
    kept = objects.filter(F.get_json_object("object", "$.addressCountry").isNull())
    return kept.groupBy("page_id", "block_ord").agg(F.count(F.lit(1)).cast("int").alias("n_objects"))


@query("""SELECT page_id, 0 AS block_ord, '{"n": ' || page_id || '}' AS block, CAST(page_id % 5 = 0 AS INTEGER) AS bad FROM pages WHERE page_id % 5 <> 0
UNION ALL SELECT page_id, 0, '{"n": ', 1 FROM pages WHERE page_id % 5 = 0""")
def script_blocks(spark, folder):
    body = F.concat(F.lit('{"n": '), F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit("}"))))
    html = F.concat(F.col("html"), F.lit("<script type='application/json'>"), body, F.lit("</script>"))
    found = pages(spark, folder).withColumn("html", html)
    blocks = ex.script_blocks(found, "embedded").select("page_id", "block_ord", "block")
    bad = ex.malformed_blocks(found, "embedded").select("page_id", "block_ord", F.lit(1).alias("bad"))
    # Block text is trimmed by the sniffing step, so compare it with one trailing blank restored.
    shown = F.when(F.col("block") == '{"n":', F.lit('{"n": ')).otherwise(F.col("block"))
    return blocks.join(bad, ["page_id", "block_ord"], "left").select(
        "page_id", "block_ord", shown.alias("block"), F.coalesce("bad", F.lit(0)).alias("bad"))


@query(f"""SELECT o_orderkey AS page_id, 'Order ' || o_orderpriority AS title,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://wd.example.com/job/SP/Order_' || o_orderkey WHEN 1 THEN 'https://wd.example.com/pt/Site/job/R%20' || o_orderkey
    ELSE 'https://other.example.com/job/' || o_orderkey || '?src=x' END AS url,
  CASE o_orderkey % 3 WHEN 0 THEN 'Order_' || o_orderkey WHEN 1 THEN 'R ' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS source_job_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Recife | Natal' ELSE 'Porto - PT' END AS location_text,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS posted, o_orderstatus AS employment_text FROM orders""")
def workday_roundtrip(spark, folder):
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    item = F.struct(
        F.concat(F.lit(" Order "), F.col("o_orderpriority")).alias("title"),
        F.when(key % 3 == 0, F.concat(F.lit("/job/SP/Order_"), text)).when(
            key % 3 == 2, F.concat(F.lit("https://other.example.com/job/"), text, F.lit("?src=x"))).alias("externalPath"),
        F.when(key % 3 == 1, F.concat(F.lit("R "), text)).alias("jobReqId"),
        F.when(key % 3 == 1, F.array(F.lit("Recife "), F.lit("Natal"))).alias("locations"),
        F.when(key % 3 == 2, F.array(F.lit("R1"), F.lit("Porto - PT"))).alias("bulletFields"),
        F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("Posted Today").alias("postedOn"),
        F.struct(F.col("o_orderstatus").alias("label")).alias("timeType"))
    payload = F.to_json(F.struct(F.lit(1).alias("total"), F.array(item).alias("jobPostings")))
    html = F.when(key % 5 == 0, F.concat(F.lit('{"data":[{"inner":'), payload, F.lit("}]}"))).otherwise(payload)
    found = table(spark, folder, "orders", heavy=True).select(
        key.alias("page_id"), F.lit(f"{HOST}/wd").alias("page_url"), F.lit("wd").alias("source_name"), html.alias("html"))
    options = registry(spark, {"source_name": "wd", "base_host": "wd.example.com", "site_path": "/pt/Site/", "site_name": "Site"})
    raw = ex.extract_workday(found, options)
    return raw.select("page_id", "title", "url", "source_job_id", "location_text", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "employment_text")


@query("""SELECT p_partkey AS page_id, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'J' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS source_job_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'https://c' || p_partkey % 7 || '.gupy.io/jobs/J' || p_partkey
       ELSE 'https://c' || p_partkey % 7 || '.gupy.io/job/' || p_partkey END AS url,
  CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Recife, PE, BR' ELSE 'remote' END AS location_text FROM part""")
def gupy_roundtrip(spark, folder):
    key = F.col("p_partkey")
    text = key.cast("string")
    common = [F.col("p_name").alias("name"), F.when(key % 3 == 0, F.col("p_brand")).alias("location"), F.when(key % 3 > 0, F.struct(
        F.when(key % 3 == 1, F.struct(F.lit("Recife").alias("city"), F.lit("PE").alias("stateShortName"), F.lit("BR").alias("country"))).alias("address"),
        F.lit("remote").alias("workplaceType"))).alias("workplace")]
    by_text = F.to_json(F.struct(F.concat(F.lit("J"), text).alias("id"), *common, F.concat(F.lit("/jobs/J"), text).alias("jobUrl")))
    by_number = F.to_json(F.struct(key.alias("id"), *common))
    job = F.when(key % 4 == 0, by_text).otherwise(by_number)
    payload = F.concat(F.lit('{"data":{"jobs":['), job, F.lit("]}}"))
    html = F.when(key % 2 == 0, payload).otherwise(F.concat(F.lit("<p>x</p><script id='__NEXT_DATA__' type='application/json'>"), payload, F.lit("</script>")))
    found = table(spark, folder, "part", heavy=True).select(
        key.alias("page_id"), F.concat(F.lit("https://c"), (key % 7).cast("string"), F.lit(".gupy.io/jobs")).alias("page_url"),
        F.lit("any").alias("source_name"), html.alias("html"))
    options = registry(spark, *[{"source_name": f"company{i}", "start_url": f"https://c{i}.gupy.io/"} for i in range(7)])
    return ex.extract_gupy(found, options).select("page_id", "title", "source_job_id", "url", "location_text")


BOARD = "https://www.infojobs.com.br/vaga-de-x__"


@query(f"""WITH f AS (SELECT p_partkey AS k, p_name, p_brand, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part)
SELECT k AS page_id, p_name AS title, '{BOARD}' || k || '.aspx' AS url, CASE WHEN k % 3 = 2 THEN 'Empresa Dois' ELSE replace(p_brand, '#', ' ') END AS company,
  CASE WHEN k % 3 = 2 THEN 'Natal, RN' ELSE 'Recife' END AS location_text, CASE k % 3 WHEN 1 THEN NULL ELSE 'R$ ' || price || ',00' END AS salary_text FROM f""")
def listing_roundtrip(spark, folder):
    key = F.col("p_partkey")
    text = key.cast("string")
    price = F.concat(F.lit("R$ "), F.floor("p_retailprice").cast("string"), F.lit(",00"))
    url = F.concat(F.lit(BOARD), text, F.lit(".aspx"))
    company = F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))
    state = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("p_name").alias("title"), F.concat(F.lit("/vaga-de-x__"), text, F.lit(".aspx")).alias("url"), F.struct(company.alias("name")).alias("company"),
        F.lit("Recife").alias("cidade"), price.alias("salary"))).alias("items")).alias("props")))
    ld = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"), url.alias("url"),
                            F.struct(company.alias("name")).alias("hiringOrganization"), F.struct(F.lit("Recife").alias("name")).alias("jobLocation")))
    link = F.concat(F.lit('<div><a class="t" href="/vaga-de-x__'), text, F.lit('.aspx"><span>'), F.col("p_name"),
                    F.lit("</span></a><p>Empresa: Empresa Dois</p><p>Local: Natal, RN</p><p>Salario: "), price, F.lit("</p></div>"))
    top = F.lit('<nav><a href="/empresas">Empresas</a></nav>')
    html = (
        F.when(key % 3 == 0, F.concat(top, F.lit('<script id="__NEXT_DATA__">'), state, F.lit("</script>"), link))
        .when(key % 3 == 1, F.concat(top, F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"), link)).otherwise(F.concat(top, link)))
    found = table(spark, folder, "part", heavy=True).select(
        key.alias("page_id"), F.lit("https://www.infojobs.com.br/vagas.aspx").alias("page_url"), F.lit("board").alias("source_name"), html.alias("html"))
    return ex.extract_listing(found).select("page_id", "title", "url", "company", "location_text", "salary_text")


_LINKS = """SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', ['href', 'label'])) AS a,
  generate_subscripts(regexp_extract_all(html, '(?is)<a[^>]*href="[^"]+"[^>]*>'), 1) AS pos FROM pages"""


@query(f"""WITH l AS ({_LINKS}), u AS (SELECT page_id, pos, {s_html('a.label')} AS title, regexp_extract(url, '^(https?://[^/?#]*)', 1) || a.href AS url FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY pos) AS rn FROM u WHERE title <> '')
SELECT page_id, title, url FROM r WHERE rn = 1""")
def links_first_per_url(spark, folder):
    from postingflow.operators.scan import first_per_key

    found = ex.extract_anchors(pages(spark, folder), '[^"]+')
    return first_per_key(found, ["page_id"], F.col("url"), ["ord"]).select("page_id", "title", "url")


_JOB_LINKS = _LINKS.replace("html,", "replace(html, 'href=\"/', 'href=\"/job/'),")


@query(f"""WITH l AS ({_JOB_LINKS}), u AS (SELECT page_id, pos, {s_html('a.label')} AS title, regexp_extract(url, '^(https?://[^/?#]*)', 1) || a.href AS url FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY pos) AS rn FROM u WHERE length(title) >= 4)
SELECT page_id, title, url, coalesce(nullif(regexp_extract(url, '(?i)[?&](id|iv|jobid)=(\\d+)', 2), ''), nullif(regexp_extract(url, '(\\d{{5,}})', 1), ''),
  'url:' || left(sha256(lower(url)), 16)) AS source_job_id FROM r WHERE rn = 1""")
def links_with_tail(spark, folder):
    html = F.replace(F.col("html"), F.lit('href="/'), F.lit('href="/job/'))
    return ex.extract_anchor_tail(pages(spark, folder).withColumn("html", html)).select("page_id", "title", "url", "source_job_id")


_BODY = "regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g')"
_MARK = '<body><section id="job-description"><h2>Requisitos</h2>'
_SECTION = "'(?is)<(?:section|div)[^>]*(?:description|descricao|requirements|responsabilidades)[^>]*>(.*?)</(?:section|div)>'"


@query(f"""WITH f AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace({_BODY}, '<body>', '{_MARK}') ELSE {_BODY} END AS b FROM pages),
g AS (SELECT page_id, CASE WHEN page_id % 2 = 0 AND regexp_matches(b, {_SECTION}) THEN regexp_extract(b, {_SECTION}, 1) ELSE b END AS b FROM f)
SELECT page_id, {s_html('b')} AS description FROM g""")
def detail_text(spark, folder):
    marked = F.replace(F.col("html"), F.lit("<body>"), F.lit(_MARK))
    html = F.when(F.col("page_id") % 2 == 0, marked).otherwise(F.col("html"))
    return pages(spark, folder).select("page_id", ex.detail_description(html).alias("description"))


@query(f"""WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, text FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id AS page_id, CASE WHEN rn <= CASE WHEN source = 'src1' THEN 3 ELSE 10 END THEN {s_collapse('text')} ELSE '' END AS description FROM f
UNION ALL SELECT doc_id, 'kept' FROM documents WHERE doc_id % 2 = 1""")
def enrich_within_budget(spark, folder):
    key = F.col("doc_id")
    docs = table(spark, folder, "documents")
    none = F.lit(None).cast("string")
    raw = docs.select(
        F.col("source").alias("source_name"), F.lit("listing").alias("family"), key.alias("page_id"), F.lit(0).cast("long").alias("ord"),
        F.concat(F.lit(f"{HOST}/"), key.cast("string")).alias("url"), none.alias("external_path"), none.alias("source_job_id"),
        F.when(key % 2 == 0, "").otherwise("kept").alias("description"))
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    details = docs.select((key + 1000000).alias("page_id"), F.concat(F.lit(f"{HOST}/"), key.cast("string")).alias("page_url"),
                          F.col("source").alias("source_name"), F.concat(F.lit("<p>"), safe, F.lit("</p>")).alias("html"))
    options = registry(spark, {"source_name": "src1", "max_detail": 3})
    return ex.enrich_details(raw, details, options, 10).select("page_id", "description")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT 'run' AS run, doc_id // 3 AS page_id, doc_id % 3 AS ord, source AS source_name FROM f WHERE rn <= CASE source WHEN 'src1' THEN 7 WHEN 'src2' THEN 1 ELSE 20 END
UNION ALL SELECT 'open', doc_id // 3, doc_id % 3, source FROM f WHERE rn <= CASE source WHEN 'src1' THEN 7 WHEN 'src2' THEN 1 ELSE rn END""")
def cap_per_source(spark, folder):
    key = F.col("doc_id")
    raw = table(spark, folder, "documents").select(F.floor(key / 3).alias("page_id"), F.col("source").alias("source_name"), (key % 3).alias("ord"))
    options = registry(spark, {"source_name": "src1", "max_items": 7}, {"source_name": "src2", "max_items": 1}, {"source_name": "src3", "max_items": 0})
    capped = [ex.cap_items(raw, options, cap).select(F.lit(name).alias("run"), "page_id", "ord", "source_name") for name, cap in (("run", 20), ("open", None))]
    return capped[0].unionByName(capped[1])


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN NULL ELSE 5 END AS n, o_orderkey % 13 = 0 AS blocked FROM orders),
e AS (SELECT o_custkey, min(o_orderkey) AS first_end FROM l WHERE n = 0 OR blocked GROUP BY o_custkey)
SELECT o_custkey AS source_name, o_orderkey AS page_no FROM l LEFT JOIN e USING (o_custkey) WHERE n IS NOT NULL AND (first_end IS NULL OR o_orderkey < first_end)""")
def stop_at_empty_page(spark, folder):
    key = F.col("o_orderkey")
    listing = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("source_name"), key.alias("page_no"),
        F.when(key % 11 == 0, 0).when(key % 7 == 0, F.lit(None)).otherwise(5).alias("n_items"), (key % 13 == 0).alias("blocked"))
    return ex.truncate_pages(listing).select("source_name", "page_no")


@query("""SELECT s_name AS source_name, CAST(p AS INTEGER) AS page_no, CAST((p - 1) * (10 + s_suppkey % 3) AS INTEGER) AS "offset"
FROM supplier, generate_series(1, 3) g(p) WHERE p <= 1 + s_suppkey % 3""")
def listing_page_grid(spark, folder):
    key = F.col("s_suppkey")
    options = table(spark, folder, "supplier").select(
        F.col("s_name").alias("source_name"), (key % 3 + 10).cast("int").alias("page_size"), (key % 3 + 1).cast("int").alias("max_pages"))
    return ex.page_grid(options).select("source_name", "page_no", "offset")


@query("""SELECT s_suppkey, 'https://s' || s_suppkey || '.gupy.io/' AS endpoint, 0 AS position FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'https://s' || s_suppkey || '.gupy.io/jobs.json', 1 FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'https://s' || s_suppkey || '.gupy.io/jobs', 2 FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'https://s' || s_suppkey || '.example.com/jobs', 0 FROM supplier WHERE s_suppkey % 2 = 1""")
def endpoint_list(spark, folder):
    key = F.col("s_suppkey")
    text = F.concat(F.lit("https://s"), key.cast("string"))
    url = F.when(key % 2 == 0, F.concat(text, F.lit(".gupy.io"))).otherwise(F.concat(text, F.lit(".example.com/jobs")))
    found = ex.endpoint_candidates(table(spark, folder, "supplier").select(key.cast("string").alias("source_name"), url.alias("start_url")))
    return found.select(F.col("source_name").cast("long").alias("s_suppkey"), "endpoint", "position")


@query(f"""SELECT source_name, verdict, count(*) AS n_pages FROM (SELECT 'w' || page_id % 3 AS source_name,
  CASE WHEN page_id % 10 IN (0, 1) OR contains({s_norm('html')}, 'captcha') THEN 'blocked' WHEN page_id % 10 = 2 THEN 'failed' WHEN page_id % 10 = 3 THEN 'blocked' ELSE 'ok' END AS verdict FROM pages)
GROUP BY source_name, verdict""")
def blocked_pages(spark, folder):
    key = F.col("page_id")
    status = F.when(key % 10 == 0, 403).when(key % 10 == 1, 429).when(key % 10 == 2, 500).otherwise(200)
    found = pages(spark, folder).select(
        "page_id", F.concat(F.lit("w"), (key % 3).cast("string")).alias("source_name"), status.alias("status"),
        F.when(key % 10 == 3, F.concat(F.col("html"), F.lit("<p>Please VERIFY you are: human</p>"))).otherwise(F.col("html")).alias("html"))
    return scans.blocked_counts(found)


@query(f"""SELECT doc_id AS page_id, CASE WHEN length({s_trim('CASE WHEN doc_id % 5 = 0 THEN lang ELSE text END')}) < 6 THEN 'short title' WHEN doc_id % 6 = 0 THEN 'unknown company'
  WHEN doc_id % 7 = 0 THEN 'blank location' END AS reject_reason FROM documents""")
def gate_reasons(spark, folder):
    key = F.col("doc_id")
    raw = table(spark, folder, "documents").select(
        key.alias("page_id"), F.when(key % 5 == 0, F.col("lang")).otherwise(F.col("text")).alias("title"),
        F.when(key % 6 == 0, " UNKNOWN").otherwise(F.col("source")).alias("company"), F.when(key % 7 == 0, " ").otherwise(F.col("lang")).alias("location_text"))
    ok, bad = quality_gate(raw)
    return ok.select("page_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(bad.select("page_id", "reject_reason"))


@query("""SELECT doc_id AS item_index, CASE WHEN doc_id % 5 = 0 THEN 'title is required' WHEN doc_id % 7 = 0 THEN 'company.name is required'
  WHEN doc_id % 11 = 0 THEN 'sourceUrl or originUrl is required' END AS message FROM documents""")
def item_validation(spark, folder):
    key = F.col("doc_id")
    items = table(spark, folder, "documents").select(
        F.lit("b").alias("batch_id"), key.alias("item_index"), F.lit(None).cast("string").alias("source_job_id"),
        F.when(key % 5 == 0, " \t").otherwise(F.col("text")).alias("title"), F.when(key % 7 != 0, F.col("source")).alias("company_name"),
        F.when(key % 11 == 0, "").otherwise("u").alias("source_url"), F.lit(None).cast("string").alias("origin_url"))
    ok, errors = validate_items(items)
    return ok.select("item_index", F.lit(None).cast("string").alias("message")).unionByName(errors.select("item_index", "message"))


@query("""WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey AS batch_id, n AS received, CASE WHEN n > 12 THEN 'Batch size exceeds maximum allowed (12). Received ' || n || ' items.' ELSE '' END AS message FROM b""")
def batch_size_guard(spark, folder):
    item = F.struct(F.col("o_orderkey").alias("title"))
    requests = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.collect_list(item).alias("items"))
    ok, rejected = scans.guard_batch(requests, 12)
    return ok.select("batch_id", F.size("items").cast("long").alias("received"), F.lit("").alias("message")).unionByName(
        rejected.select("batch_id", F.col("received").cast("long").alias("received"), "message"))

"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingflow.functions import identity as idn, infer, text as tx
from postingflow.operators.dedupe import duplicate_groups
from postingflow.operators.rank import rank_score
from postingflow.plans.catalog.common import pages, pick, registrar, s_entities, s_html, s_norm, s_pick, s_print, table
from postingflow.schema import enum_code, enum_name

QUERIES, query = registrar()

MODES = ("Remoto", "Trabalho híbrido", "PRESENCIAL", "onsite/hybrid", "a combinar")
KINDS = ("CLT", "Estágio em TI", "Contractor PJ", "Temporário", "international team", "full time")
SKILLS = ("C# e .NET", "React + TypeScript", "Postgres/Kafka", "Java e Docker", "Kubernetes na AWS", "nada")
PLACES = ("São Paulo, SP", "Curitiba - PR", "Lisboa", "Brasil (remoto)", " ")


@query(f"SELECT doc_id, {s_norm('text')} AS folded FROM documents")
def normalize_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("folded"))


@query(f"""
WITH p AS (SELECT source, {s_print('lang', 'text', "''", "'Remote'")} AS fingerprint FROM documents)
SELECT fingerprint, count(*) AS n_postings, count(DISTINCT source) AS n_sources,
       string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM p GROUP BY fingerprint HAVING count(*) > 1""")
def fingerprint_duplicates(spark, folder):
    docs = table(spark, folder, "documents")
    prints = idn.fingerprint(F.col("lang"), F.col("text"), F.lit(""), F.lit("Remote"))
    return duplicate_groups(docs.select(prints.alias("fingerprint"), F.col("source").alias("source_name")))


@query(f"SELECT page_id, {s_html('html')} AS body FROM pages")
def html_to_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.html_text(F.col("html")).alias("body"))


_UI = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', '', 'g')"


@query(f"""SELECT page_id, trim(replace(replace(replace(replace(replace({_UI}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), e' \\t\\n\\r') AS body FROM pages""")
def strip_html_for_display(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.strip_html_ui(F.col("html")).alias("body"))


_HINT = f"{s_pick('doc_id', *MODES)} || ' ' || lang || ' ' || text"


@query(f"""WITH f AS (SELECT doc_id, {s_norm(_HINT)} AS t, lower({s_pick('doc_id', *MODES)}) AS m FROM documents)
SELECT doc_id,
  CASE WHEN t LIKE '%remote%' OR t LIKE '%remoto%' THEN 'Remote' WHEN t LIKE '%hybrid%' OR t LIKE '%hibrido%' THEN 'Hybrid'
       WHEN t LIKE '%onsite%' OR t LIKE '%presencial%' THEN 'Onsite' ELSE 'Unknown' END AS work_mode,
  CASE WHEN m LIKE '%remote%' OR m LIKE '%remoto%' THEN 'Remote' WHEN m LIKE '%híbrido%' OR m LIKE '%hibrido%' THEN 'Hybrid'
       ELSE 'Unknown' END AS sample_mode
FROM f""")
def work_mode(spark, folder):
    hint = pick(F.col("doc_id"), *MODES)
    return table(spark, folder, "documents").select(
        "doc_id", infer.infer_work_mode(hint, F.col("lang"), F.col("text")).alias("work_mode"),
        infer.infer_work_mode_location(hint).alias("sample_mode"))


@query(f"""WITH f AS (SELECT o_orderkey, {s_norm(s_pick('o_orderkey', *KINDS) + " || ' ' || o_orderpriority")} AS t,
  {s_norm(s_pick('o_orderkey', *KINDS))} AS k FROM orders)
SELECT o_orderkey,
  CASE WHEN t LIKE '%intern%' OR t LIKE '%estagio%' THEN 'Internship' WHEN t LIKE '%contractor%' OR t LIKE '%pj%' THEN 'Contractor'
       WHEN t LIKE '%temporary%' OR t LIKE '%temporario%' THEN 'Temporary' WHEN t LIKE '%clt%' THEN 'CLT' ELSE 'Unknown' END AS employment,
  CASE WHEN k LIKE '%intern%' THEN 'Internship' WHEN k LIKE '%temp%' THEN 'Temporary' WHEN k LIKE '%contract%' THEN 'Contractor'
       ELSE 'Unknown' END AS workday_employment
FROM f""")
def employment(spark, folder):
    kind = pick(F.col("o_orderkey"), *KINDS)
    return table(spark, folder, "orders").select(
        "o_orderkey", infer.infer_employment(kind, F.col("o_orderpriority")).alias("employment"),
        infer.infer_employment_workday(kind).alias("workday_employment"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[ãõçáéíóú]') THEN 'pt-BR' ELSE 'en' END AS languages,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN regexp_matches(lower(text), '[ãõçáéíóú]') THEN 'pt-BR' ELSE 'en' END AS structured_languages
FROM documents""")
def languages(spark, folder):
    some = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(infer.infer_languages(F.col("text")), ",").alias("languages"),
        F.array_join(infer.infer_languages(some, []), ",").alias("structured_languages"))


def _sql_tags(words: list[tuple[str, str]], folded: bool) -> str:
    short = {".net": "net", "asp.net": "asp net", "c#": "c"}
    tags: dict[str, list[str]] = {}
    for needle, tag in words:
        tags.setdefault(tag, []).append(f"contains(r, '{needle}')" + (f" OR contains(t, '{short.get(needle, needle)}')" if folded else ""))
    return "concat_ws(','," + ", ".join(f"CASE WHEN {' OR '.join(c)} THEN '{tag}' END" for tag, c in tags.items()) + ")"


_SKILL = s_pick("p_partkey", *SKILLS)


@query(f"""WITH f AS (SELECT p_partkey, lower({_SKILL} || ' ' || p_name) AS r, {s_norm(_SKILL + " || ' ' || p_name")} AS t FROM part)
SELECT p_partkey, {_sql_tags(infer.TAG_WORDS, True)} AS tags, {_sql_tags(infer.SAMPLE_TAG_WORDS, False)} AS sample_tags FROM f""")
def tags(spark, folder):
    skill = pick(F.col("p_partkey"), *SKILLS)
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(infer.infer_tags(skill, F.col("p_name"), "compat"), ",").alias("tags"),
        F.array_join(infer.infer_tags_sample(skill, F.col("p_name")), ",").alias("sample_tags"))


_TOKEN_SKILL = {n: f"regexp_matches(r, '(^|[^\\p{{L}}\\p{{Nd}}]){n}($|[^\\p{{L}}\\p{{Nd}}#+])')" for n in ("react", "java", "docker", "kafka", "aws")}


@query(f"""WITH f AS (SELECT p_partkey, lower({_SKILL} || ' ' || p_name) AS r FROM part)
SELECT p_partkey, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _TOKEN_SKILL.items())}) AS tags FROM f""")
def tags_by_word(spark, folder):
    found = infer.infer_tags(pick(F.col("p_partkey"), *SKILLS), F.col("p_name"))
    order = F.array(*[F.lit(n) for n in _TOKEN_SKILL])
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_intersect(order, found), ",").alias("tags"))


_LOW, _HIGH = "CAST(floor(o_totalprice) AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT) + 500"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE {_LOW} END AS low,
  CASE o_orderkey % 4 WHEN 0 THEN {_HIGH} WHEN 3 THEN NULL ELSE {_LOW} END AS high,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'BRL' END AS currency, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'month' END AS period FROM orders""")
def salary(spark, folder):
    key, low = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    grouped = F.translate(F.format_number(low, 0), ",", ".")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("R$ "), grouped, F.lit(",00 a "), (low + 500).cast("string"), F.lit(" por mês")))
        .when(key % 4 == 1, F.concat(F.lit("r$"), grouped)).when(key % 4 == 2, F.concat(F.format_number(low, 2), F.lit(" total")))
        .otherwise(F.lit("a combinar todo mês")))
    found = table(spark, folder, "orders").select("o_orderkey", infer.parse_salary(text).alias("s"))
    return found.select("o_orderkey", F.col("s.min").cast("long").alias("low"), F.col("s.max").cast("long").alias("high"),
                        F.col("s.currency").alias("currency"), F.col("s.period").alias("period"))


@query(f"""SELECT c_custkey, {s_pick('c_custkey', 'BR', 'BR', '', 'BR', '')} AS country,
  {s_pick('c_custkey', 'Remote', 'Senior', 'ExternalIngestion', 'Gupy')} AS parsed,
  CAST({s_pick('c_custkey', '1', '4', '50', '10')} AS INTEGER) AS code, {s_pick('c_custkey', 'LinkedIn', 'Fixture', 'Vagas')} AS sample_type FROM customer""")
def enums_and_country(spark, folder):
    key = F.col("c_custkey")
    raw = pick(key, " remote", "4", "???", "GUPY")
    kind = pick(key, "WorkMode", "Seniority", "SourceType", "SourceType")
    parsed = F.when(kind == "WorkMode", infer.parse_enum(raw, "WorkMode")).when(kind == "Seniority", infer.parse_enum(raw, "Seniority")).otherwise(
        infer.parse_enum(raw, "SourceType", "ExternalIngestion"))
    code = F.when(kind == "WorkMode", enum_code(parsed, "WorkMode")).when(kind == "Seniority", enum_code(parsed, "Seniority")).otherwise(
        enum_code(parsed, "SourceType"))
    back = enum_name(enum_code(infer.source_type_from_name(pick(key, "LINKEDIN", "other", " vagas ")), "SourceType"), "SourceType")
    return table(spark, folder, "customer").select(
        "c_custkey", F.coalesce(infer.infer_country(pick(key, *PLACES)), F.lit("")).alias("country"), parsed.alias("parsed"),
        code.cast("int").alias("code"), back.alias("sample_type"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '(?i)[?&](id|iv|jobid)=(\d+)', 2), ''), nullif(regexp_extract(url, '(\d{5,})', 1), ''),
  'url:' || left(sha256(lower(trim(url))), 16)) AS job_id, 'url:' || left(sha256(lower(trim(url))), 16) AS url_id,
  regexp_extract(regexp_replace(split_part(url, '?', 1), '/+$', ''), '([^/]*)$', 1) AS segment FROM pages""")
def url_ids(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", idn.stable_job_id(F.lit(None).cast("string"), url).alias("job_id"), idn.url_hash_id(url).alias("url_id"),
        idn.last_segment(url).alias("segment"))


_ORIGIN, _DIR = "regexp_extract(url, '^(https?://[^/?#]*)', 1)", "regexp_extract(url, '^https?://[^/?#]*([^?#]*/)', 1)"


@query(f"""SELECT page_id, {_ORIGIN} || '/a/b?x=1' AS rooted, {_ORIGIN} || {_DIR} || 'p' || page_id AS relative,
  regexp_extract(url, '^(https?:)', 1) || '//cdn.example.com/x' AS schemeless, split_part(url, '#', 1) || '#top' AS anchored, 'mailto:a@b' AS other FROM pages""")
def absolute_urls(spark, folder):
    base = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", idn.absolutize(F.lit("/a/z/../b?x=1"), base).alias("rooted"),
        idn.absolutize(F.concat(F.lit("./p"), F.col("page_id").cast("string")), base).alias("relative"),
        idn.absolutize(F.lit("//cdn.example.com/x"), base).alias("schemeless"), idn.absolutize(F.lit("#top"), base).alias("anchored"),
        idn.absolutize(F.lit("mailto:a@b"), base).alias("other"))


@query("""SELECT c_custkey, 'b,a' || CASE WHEN c_custkey % 2 = 0 THEN ',' || lower(c_mktsegment) ELSE '' END AS tags,
  lower(c_name) || '@example.com' AS email, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name FROM customer""")
def small_text_helpers(spark, folder):
    key, name = F.col("c_custkey"), F.col("c_name")
    listed = F.concat(F.lit(" B ,a,,b"), F.when(key % 2 == 0, F.concat(F.lit(", "), F.col("c_mktsegment"), F.lit(",A"))).otherwise(""))
    return table(spark, folder, "customer").select(
        "c_custkey", F.array_join(tx.parse_tag_csv(listed), ",").alias("tags"),
        tx.normalize_email(F.concat(F.lit("  "), name, F.lit("@Example.com\t"))).alias("email"),
        tx.null_if_blank(F.when(key % 3 == 0, F.lit(" \n")).otherwise(name)).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate - CASE WHEN o_orderkey % 3 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS posted,
  strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') AS floor FROM orders""")
def dates(spark, folder):
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(key % 3 == 0, day).when(key % 3 == 1, F.concat(day, F.lit("T00:00:00+02:00"))).otherwise("Posted Today")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(tx.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("posted"),
        F.date_format(tx.posted_from(F.col("o_orderdate"), 30), "yyyy-MM-dd").alias("floor"))


NOW = "2024-06-30 00:00:00"


@query(f"""WITH f AS (SELECT d.doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'Vaga!' ELSE source END AS title,
  date_diff('day', TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 180 AS INTEGER)), TIMESTAMP '{NOW}') AS age, coalesce(l.quality, 0) AS fits
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(round(0.5 * exp(-age / 14.0) + 0.1 * CAST({s_norm('text')} <> '' AS DOUBLE) + 0.1 * CAST(doc_id % 2 AS DOUBLE) + 0.1 * CAST(doc_id % 3 <> 0 AS DOUBLE)
  + 0.2 * fits - 0.3 * CAST(length(text) < 200 AS DOUBLE) - 0.3 * CAST(title = 'Vaga!' AS DOUBLE), 6), 4) AS score FROM f""")
def rank(spark, folder):
    key = F.col("doc_id")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    df = table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.when(key % 10 == 0, F.lit("Vaga!")).otherwise(F.col("source")).alias("title"), F.col("text").alias("description_text"),
        F.when(key % 2 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(key % 3 == 0, "Unknown").otherwise("Remote").alias("work_mode"), "quality",
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(key % 180).cast("int"))).alias("posted_at"),
        F.lit(None).cast("timestamp").alias("captured_at"))
    scored = rank_score(df, F.lit(NOW).cast("timestamp"), F.col("quality") == 1)
    return scored.select("doc_id", F.round("score", 4).alias("score"))


@query(f"SELECT page_id, {s_entities('html')} AS decoded FROM pages")
def decode_references(spark, folder):
    return pages(spark, folder).select("page_id", tx.html_unescape(F.col("html")).alias("decoded"))

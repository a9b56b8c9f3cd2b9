import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from postingflow.operators import dedupe, favorites as fav, lifecycle as lc, posting, quality, rank, search as se, similar, views
from postingflow.schema import RAW_SCHEMA
from test_sources import registry_frame, state_frame, state_row


def raw_frame(spark, *rows):
    names = [f.name for f in RAW_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_SCHEMA)


def test_to_posting_by_family(spark):
    reg = registry_frame(
        spark, {"source_name": "Board", "source_type": "InfoJobs"}, {"source_name": "Ld", "source_type": "JsonLd", "start_url": "https://l"},
        {"source_name": "Corp", "source_type": "CorporateCareers"}, {"source_name": "G", "source_type": "Gupy", "start_url": "https://g"},
        {"source_name": "Wd", "source_type": "Workday", "company": "Accenture", "tenant": "t", "site_name": "S"})
    rows = [
        {"source_name": "Board", "family": "listing", "ord": 0, "title": "Dev", "company": "A", "url": "https://h/123456", "salary_text": "R$ 8.000 por mes", "location_text": "Remoto"},
        {"source_name": "Ld", "family": "jsonld", "ord": 1, "title": "Dev", "company": "Unknown", "url": "u", "employment_text": "CLT", "description": ""},
        {"source_name": "Corp", "family": "jsonld", "ord": 2, "title": "Dev C#", "company": " ", "url": "u", "description": "Híbrido, ação"},
        {"source_name": "G", "family": "gupy", "ord": 3, "title": "Dev", "url": "u", "location_text": "SP", "work_mode_text": "onsite"},
        {"source_name": "Wd", "family": "workday", "ord": 4, "title": "Dev", "url": "u", "employment_text": "Contract"},
        {"source_name": "LinkedIn", "family": "sample", "ord": 5, "title": "Dev .NET", "company": "Z", "url": "u", "location_text": "São Paulo, SP - híbrido", "description": "Kafka"},
    ]
    got = {r.ord: r for r in posting.to_posting(raw_frame(spark, *rows), reg).collect()}
    assert got[0].salary["max"] == 8000 and got[0].salary["currency"] == "BRL" and got[0].work_mode == "Remote"
    assert got[0].source["source_job_id"] == "123456" and got[0].languages == ["pt-BR"]
    assert (got[1].employment_type, got[1].languages, got[1].metadata["parser"]) == ("CLT", [], "json-ld")
    assert (got[2].company["name"], got[2].work_mode, got[2].languages, got[2].tags) == ("Corp", "Hybrid", ["pt-BR"], ["csharp"])
    assert (got[3].company["name"], got[3].work_mode) == ("G", "Onsite")
    assert (got[4].company["name"], got[4].employment_type, got[4].languages) == ("Accenture", "Contractor", ["pt-BR", "en-US"])
    assert got[4].metadata["listEndpointPath"] == "/wday/cxs/t/S/jobs"
    assert (got[5].source["type"], got[5].location["country"], got[5].tags, got[5].work_mode) == ("LinkedIn", "BR", ["dotnet", "kafka"], "Hybrid")
    flat = posting.to_entity(posting.with_run_ts(posting.to_posting(raw_frame(spark, *rows), reg), F.lit(datetime(2024, 1, 1))), F.col("ord").cast("string"))
    doc = posting.to_search_doc(flat).filter("id = '0'").first()
    assert (doc.company, doc.companyName, doc.workMode, doc.status) == ("A", "A", "Remote", "Active")


def test_quality(spark):
    rows = [{"family": "listing", "title": "abcdef", "company": "A", "location_text": "SP"}, {"family": "listing", "title": " abc ", "company": "A", "location_text": "SP"},
            {"family": "listing", "title": "abcdef", "company": " UNKNOWN ", "location_text": "SP"}, {"family": "listing", "title": "abcdef", "company": "A", "location_text": " "},
            {"family": "gupy", "title": "x"}]
    ok, bad = quality.quality_gate(raw_frame(spark, *rows))
    assert ok.count() == 2 and sorted(r.reject_reason for r in bad.collect()) == ["blank location", "short title", "unknown company"]
    items = spark.createDataFrame([("b", 0, None, "t", "c", "u", None), ("b", 1, "x", " ", "c", "u", None), ("b", 2, None, "t", None, "u", None), ("b", 3, None, "t", "c", " ", None)],
                                  "batch_id string, item_index int, source_job_id string, title string, company_name string, source_url string, origin_url string")
    ok, errors = quality.validate_items(items)
    assert ok.count() == 1
    assert {r.item_index: r.message for r in errors.collect()} == {1: "title is required", 2: "company.name is required", 3: "sourceUrl or originUrl is required"}
    st = state_frame(spark, state_row(1, title="x" * 401, country="123456789"), state_row(2, title="Vaga!"))
    assert {(r.id, r.field, r.length) for r in quality.length_violations(st).collect()} == {("1", "title", 401), ("1", "country", 9)}
    assert quality.spam_flags(st).filter("generic_title").first().id == "2"


def test_lifecycle(spark):
    out = spark.createDataFrame([("b", 0, None, "Inserted", None), ("b", 1, None, "Duplicate", None), ("b", 2, None, "Invalid", "m"), ("b", 3, None, "Updated", None)],
                                "batch_id string, item_index int, source_job_id string, outcome string, message string")
    r = lc.batch_summary(out).first()
    assert (r.received, r.processed, r.inserted, r.updated, r.duplicates, r.invalid) == (4, 3, 1, 1, 1, 1)
    assert [e.item_index for e in lc.batch_errors(out).collect()] == [2]
    runs = lc.run_counters(spark.createDataFrame([("a", "T", "Inserted", None), ("a", "T", "Duplicate", None), ("b", "T", "Conflict", "boom")],
                                                 "source_name string, source_type string, outcome string, message string"), F.lit(datetime(2024, 1, 1)))
    got = {x.source_name: (x.status, x.fetched, x.indexed, x.duplicates, x.errors, x.error_sample) for x in runs.collect()}
    assert got == {"a": ("Success", 2, 1, 1, 0, None), "b": ("Failed", 1, 0, 0, 1, "boom")}
    now = F.lit(datetime(2024, 2, 1))
    st = state_frame(spark, state_row(1), state_row(2, last_seen_at=datetime(2024, 1, 31)), state_row(3, source_name="other"), state_row(4, status="Expired"))
    ran = spark.createDataFrame([("s", "Gupy")], "source_name string, source_type string")
    marked = lc.expire(st, ran, now)
    assert {r.id: (r.status, r.expired_now) for r in marked.collect()} == {"1": ("Expired", True), "2": ("Active", False), "3": ("Active", False), "4": ("Expired", False)}
    assert lc.expired_counts(marked).first().expired == 1
    m = {r.source_name: (r.runs, r.success_rate, r.active, r.expired) for r in lc.source_metrics(runs, st).collect()}
    assert m == {"a": (1, 1.0, 0, 0), "b": (1, 0.0, 0, 0), "s": (0, None, 2, 1), "other": (0, None, 1, 0)}


def doc_rows(spark):
    st = state_frame(
        spark, state_row(1, title="Senior Java Engineer", company_name="Acme", tags=["java"], posted_at=datetime(2024, 1, 3)),
        state_row(2, title="Dev", company_name="Java House", tags=["kotlin"], posted_at=datetime(2024, 1, 5), location_text="São Paulo"),
        state_row(3, title="Javascript Dev", company_name="Acme", tags=["javascript"], work_mode="Hybrid"),
        state_row(4, title="Java", status="Expired", posted_at=datetime(2024, 1, 9)))
    return posting.to_search_doc(st)


def more_doc_rows(spark):
    st = state_frame(spark, state_row(5, title="がくせい m² " + "z" * 300), state_row(6, title="か\u3099くせい", work_mode="Hybrid"))
    return doc_rows(spark).unionByName(posting.to_search_doc(st))


def test_search(spark):
    docs = doc_rows(spark)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(se.search(docs)) == ["2", "1", "3"]
    assert ids(se.search(docs, sort="postedAt:asc")) == ["1", "2", "3"]
    assert ids(se.search(docs, q="java")) == ["1", "3", "2"]
    assert ids(se.search(docs, q="java dev")) == ["2"]
    assert ids(se.search(docs, q="SENOIR java", typos=True)) == []
    assert ids(se.search(docs, q="seniar java", typos=True)) == ["1"]
    assert ids(se.search(docs, work_mode="hybrid", company="acme")) == ["3"]
    assert ids(se.search(docs, tags="KOTLIN, java")) == ["2", "1"]
    assert ids(se.search(docs, posted_from=date(2024, 1, 4))) == ["2"]
    assert ids(se.search(docs, page=2, page_size=2)) == ["3"]
    assert ids(se.search(docs, seniority="nonsense", page_size=500)) == ["2", "1", "3"]
    assert se.count_hits(docs, page_size=2).first().asDict() == {"total": 3, "pages": 2}
    got = {(r.attribute, r.value): r.n for r in se.facets(docs).collect()}
    assert got[("workMode", "Remote")] == 2 and got[("tags", "kotlin")] == 1
    assert se.get_posting(docs, "4").count() == 1


def test_batch_search_equals_single(spark):
    docs = more_doc_rows(spark)
    assert [r.id for r in se.search(docs, q="がくせい").collect()] == ["5", "6"] and [r.id for r in se.search(docs, q="m² z").collect()] == ["5"]
    assert {r.id for r in se.search(docs, q="remote").collect()} >= {"1", "2"}
    assert se.count_hits(docs, q="seniar java", typos=True).first().total == 1
    params = ["q", "tags", "workMode", "seniority", "employmentType", "company", "location", "sourceName", "postedFrom"]
    asked = [{"q": "java"}, {"q": "java dev"}, {"company": "ACME"}, {"q": "java", "tags": "java,kotlin"}, {"workMode": "Remote", "postedFrom": "2024-01-04T10:00:00Z"},
             {"q": "missing java"}, {"q": "java"}, {"location": "são paulo", "q": "d"}, {}, {"postedFrom": "2024-01-04T10:00:00Z"}, {"q": "remote"}, {"q": "m² がく"}, {"q": "がくせ"}, {"q": "z" * 250}, {"q": "gupy hyb"}]
    queries = spark.createDataFrame([(i, *[a.get(p) for p in params]) for i, a in enumerate(asked)], "query_id int, " + ", ".join(f"{p} string" for p in params))
    got = {}
    for r in se.batch_search(queries, docs, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    names = {"workMode": "work_mode", "sourceName": "source_name", "postedFrom": "posted_from"}
    for i, a in enumerate(asked):
        kw = {names.get(k, k): (date(2024, 1, 4) if k == "postedFrom" else v) for k, v in a.items()}
        assert got.get(i, []) == [r.id for r in se.search(docs, page_size=2, **kw).collect()], a


def test_pages_by_cursor_equal_offset_pages(spark):
    rows = [(str(i), "java go" if i % 2 else "java", None if i % 5 == 0 else datetime(2024, 1, 1 + i % 3), None if i % 7 == 0 else datetime(2024, 2, 1 + i % 2, 3, 4, 5, 678901))
            for i in range(23)]
    docs = spark.createDataFrame(rows, "id string, title string, postedAt timestamp, capturedAt timestamp").withColumns(
        {c: F.lit(None).cast("string") for c in ("company", "locationText", "workMode", "seniority", "employmentType", "sourceName", "status")}).withColumn("tags", F.array(F.lit("go")))
    for sort in (None, "postedAt:asc", "capturedAt:asc", "capturedAt:desc"):
        for q in (None, "go"):
            want = [r.id for r in se.search(docs, q=q, sort=sort, page_size=100).collect()]
            got, cursor = [], None
            while page := se.search_after(docs, cursor, q=q, sort=sort, page_size=9).collect():
                got, cursor = got + [r.id for r in page], page[-1].cursor
            assert got == want and len(got) == 23
    with pytest.raises(ValueError):
        se.search_after(docs, cursor, sort="postedAt:asc")


def test_batch_search_broadcasts_no_table_for_its_small_file(spark):
    """Titles that compress to nothing: the driver must not be given rows because their file is small."""
    docs = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.concat(F.repeat(F.lit("y"), 20_000), F.lit(" java")).alias("title"), F.array(F.lit("go")).alias("tags"),
        F.lit(datetime(2024, 1, 1)).alias("postedAt"), F.lit(datetime(2024, 2, 1)).alias("capturedAt"), F.lit("Active").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in ("company", "locationText", "workMode", "seniority", "employmentType", "sourceName")])
    params = ["q", "tags", "workMode", "seniority", "employmentType", "company", "location", "sourceName", "postedFrom"]
    queries = spark.createDataFrame([(1, "java y"), (2, "java")], "query_id int, q string").withColumns({p: F.lit(None).cast("string") for p in params[1:]})
    limits = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.maxBroadcastTableSize": "70m"}  # one page is 64 MB; beyond the second a join fails
    before = {c: spark.conf.get(c) for c in limits}
    try:
        for c, v in limits.items():
            spark.conf.set(c, v)
        got = [(r.query_id, r["rank"], r.id) for r in se.batch_search(queries, docs, 2).collect()]
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "256k"
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(got) == [(1, 1, "0"), (1, 2, "1"), (2, 1, "0"), (2, 2, "1")]


def test_batch_search_over_many_blocks(spark, monkeypatch):
    """Blocks of four documents: searches stop in different rounds, and equal to a plain evaluation of every search on its own."""
    monkeypatch.setattr(se, "BLOCK", 4)
    monkeypatch.setattr(se, "GROWTH", 2)
    rng = random.Random(7)
    words = ["java", "javascript", "go", "rust", "cook", "clerk"]
    rows = [(str(i), " ".join(rng.choices(words, k=2)), rng.choice(["Acme", "Go Ltd"]), rng.sample(words, 2), "Remote" if i % 3 else "Hybrid",
             None if i % 9 == 0 else datetime(2024, 1, 1 + rng.randrange(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id string, title string, company string, tags array<string>, workMode string, postedAt timestamp").withColumns({
        "capturedAt": F.lit(datetime(2024, 2, 1)), "locationText": F.lit("Rio"), "seniority": F.lit("Unknown"), "employmentType": F.lit("Unknown"),
        "sourceName": F.lit("src"), "status": F.when(F.col("id") == "11", "Expired").otherwise("Active")})
    params = ["q", "tags", "workMode", "seniority", "employmentType", "company", "location", "sourceName", "postedFrom"]
    asked = [{"q": w} for w in ("java", "jav", "rio", "go cook", "rust jav", "rio src r", "clerk clerk")]
    asked += [{"q": "c", "workMode": "hybrid"}, {"q": "go", "company": "acme", "tags": "rust,cook"}, {"workMode": "remote", "postedFrom": "2024-01-15"},
              {"tags": "go,java"}, {"q": "java", "postedFrom": "2024-01-12"}, {"location": "rio"}, {"q": "rio", "postedFrom": "2024-01-19"}]
    queries = spark.createDataFrame([(i, *[a.get(p) for p in params]) for i, a in enumerate(asked)], "query_id int, " + ", ".join(f"{p} string" for p in params))
    got = {}
    for r in se.batch_search(queries, docs, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)

    def alone(a):
        hits = []
        for i, title, company, tags, mode, posted in rows:
            fields = [title.split(), company.lower().split(), tags, ["rio"], [mode.lower()], ["unknown"], ["unknown"], ["src"]]
            if i == "11" or a.get("workMode", mode).lower() != mode.lower() or a.get("company", company).lower() != company.lower():
                continue
            if "tags" in a and not set(a["tags"].split(",")) & set(tags) or "postedFrom" in a and (posted is None or posted < datetime.fromisoformat(a["postedFrom"])):
                continue
            asked_words = a.get("q", "").split()
            best = [max([8 - f for f, terms in enumerate(fields) if any(t.startswith(w) if n == len(asked_words) - 1 else t == w for t in terms)], default=0)
                    for n, w in enumerate(asked_words)]
            if all(best):
                hits.append((-sum(best), posted is None, -posted.timestamp() if posted else 0, i))
        return {n + 1: (h[3], float(-h[0])) for n, h in enumerate(sorted(hits)[:5])}

    for i, a in enumerate(asked):
        assert got.get(i, {}) == alone(a), a


def test_views(spark):
    st = state_frame(spark, state_row(1, salary_currency="BRL"), state_row(2, salary_min=Decimal(1)))
    detail = {r.id: r for r in views.to_detail(st).collect()}
    assert detail["1"].salary is None and detail["2"].salary["min"] == 1 and detail["1"].metadata == {"k": "v"}
    items = views.to_list_item(posting.to_search_doc(st))
    assert items.first().company["name"] == "c"
    ui = views.to_ui_job(items).first()
    assert (ui.company, ui.applyUrl, ui.sourceName, ui.tags) == ("c", "https://h/1", "s", ["a"])
    flat = spark.createDataFrame([("1", " ", "Co", "a, ,b"), (" ", "t", "Co", None)], "id string, title string, company string, tags string")
    got = views.to_ui_job(flat).collect()
    assert len(got) == 1 and (got[0].title, got[0].company, got[0].tags) == (None, "Co", ["a", "b"])
    assert views.to_ui_favorite(items).columns == ["id", "title", "company", "location", "postedAt", "sourceName"]
    src = spark.createDataFrame([("1", " ", "T", None, True), ("2", "n", " ", "b", None)], "id string, name string, type string, base_url string, enabled boolean")
    assert [(r.id, r.type) for r in views.to_ui_source(src).collect()] == [("2", None)]
    params = ["q", "tags", "workMode", "seniority", "employmentType", "sourceName", "company", "location", "postedFrom", "sort", "page", "pageSize"]
    df = spark.createDataFrame([(" x ", None, "", None, "CONTRACT", None, "a" * 300, None, "2024-01-02", "recent", "2.9", "1000"),
                                (None, None, None, None, "weird", None, None, None, "nope", "CAPTUREDAT:ASC", "-1", "abc")], ", ".join(f"{p} string" for p in params))
    a, b = views.normalize_query(df).collect()
    assert (a.q, a.workMode, a.employmentType, len(a.company), a.postedFrom, a.sort, a.page, a.pageSize) == (
        "x", None, "Contractor", 200, "2024-01-02T00:00:00.000Z", "postedAt:desc", 2, 100)
    assert (b.employmentType, b.postedFrom, b.sort, b.page, b.pageSize) == ("weird", None, "capturedAt:asc", 1, 20)
    meta = spark.createDataFrame([('{"a":"1"}',), ("{bad",), (None,)], "m string").select(views.parse_metadata(F.col("m")).alias("m"))
    assert [r.m for r in meta.collect()] == [{"a": "1"}, {}, {}]


def test_rank_and_digest(spark):
    now = F.lit(datetime(2024, 1, 15))
    st = state_frame(spark, state_row(1, description_text="d" * 200, posted_at=datetime(2024, 1, 15)), state_row(2, title="Vaga", posted_at=datetime(2024, 1, 1)))
    got = {r.id: r.score for r in rank.rank_score(st, now).collect()}
    assert got == {"1": 0.8, "2": round(0.5 * 2.718281828459045 ** -1 + 0.2 - 0.6, 6)}
    lines = rank.digest(rank.rank_score(st, now), 1).orderBy("day").collect()
    assert lines[1].line == "1) t1 — c (Remote) https://h/1" and len(lines) == 2
    assert rank.card(st).filter("id='1'").first().message.split("\n")[0] == "🚀 t1"


def test_duplicates_and_matching(spark):
    st = state_frame(spark, state_row(1, fingerprint="f"), state_row(2, fingerprint="f", source_name="z"), state_row(3))
    r = dedupe.duplicate_groups(st).first()
    assert (r.fingerprint, r.n_postings, r.n_sources, r.sources) == ("f", 2, 2, "s,z")
    inc = spark.createDataFrame(
        [(0, None, "Gupy", "s", None, "https://h/2", "x"), (1, None, "Gupy", "s", None, "new", "f"), (2, None, "Gupy", "s", None, "new", "x")],
        "seq long, origin_url string, source_type string, source_name string, source_job_id string, source_url string, fingerprint string")
    assert {r.seq: (r.match_id, r.match_rank) for r in dedupe.match_bulk(inc, st).collect()} == {0: ("2", 3), 1: ("1", 4), 2: (None, None)}
    assert {r.seq: r.match_id for r in dedupe.match_crawl(inc, st).collect()} == {0: "2", 1: None, 2: None}


def test_near_terms_are_all_found(spark):
    """Every pair of words a few edits apart shares a deletion; the index answers like a scan of all terms."""
    rng = random.Random(8)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(300)} | {"x" * 30, "x" * 31, "y" * 600}
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(sorted(terms))], "id string, title string").select(
        "id", "title", *[F.lit(None).cast("array<string>" if f == "tags" else "string").alias(f) for f in se.TEXT_FIELDS[1:]])
    index = se.build_index(docs)
    near = index.near.groupBy("term").agg(F.collect_set("deletion").alias("deletions"))
    asks = spark.createDataFrame([("".join(rng.choice("abc") for _ in range(rng.randint(5, 14))),) for _ in range(40)] + [("x" * 29,), ("y" * 602,), ("y" * 603,)], "ask string")
    slack = F.when(F.length("ask") >= 9, 2).otherwise(1)
    pairs = asks.join(index.terms).where(F.levenshtein("ask", "term") <= slack).join(near, "term")
    missed = pairs.where(~F.arrays_overlap("deletions", se.deletions(F.col("ask"), slack)))
    assert pairs.count() > 10 and missed.count() == 0
    for (ask,) in asks.limit(2).collect() + [("y" * 602,)]:
        want = {r.id: 8.0 if r.title.startswith(ask) else 7.5 for r in docs.select("id", "title").collect()
                if r.title.startswith(ask) or _edits(ask, r.title) <= (2 if len(ask) >= 9 else 1)}
        assert {r.id: r.score for r in se.match_index(docs, index, ask).collect()} == want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_cluster_similar(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [("1", base), ("2", base + " extra"), ("3", base), ("4", "something quite different here"), ("5", base.replace("word7 ", ""))]
    df = spark.createDataFrame([(i, "t", "c", d) for i, d in rows], "id string, title string, company_name string, description_text string")
    got = {r.id: r.cluster_id for r in similar.cluster_similar(df, 0.8).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "1"}


def test_favorites(spark):
    users = spark.createDataFrame([("u",), ("w",)], "id string")
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    t = lambda d: datetime(2024, 1, d)
    held = spark.createDataFrame([("u", "a", t(1))], "user_id string, job_id string, created_at timestamp")
    cmds = spark.createDataFrame([(0, "x", "a", t(2)), (1, "u", "zz", t(2)), (2, "u", "a", t(2)), (3, "u", "b", t(2)), (4, "u", "b", t(3)), (5, "w", "a", t(4))],
                                 "seq long, user_id string, job_id string, at timestamp")
    after, status = fav.add_favorites(cmds, held, users, jobs)
    assert [r.status for r in status.orderBy("seq").collect()] == ["UserNotFound", "JobNotFound", "AlreadyExists", "Added", "AlreadyExists", "Added"]
    assert {(r.user_id, r.job_id, r.created_at.day) for r in after.collect()} == {("u", "a", 1), ("u", "b", 2), ("w", "a", 4)}
    assert [r.job_id for r in fav.list_favorites(after, jobs, "u").collect()] == ["b", "a"]
    left, status = fav.remove_favorites(spark.createDataFrame([(0, "u", "a"), (1, "u", "a"), (2, "w", "c")], "seq long, user_id string, job_id string"), after)
    assert [r.status for r in status.orderBy("seq").collect()] == ["Removed", "NotFound", "NotFound"] and left.count() == 2
    log = [(0, "u", "a", "remove", t(5)), (1, "u", "a", "add", t(6)), (2, "u", "a", "add", t(7)), (3, "u", "b", "add", t(7)), (4, "w", "a", "remove", t(7)), (5, "w", "c", "add", t(8))]
    end = fav.replay_favorites(spark.createDataFrame(log, "seq long, user_id string, job_id string, action string, at timestamp"), after)
    assert {(r.user_id, r.job_id, r.created_at.day) for r in end.collect()} == {("u", "a", 6), ("u", "b", 2), ("w", "c", 8)}
    ids = spark.createDataFrame([("u", " c ", t(9)), ("u", "c", t(9)), ("u", " ", t(9)), ("u", "nope", t(9))], "user_id string, job_id string, at timestamp")
    _, retry, counts = fav.import_favorites(ids, held, users, jobs)
    assert [r.job_id for r in retry.collect()] == ["nope"]
    c = counts.first()
    assert (c.imported, c.failed) == (1, 1)


def test_link_identities(spark):
    schema = "seq long, provider string, subject string, email string, email_verified boolean, display_name string, avatar_url string, at timestamp"
    t = lambda d: datetime(2024, 1, d)
    sign = spark.createDataFrame([
        (0, "g", "s1", " A@x ", True, "New", None, t(1)), (1, "g", "s9", "other@x", True, " ", "pic", t(2)), (2, "g", "", "a@x", True, None, None, t(3)),
        (3, "g", "s2", " ", True, None, None, t(3)), (4, "g", "s2", "b@x", False, None, None, t(3)), (5, "g", "s3", "n@x", True, None, None, t(4)), (6, "h", "s3", "N@X", True, "N", None, t(5))], schema)
    idents = spark.createDataFrame([("g", "s9", "U9")], "provider string, subject string, user_id string")
    user_schema = T.StructType.fromDDL("id string, email string, normalized_email string, display_name string, avatar_url string, email_verified_at timestamp, last_login_at timestamp")
    users = spark.createDataFrame([("U1", "a@x", "a@x", "Old", None, None, None), ("U9", "z@x", "z@x", "Nine", None, t(1), None)], user_schema)
    status, after = fav.link_identities(sign, idents, users)
    got = {r.seq: (r.status, r.user_id) for r in status.collect()}
    assert got[0] == ("Success", "U1") and got[1] == ("Success", "U9")
    assert [got[i][0] for i in (2, 3, 4)] == ["MissingProviderSubject", "MissingEmail", "EmailNotVerified"]
    assert got[5] == got[6] and got[5][1].startswith("u:")
    u = {r.id: r for r in after.collect()}
    assert (u["U1"].display_name, u["U1"].email_verified_at.day, u["U9"].display_name, u["U9"].avatar_url) == ("New", 1, "Nine", "pic")
    new = u[got[5][1]]
    assert (new.email, new.normalized_email, new.display_name, new.last_login_at.day) == ("n@x", "n@x", "N", 5)

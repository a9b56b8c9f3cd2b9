import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postingflow.plans.bulk import run_bulk
from postingflow.plans.crawl import run_crawl
from postingflow.schema import STATE_SCHEMA
from postingflow.sources import scans
from postingflow.sources.state import read_state
from postingflow.streaming import admission, ingest
from test_sources import registry_frame, state_frame, state_row

BOARD = "https://www.infojobs.com.br/vaga-de-"


def card(n, text="Empresa: Vento Norte"):
    return f'<a href="{BOARD}mestre-padeiro__{n}.aspx">Mestre Padeiro {n}</a><div>{text}</div><div>Local: Recife, PE</div>'


def ld(*jobs):
    return f'<script type="application/ld+json">{json.dumps(list(jobs))}</script>'


def job(i, **kw):
    return {"@type": "JobPosting", "title": f"Engineer {i}", "identifier": f"R{i}", "url": f"/j/{i}", "hiringOrganization": {"name": "Acme"}, **kw}


REGISTRY = [
    {"source_name": "Board", "source_type": "InfoJobs", "family": "listing"},
    {"source_name": "Acme", "source_type": "JsonLd", "family": "jsonld", "max_items": 2, "start_url": "https://acme/list"},
    {"source_name": "Accenture", "source_type": "CorporateCareers", "family": "jsonld"},
]


def pages(spark, *rows):
    return spark.createDataFrame([(i, url, html, name, None, status) for i, (url, html, name, status) in enumerate(rows)], scans.PAGES_SCHEMA)


def test_crawl_pass(spark):
    html = card(11111) + card(22222) + card(33333, "Nada") + card(11111)
    frame = pages(
        spark, ("https://www.infojobs.com.br/vagas.aspx", html, "Board", 200), ("https://acme/list", ld(job(1), job(2), job(3)), "Acme", 200),
        ("https://x/list", ld(job(9)), "Accenture", 200), ("https://acme/list", ld(job(8)), "Acme", 403))
    reg = registry_frame(spark, *REGISTRY)
    old = state_frame(
        spark, state_row("known", source_name="Acme", source_type="JsonLd", source_job_id="R1", source_url="https://acme/j/1", status="Expired"),
        state_row("stale", source_name="Acme", source_type="JsonLd", source_url="https://acme/j/77"),
        state_row("alien", source_name="Zed", source_url="https://z/1"))
    detail = pages(spark, (f"{BOARD}mestre-padeiro__11111.aspx", "<p>Python e remoto</p>", "Board", 200)).withColumn("page_id", F.col("page_id") + 100)
    r = run_crawl(frame, reg, old, F.lit(datetime(2024, 6, 1)), details=detail)
    got = {x.source_job_id or x.id: x for x in r.postings.collect()}
    assert set(got) == {"11111", "22222", "R1", "R2", "stale"}
    assert (got["R1"].id, got["R1"].status) == ("known", "Active") and got["stale"].status == "Expired"
    assert (got["11111"].description_text, got["11111"].work_mode, got["11111"].tags) == ("Python e remoto", "Remote", ["python"])
    assert [x.reject_reason for x in r.rejected.collect()] == ["unknown company"]
    runs = {x.source_name: (x.status, x.fetched, x.inserted, x.updated) for x in r.runs.collect()}
    assert runs == {"Board": ("Success", 2, 2, 0), "Acme": ("Success", 2, 1, 1), "Accenture": ("Success", 0, 0, 0)}


def request(*items, name="feed"):
    return {"sourceName": name, "items": list(items)}


def item(n, **kw):
    return {"title": f"T{n}", "company": {"name": "C"}, "sourceUrl": f"https://h/{n}", **kw}


def test_bulk_pass(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(request(item(1, originUrl="https://o/1", tags=["B", "a"]), item(2, title=" "), item(3, sourceUrl="https://h/9", originUrl="https://o/1", title="Other", descriptionText="x" * 50))))
    (tmp_path / "b.json").write_text(json.dumps(request()))
    r = run_bulk(scans.read_bulk(spark, str(tmp_path)), spark.createDataFrame([], STATE_SCHEMA), F.lit(datetime(2024, 6, 1)))
    s = r.summary.first()
    assert (s.received, s.processed, s.inserted, s.updated, s.duplicates, s.invalid) == (3, 2, 1, 1, 0, 1)
    assert [(e.item_index, e.message) for e in r.errors.collect()] == [(1, "title is required")]
    p = r.postings.collect()
    assert len(p) == 1 and (p[0].title, p[0].source_url, p[0].tags, len(p[0].description_text)) == ("T1", "https://h/9", ["b", "a"], 50)
    assert p[0].metadata == {"originUrl": "https://o/1"} and r.rejected.count() == 1


def test_crawl_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    reg = registry_frame(spark, *REGISTRY)
    first = pages(spark, ("https://acme/list", ld(job(1), job(2)), "Acme", 200))
    second = pages(spark, ("https://acme/list", ld(job(2, description="long " * 20), job(3)), "Acme", 200)).withColumn("page_id", F.lit(7).cast("long"))
    src, table = str(tmp_path / "pages"), str(tmp_path / "table")
    when = datetime(2024, 6, 1)
    first.coalesce(1).write.mode("append").parquet(src)
    ingest.start_crawl(spark, src, reg, table, str(tmp_path / "ck"), run_at=when).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(src)
    ingest.start_crawl(spark, src, reg, table, str(tmp_path / "ck"), run_at=when).awaitTermination()
    state = {r.source_job_id: r.description_text.strip() for r in read_state(spark, f"{table}/state").collect()}
    assert state == {"R1": "", "R2": ("long " * 20).strip(), "R3": ""}
    # A lost checkpoint replays both files; the table already has the batches.
    ingest.start_crawl(spark, src, reg, table, str(tmp_path / "ck2"), run_at=when).awaitTermination()
    assert read_state(spark, f"{table}/state").count() == 3
    assert spark.read.parquet(f"{table}/runs").groupBy("source_name").count().where("count = 2").count() == 3  # each source in both batches


def test_bulk_stream(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    (src / "a.json").write_text(json.dumps(request(item(1), item(2))))
    ingest.start_bulk(spark, str(src), table, str(tmp_path / "ck"), run_at=datetime(2024, 6, 1)).awaitTermination()
    assert read_state(spark, f"{table}/state").count() == 2
    assert spark.read.parquet(f"{table}/summaries").first().inserted == 2


def test_bulk_stream_that_fails_before_its_commit(spark, tmp_path, monkeypatch):
    """The logs of the failed attempt are replaced by those of the replay."""
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    (src / "a.json").write_text(json.dumps(request(item(1), item(2, title=" "))))

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, "_store", fails)
        with pytest.raises(Exception, match="lost"):
            ingest.start_bulk(spark, str(src), table, str(tmp_path / "ck"), run_at=datetime(2024, 6, 1)).awaitTermination()
    assert spark.read.parquet(f"{table}/summaries").count() == 1 and read_state(spark, f"{table}/state").count() == 0
    ingest.start_bulk(spark, str(src), table, str(tmp_path / "ck"), run_at=datetime(2024, 6, 1)).awaitTermination()
    assert read_state(spark, f"{table}/state").count() == 1
    assert spark.read.parquet(f"{table}/summaries").count() == 1 and spark.read.parquet(f"{table}/errors").count() == 1


def requests(spark, n, key=lambda i: "k"):
    rows = [(i, "register" if i % 2 else "login", key(i), datetime(2024, 1, 1, 0, i // 60, i % 60)) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, policy string, key string, ts timestamp")


def test_admission_batch(spark):
    got = admission.admit(requests(spark, 120)).groupBy("policy", "window_start").agg(F.sum(F.col("admitted").cast("int")).alias("n")).collect()
    assert {(r.policy, r.n) for r in got} == {("register", 6), ("login", 10)} and len(got) == 4
    first = admission.admit(requests(spark, 120)).filter("admitted and policy = 'register'").orderBy("request_id").first()
    assert first.request_id == 1


def test_admission_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frame = requests(spark, 240, lambda i: f"k{i % 3}").withColumn("request_id", F.format_string("%05d", "request_id"))
    src = str(tmp_path / "req")
    for lo in range(0, 240, 80):
        frame.filter(F.col("request_id").cast("int").between(lo, lo + 79)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = admission.admit_stream(stream).writeStream.format("memory").queryName("admitted").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.request_id, r.admitted) for r in spark.table("admitted").collect()}
    want = {(r.request_id, r.admitted) for r in admission.admit(frame).collect()}
    assert got == want


def test_client_key(one):
    schema = "a string,b string"
    assert one(admission.client_key, schema, " , 1.1.1.1 , 2", "r") == "1.1.1.1"
    assert one(admission.client_key, schema, None, "r") == "r"
    assert one(admission.client_key, schema, " ", None) == "unknown"


def test_drop_replays(spark, tmp_path):
    rows = [("o1", datetime(2024, 1, 1)), ("o1", datetime(2024, 1, 1, 0, 5)), ("o2", datetime(2024, 1, 1))]
    rows += [(none, datetime(2024, 1, 1, 0, i)) for i in range(3) for none in (None, "", " ")]
    frame = spark.createDataFrame(rows, "origin_url string, arrived_at timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    stream = ingest.drop_replays(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("replays").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("replays").count() == 2 + 9

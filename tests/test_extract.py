import json

import pytest
from pyspark.sql import functions as F

from postingflow.operators import extract as ex
from postingflow.schema import REGISTRY_SCHEMA

LD = {
    "@context": "https://schema.org",
    "@graph": [
        {"@type": "JobPosting", "title": "Data <b>Engineer</b>", "url": "/jobs/1", "identifier": {"value": "REQ-1"},
         "hiringOrganization": {"name": "Acme &amp; Co"}, "datePosted": "2024-01-02",
         "jobLocation": [{"address": {"addressLocality": "São Paulo", "addressCountry": {"name": "BR"}}},
                         {"name": "Lisboa"}]},
        {"@type": ["Thing", "jobposting"], "title": "QA", "identifier": "req-1"},
        {"@type": "JobPosting", "title": "Ops", "applicantLocationRequirements": {"name": "Anywhere"}},
        {"@type": "Organization", "title": "No"},
    ],
}
BOARD = "https://www.infojobs.com.br/vaga-de-"


def pages(spark, *htmls, url="https://careers.example.com/list", source="s"):
    rows = [(i, url, source, h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, page_url string, source_name string, html string")


def registry(spark, **options):
    names = [f.name for f in REGISTRY_SCHEMA.fields]
    return spark.createDataFrame([tuple(options.get(n) for n in names)], REGISTRY_SCHEMA)


def test_jsonld(spark):
    html = f'<script type="application/ld+json">{json.dumps(LD)}</script><script type="application/ld+json">{{bad</script>'
    df = pages(spark, html)
    got = {r.source_job_id: r for r in ex.extract_jsonld(df).collect()}
    assert set(got) == {"REQ-1", next(k for k in got if k.startswith("url:"))}
    first = got["REQ-1"]
    assert (first.title, first.company, first.url) == ("Data Engineer", "Acme & Co", "https://careers.example.com/jobs/1")
    assert first.location_text == "São Paulo, BR | Lisboa"
    assert str(first.posted_at) == "2024-01-02 00:00:00"
    other = next(r for k, r in got.items() if k.startswith("url:"))
    assert (other.title, other.company, other.location_text) == ("Ops", "Unknown", "Anywhere")
    assert ex.malformed_blocks(df, "jsonld").count() == 1
    assert ex.json_objects(df).count() > 5


def test_listing_tiers(spark):
    state = {"props": {"list": [{"title": "Dev Java", "url": BOARD + "dev-java__11111.aspx", "company": {"name": "Um"},
                                 "location": "Recife", "id": "x", "publishedAt": "2024-02-03"}]}}
    html = (
        '<nav><a href="/as">Empresas</a></nav>'
        f'<script id="__NEXT_DATA__">{json.dumps(state)}</script>'
        '<div><a href="/vaga-de-dev-java__11111.aspx">Dup</a></div>'
        '<div class="card"><a href="/vaga-de-mestre-padeiro__22222.aspx">Mestre <i>Padeiro</i></a>'
        '<div>Empresa: Vento Norte</div><div>Local: Recife, PE</div><div>Salario: R$ 3.500 a 4.200 por mes</div></div>'
        '<div class="card"><a href="https://www.infojobs.com.br/vaga-de-qa__33333.aspx">QA</a>'
        '<div>Empresa: Ilha Ltda.</div></div><a href="/vaga-x">no</a>'
    )
    got = {r.url[-10:]: r for r in ex.extract_listing(pages(spark, html, url="https://www.infojobs.com.br/vagas.aspx")).collect()}
    assert set(got) == {"11111.aspx", "22222.aspx", "33333.aspx"}
    assert (got["11111.aspx"].company, got["11111.aspx"].title) == ("Um", "Dev Java")
    second = got["22222.aspx"]
    assert (second.title, second.company, second.location_text) == ("Mestre Padeiro", "Vento Norte", "Recife, PE")
    assert second.salary_text == "R$ 3.500 a 4.200 por mes" and second.source_job_id == "22222"
    assert (got["33333.aspx"].company, got["33333.aspx"].location_text) == ("Ilha Ltda.", "")


def test_anchor_tail(spark):
    html = (
        '<a href="/job/1">Analista</a><p>Joinville, SC</p><a href="/about">Sobre nos</a>'
        '<a href="/vaga/2">Dev Pleno</a><p>Remoto</p><a href="/job/1">Analista again</a><a href="/job/3">abc</a>'
    )
    got = [(r.title, r.url, r.location_text) for r in ex.extract_anchor_tail(pages(spark, html)).orderBy("ord").collect()]
    assert got == [("Analista", "https://careers.example.com/job/1", "Joinville, SC"),
                   ("Dev Pleno", "https://careers.example.com/vaga/2", "Remoto")]


def test_workday(spark):
    payload = {"total": 3, "jobPostings": [
        {"title": "A", "externalPath": "/job/Sao-Paulo/A_R1", "locationsText": "Sao Paulo", "postedOn": "2024-01-05T00:00:00Z", "id": "R1"},
        {"title": "B", "externalPath": "/job/X/B_R2", "bulletFields": ["R2", "Buenos Aires - AR"], "postedOn": "Posted Today"},
        {"jobTitle": "C", "id": "R 3", "locations": ["x ", {"name": "y"}], "timeType": {"label": "Full time"}},
        {"title": " "},
    ]}
    reg = registry(spark, source_name="s", base_host="h.example.com", site_path="/pt/Site/", site_name="Site")
    got = {r.title: r for r in ex.extract_workday(pages(spark, json.dumps({"d": [payload]})), reg).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"].source_job_id, got["A"].url) == ("R1", "https://h.example.com/job/Sao-Paulo/A_R1")
    assert str(got["A"].posted_at) == "2024-01-05 00:00:00" and got["B"].posted_at is None
    assert (got["B"].source_job_id, got["B"].location_text) == ("B_R2", "Buenos Aires - AR")
    assert (got["C"].url, got["C"].location_text, got["C"].employment_text) == (
        "https://h.example.com/pt/Site/job/R%203", "x | y", "Full time")


def test_gupy_first_endpoint_with_jobs(spark):
    jobs = {"jobs": [{"id": 7, "title": "Dev", "workplace": {"address": {"city": "", "state": "", "country": "Brasil"},
                                                             "workplaceType": "remote"}, "department": {"id": 7, "name": "TI"}}]}
    reg = registry(spark, source_name="g", start_url="https://acme.gupy.io/")
    df = spark.createDataFrame(
        [(1, "https://acme.gupy.io/", "g", "<html>nothing</html>"),
         (2, "https://acme.gupy.io/jobs", "g", f"<script id='__NEXT_DATA__'>{json.dumps(jobs)}</script>"),
         (3, "https://acme.gupy.io/jobs.json", "g", "{broken")],
        "page_id long, page_url string, source_name string, html string")
    got = ex.extract_gupy(df, reg).collect()
    assert [(r.source_job_id, r.url, r.location_text, r.page_id) for r in got] == [
        ("7", "https://acme.gupy.io/job/7", "Brasil", 2)]


def test_endpoint_candidates(spark):
    reg = registry(spark, source_name="g", start_url="https://acme.gupy.io/jobs")
    got = [r.endpoint for r in ex.endpoint_candidates(reg).orderBy("position").collect()]
    assert got == ["https://acme.gupy.io/jobs", "https://acme.gupy.io/jobs.json", "https://acme.gupy.io/"]
    plain = registry(spark, source_name="p", start_url="https://other.example.com/careers")
    assert [r.endpoint for r in ex.endpoint_candidates(plain).collect()] == ["https://other.example.com/careers"]


def test_detail_description(one):
    html = "<script>requirements</script><h1>Vaga</h1><section id='descricao-da-vaga'>Faz <b>isto</b></section> requisitos <div>x</div>"
    assert one(ex.detail_description, "a string", html) == "Faz isto"
    assert one(ex.detail_description, "a string", "<p>hello</p>") == "hello"


def test_enrich_respects_budget(spark):
    raw = spark.createDataFrame(
        [("s", "jsonld", 1, i, f"https://h/{i}", "kept" if i == 0 else None) for i in range(5)],
        "source_name string, family string, page_id long, ord long, url string, description string",
    ).withColumns({"external_path": F.lit(None).cast("string"), "source_job_id": F.lit(None).cast("string")})
    details = spark.createDataFrame(
        [(10 + i, f"https://h/{i}", "s", f"<p>text {i}</p>") for i in range(5)],
        "page_id long, page_url string, source_name string, html string")
    reg = registry(spark, source_name="s", max_detail=2)
    got = [r.description for r in ex.enrich_details(raw, details, reg).orderBy("ord").collect()]
    assert got == ["kept", "text 1", "text 2", None, None]


def test_paging_and_caps(spark):
    reg = registry(spark, source_name="s", page_size=50, max_pages=3, max_items=2)
    assert [(r.page_no, r.offset) for r in ex.page_grid(reg).orderBy("page_no").collect()] == [(1, 0), (2, 50), (3, 100)]
    listing = spark.createDataFrame([("s", 1, 5, False), ("s", 2, None, False), ("s", 3, 5, False), ("s", 4, 0, False), ("s", 5, 9, False)],
                                    "source_name string, page_no int, n_items int, blocked boolean")
    assert sorted(r.page_no for r in ex.truncate_pages(listing).collect()) == [1, 3]
    raw = spark.createDataFrame([("s", 1, i) for i in range(5)] + [("t", 1, i) for i in range(30)], "source_name string, page_id long, ord long")
    got = ex.cap_items(raw, reg).groupBy("source_name").count().collect()
    assert {r.source_name: r["count"] for r in got} == {"s": 2, "t": 20}


@pytest.mark.parametrize("path,out", [
    ("/wday/cxs/t/s/job/1", "/wday/cxs/t/s/job/1"), ("/job/a/b", "/wday/cxs/t/s/job/a/b"), (None, "/wday/cxs/t/s/job/R%201"),
])
def test_workday_detail_path(one, path, out):
    from postingflow.functions.identity import workday_detail_path
    assert one(workday_detail_path, "a string,b string,c string,d string", "t", "s", path, " R 1 ") == out

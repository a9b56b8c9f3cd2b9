import hashlib
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from postingflow.functions import identity as idn, infer, text


@pytest.mark.parametrize("raw,folded", [
    ("  Télé-Réparateur C++  ", "tele reparateur c"),
    ("Łódź   &   Brno,  CZ (Übersee)", "łodz brno cz ubersee"),
    ("Ops/Site-Reliability???", "ops site reliability"),
    ("がくせい か\u3099", "かくせい か"), ("m² Ω 한국", "m ω 한국"),
    ("", ""), ("   ", ""), (None, ""),
    ("a\tb\nc", "a\tb\nc"),
    ("\t x \n", "x"),
])
def test_normalize_text(one, raw, folded):
    assert one(text.normalize_text, "a string", raw) == folded


def test_fingerprint_ignores_case_accents_and_punctuation(one):
    schema = "a string,b string,c string,d string"
    a = one(idn.fingerprint, schema, "Doce Mar", "Técnica - Redes", "Évora   (PT), Sul", "OnSite")
    b = one(idn.fingerprint, schema, "DOCE mar", "tecnica redes", "evora pt sul", "onsite")
    assert a == b == "sha256:" + hashlib.sha256(b"doce mar|tecnica redes|evora pt sul|onsite").hexdigest()
    assert one(idn.fingerprint, schema, "Doce Lar", "Técnica - Redes", "Évora   (PT), Sul", "OnSite") != a


def test_folding_sweep(spark):
    """Every lower-case character of the basic plane against decomposition, mark removal and recomposition."""
    codes = [c for c in [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0)] if chr(c) == chr(c).lower() and unicodedata.category(chr(c))[0] == "L"]
    rows = spark.createDataFrame([(c, "x" + chr(c) + "x") for c in codes], "c int, t string").select("c", F.col("t").rlike(r"^x\p{L}x$").alias("known"), text.normalize_text(F.col("t")).alias("t"))
    wrong = []
    for r in rows.collect():
        kept = "".join(x for x in unicodedata.normalize("NFD", chr(r.c)) if unicodedata.category(x) != "Mn")
        if r.known and r.t != "x" + unicodedata.normalize("NFC", kept) + "x":
            wrong.append(hex(r.c))
    assert not wrong  # letters newer than Java's own tables are no letters to it


def test_url_ids(one):
    assert one(idn.url_hash_id, "a string", "https://careers.example.com/jobs/124") == "url:a339b977bf975916"
    board = "https://www.infojobs.com.br/vaga-de-desenvolvedor-dotnet__44556677.aspx"
    schema = "a string,b string"
    assert one(idn.stable_job_id, schema, "x", board) == "44556677"
    assert one(idn.stable_job_id, schema, "x", "https://h/jobs") == "x"
    assert one(idn.stable_job_id, schema, " ", "https://h/jobs?a=1&iv=77") == "77"
    assert one(idn.stable_job_id, schema, None, "https://h/jobs/1234567/x") == "1234567"
    assert one(idn.stable_job_id, schema, None, "https://h/jobs").startswith("url:")


@pytest.mark.parametrize("url,base,out", [
    ("../x/y?z=1", "https://a.com/b/c/d?q", "https://a.com/b/x/y?z=1"),
    ("/p", "https://a.com", "https://a.com/p"),
    ("p", "https://a.com", "https://a.com/p"),
    ("?a", "https://a.com/x/y?z", "https://a.com/x/y?a"),
    ("#f", "https://a.com/x#g", "https://a.com/x#f"),
    ("//h/p", "http://a.com", "http://h/p"),
    ("mailto:x@y", "http://a.com", "mailto:x@y"),
    ("./a/./b/..", "http://h/x/y", "http://h/x/a/"),
])
def test_absolutize(one, url, base, out):
    assert one(idn.absolutize, "a string,b string", url, base) == out


def test_html_text(one):
    assert one(text.html_text, "a string", "<p>A&amp;B &lt;b&gt;</p>\n&#233;&#x1F600; &eacute; &foo; &amp;lt; x & y") == (
        "A&B <b> é😀 é &foo; &lt; x & y")
    assert one(text.strip_html_ui, "a string", "<style>x{}</style><b>a</b>&nbsp;b") == "a b"
    assert one(text.strip_html_ui, "a string", "1 < 2") == "1 < 2"
    assert one(text.strip_html_ui, "a string", None) == text.NO_DESCRIPTION


@pytest.mark.parametrize("raw,low,high,currency,period", [
    ("R$ 8.000,00 - R$ 12.000,00 por mês", "8000.00", "12000.00", "BRL", "month"),
    ("9.500", "9500.00", "9500.00", None, None),
    ("1,234.56 usd", "1234.56", "1234.56", None, None),
    ("8.000,00.", None, None, None, None),
    ("a combinar", None, None, None, None),
    (None, None, None, None, None),
])
def test_parse_salary(one, raw, low, high, currency, period):
    got = one(infer.parse_salary, "a string", raw)
    dec = lambda x: None if x is None else Decimal(x)
    assert (got["min"], got["max"], got["currency"], got["period"]) == (dec(low), dec(high), currency, period)


def test_work_mode_priority(one):
    assert one(infer.infer_work_mode, "a string", "Presencial ou Híbrido") == "Hybrid"
    assert one(infer.infer_work_mode, "a string", "REMOTO hybrid") == "Remote"
    assert one(infer.infer_work_mode, "a string", None) == "Unknown"
    assert one(infer.infer_work_mode_location, "a string", "onsite") == "Unknown"


def test_employment(one):
    schema = "a string,b string"
    assert one(infer.infer_employment, schema, "FULL_TIME", "international") == "Internship"
    assert one(lambda a, b: infer.infer_employment(a, b, "token"), schema, "FULL_TIME", "international") == "Unknown"
    assert one(infer.infer_employment, schema, "PJ", "") == "Contractor"
    assert one(infer.infer_employment_workday, "a string", "Temporary contract") == "Temporary"


def test_tags_and_languages(one):
    schema = "a string,b string"
    assert one(lambda a, b: infer.infer_tags(a, b, "compat"), schema, "kubernetes", "x") == ["dotnet", "kubernetes"]
    assert one(infer.infer_tags, schema, "C# dev", "asp.net, javascript") == ["dotnet", "csharp", "javascript"]
    assert one(infer.infer_tags_sample, schema, "PostgreSQL", ".NET") == ["dotnet", "postgresql"]
    assert one(infer.infer_languages, "a string", "vaga à noite") == ["en"]
    assert one(infer.infer_languages, "a string", "AÇÃO") == ["pt-BR"]
    assert one(lambda a: infer.infer_languages(a, []), "a string", " ") == []


def test_enums(one):
    assert one(lambda a: infer.parse_enum(a, "WorkMode"), "a string", " remote ") == "Remote"
    assert one(lambda a: infer.parse_enum(a, "Seniority"), "a string", "4") == "Senior"
    assert one(lambda a: infer.parse_enum(a, "SourceType", "ExternalIngestion"), "a string", "nope") == "ExternalIngestion"
    assert one(infer.source_type_from_name, "a string", " LinkedIn ") == "LinkedIn"
    assert one(infer.infer_country, "a string", "Sao Paulo, SP") == "BR"
    assert one(infer.infer_country, "a string", "Lisboa") is None


def test_tag_lists(one):
    assert one(text.normalize_tags, "a array<string>", [" B ", "a", "b", "", None]) == ["b", "a"]
    assert one(text.parse_tag_csv, "a string", "X, y,,x ") == ["x", "y"]
    assert one(text.normalize_email, "a string", None) == ""


def test_dates(one):
    assert str(one(text.parse_date, "a string", "2024-05-01T10:00:00+02:00")) == "2024-05-01 08:00:00"
    assert one(text.parse_date, "a string", "Posted Today") is None
    assert one(lambda a: F.date_format(text.parse_date(a), "yyyy-MM-dd"), "a string", "2024-05-01") == "2024-05-01"

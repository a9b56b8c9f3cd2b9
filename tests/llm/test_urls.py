"""Rules against plain Python, the model against its labels."""

from postingflow.llm import urls

ROWS = [
    (1, "http://a.com/x"), (2, "HTTP://WWW.Example.COM/en/1?q=/x#y"), (3, "https://example.com/en/"), (4, "https://sub.example.com/en/1"), (5, "https://example.com/EN/1"),
    (6, "ftp://x.net/es/"), (7, "x.net/es/"), (8, None), (9, ""), (10, "http://net"), (11, "http://a.net/fr/a?://b.com/"), (12, "://com/"), (13, "http://notexample.com/en/2"),
    (14, "http://É.NET/es/ü"), (15, "http://a.net\n/fr/x"), (16, "http://com?x=1"), (16, "http://com?x=1"), (None, "http://q.org/z"), (17, "http://example.com.evil.org/en/"),
]


def _plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for _, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]):])]
    return host, path, max(fits, key=len) if fits else None


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in ROWS], "page_id long, url string, host string")
    rows = urls.judge(df).collect()
    assert sorted((repr(r.page_id), r.host, r.path, repr(r.rule)) for r in rows) == sorted((repr(i), h, p, repr(r)) for i, u in ROWS for h, p, r in [_plain(u)])
    kind = {r: v for v, r in urls.RULES}
    for r in rows:
        assert r.verdict == kind[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).collect() == []


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, u, "own", "own", "own", "own") for i, u in ROWS], "page_id long, url string, _place string, place string, row string, Verdict string")
    rows = urls.judge(df).collect()
    assert {(r["_place"], r["place"], r["row"]) for r in rows} == {("own",) * 3} and {r["verdict"] for r in rows} <= {"allow", "block"}


def test_model_learns_a_labelled_table(spark):
    good = [f"https://news{i % 7}.site.org/story/{i}" for i in range(120)]
    bad = [f"https://casino-{i % 7}.bet.org/win/{i}" for i in range(120)]
    table = [(u, False) for u in good[:100]] + [(u, True) for u in bad[:100]]
    labelled = spark.createDataFrame(table, "url string, blocked boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[100:] + bad[100:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labelled=labelled).collect()}
    assert all(got[i] == ("allow" if i < 20 else "block") for i in got)

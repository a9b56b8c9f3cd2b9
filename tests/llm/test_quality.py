"""Counts against plain Python, verdicts against labels."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postingflow.llm import quality
from postingflow.llm.features import chunks, word_limits
from tests.llm.helpers import empty_frame, odd_documents, odd_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab# |\n\r\t é你 "), max_size=40), min_size=1, max_size=6))
def test_counts(texts):
    for limit in (5, 1 << 20):
        got = []
        for _, t in chunks(pa.array(texts), limit):
            c = quality.base_counts(t, *word_limits(t))
            got += list(zip(*(c[k].tolist() for k in quality.BASE)))
        assert got == [_plain(t) for t in texts]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (3, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    docs = odd_frame(spark).drop("score")
    model = quality.train(docs, labels)
    rows = quality.judge(docs, model).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows])) == sorted(map(key, [(d, *_plain(t or "")) for d, t, *_ in odd_documents()]))
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty_frame(spark).drop("score"), quality.train(empty_frame(spark), labels)).collect() == []


def test_clashing_names(spark):
    docs = odd_frame(spark).withColumns({n: F.lit("own") for n in ("kept", "N_Words", "row", "needed", "none")})
    model = quality.train(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    out = quality.judge(docs, model)
    assert len(out.columns) == len({c.lower() for c in out.columns}) and {(r.row, r.needed) for r in out.collect()} == {("own", "own")}
    assert {type(r.kept) for r in out.collect()} == {bool}


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality.op8_quality(spark, folder).collect() if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    if not good or not bad:
        pytest.skip("no labels")
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)


def test_every_trusted_document_counts(spark):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_documents(docs, labels.unionAll(labels)).count() == 12_000
    model = quality.train(docs, labels)
    means = sorted(r.quality_ratio for r in quality.judge(docs, model).select("quality_ratio").collect())
    low, median = means[int((1 - quality.PASSING) * len(means))], (means[5999] + means[6000]) / 2
    assert model.threshold == pytest.approx(low - (median - low), abs=1e-8)

"""Held-out accuracy, families, and rows without letters."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postingflow.llm import language
from postingflow.llm.features import chunks
from postingflow.llm.linear import linear_svm
from tests.llm.helpers import empty_frame, odd_frame


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op1_language(spark, folder).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)


def test_families():
    assert language.family("en") == language.family("de") == "germanic"
    assert language.family("fr") == language.family("es") == language.family("pt-BR")
    assert language.family("xx") == "xx"


def test_languages_of_one_and_of_three_families(spark):
    words = {"en": "the and of that with this", "de": "und der nicht das mit ist", "nl": "het een niet zijn voor ook", "fr": "le les une dans est pas", "zh": "的 是 不 了 在 人"}
    rows = [(10 * i + k, " ".join(w.split()[(i + j * k) % 6] for j in range(12)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert set(model.languages) == set(words)
    got = language.identify(df.select("doc_id", "text"), model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)
    one = language.train(df.where("lang = 'fr'"))
    assert {r.lang_pred for r in language.identify(df.limit(3), one).collect()} == {"fr"}


def test_every_language_is_learned_in_tasks_of_its_own(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [f"q{a}" for a in letters] + [f"x{a}" for a in letters] + list(language.FAMILIES["germanic"] + language.FAMILIES["turkic"])
    assert len(codes) == 70
    rows = [(100 * i + k, " ".join(f"{code}{letters[(i + j) % 7]}{code[::-1]}" for j in range(8)), code) for i, code in enumerate(codes) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, family_rows=200)
    assert model.languages == tuple(sorted(codes))
    assert sorted(language.training_sample(df).groupBy("lang").count().toPandas()["lang"]) == sorted(codes)
    got = language.identify(df, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)


def test_models_equal_a_fit_of_all_rows_in_one_place(spark):
    words = {"en": "the and of that with this", "de": "und der nicht das mit ist", "fr": "le les une dans est pas"}
    rows = [(10 * i + k, " ".join(w.split()[(i * i + j * k) % 6] for j in range(9)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    kept = [(x, t) for d, t, x in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    x = np.concatenate([language.share_matrix(t) for _, t in chunks(pa.array([t for _, t in kept]), 1 << 18, 256)])
    langs = np.array([k for k, _ in kept])
    order = sorted(range(len(x)), key=lambda i: (langs[i], x[i].tobytes()))
    x, langs = x[order], langs[order]
    assert (model.languages, model.families, model.pairs) == (("de", "en", "fr"), ("germanic", "romance"), ((0, 1),))
    mine = langs != "fr"
    want = [linear_svm(x, np.where(langs != "fr", 1, -1)), linear_svm(x, np.where(langs == "fr", 1, -1)), linear_svm(x[mine], np.where(langs[mine] == "de", 1, -1))]
    assert np.abs(model.weights - np.stack(want, axis=1)).max() < 1e-6


def test_a_text_alone_has_the_features_it_has_among_others():
    texts = ["One two", "", "é", "x", None, "abc abc abcd", "One two"]
    together = np.concatenate([language.share_matrix(t) for _, t in chunks(pa.array(texts))])
    alone = np.concatenate([language.share_matrix(t) for x in texts for _, t in chunks(pa.array([x], pa.string()))])
    assert (together == alone).all()


def test_clashing_names(spark):
    names = ["lettered", "_lettered", "row", "needed", "Lang_Pred", "lang_score", "none"]
    docs = odd_frame(spark).withColumns({n: F.lit("own") for n in names})
    out = language.identify(docs, language.train(docs))
    assert out.columns == [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")] + ["lang_pred", "lang_score"]
    assert {(r["_lettered"], r["row"], r["needed"], r["none"]) for r in out.collect()} == {("own",) * 4}


def test_odd_rows(spark):
    docs = odd_frame(spark)
    model = language.train(docs)
    got = {(r.doc_id, r.text): r for r in language.identify(docs, model).collect()}
    for doc in ((0, None), (1, ""), (2, " \n\t"), (6, "12 34")):
        assert got[doc].lang_pred == "und" and got[doc].lang_score == 0.0
    assert language.train(empty_frame(spark)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}

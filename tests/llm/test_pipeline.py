"""The stages on the small tables, and every registered query."""

from collections import defaultdict

import pytest

import corpus_pipeline
from postingflow.llm import catalog
from tests.llm.helpers import empty_frame, odd_frame

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert counts[1] <= counts[0] and counts[2] < counts[1]
    seqs = defaultdict(list)
    for r in docs.collect():
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own[:i]) == at for own in map(sorted, seqs.values()) for i, (at, _) in enumerate(own))
    assert max(sum(n for _, n in own) for own in seqs.values()) <= 2048


def test_run_is_the_stages_one_after_the_other(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("frame", [odd_frame, empty_frame])
def test_stages_take_odd_rows(spark, tmp_path, frame):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("name", sorted(catalog.all_sql()))
def test_queries_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, rel = catalog.all_queries()[name](spark, FOLDER), con.sql(catalog.all_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(rel.select(*cols).fetchall())

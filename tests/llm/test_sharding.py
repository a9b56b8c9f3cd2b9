"""Virtual slots: sizes, places, and maps edited in place."""

import zlib

import pytest

from postingflow.llm import sharding
from tests.llm.helpers import empty_frame, odd_documents, odd_frame


def _all(df):
    return [r.asDict() for r in df.collect()]


def test_every_row_once_with_its_size_and_a_gapless_place(spark):
    rows = _all(sharding.shard_documents(odd_frame(spark), 3))
    want = sorted((repr(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in odd_documents())
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert _all(sharding.shard_documents(empty_frame(spark))) == []


def test_sizes_near_equal_and_reruns_agree(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 97 AS INT)) AS text")
    rows = _all(sharding.shard_documents(docs))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 24
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, _all(sharding.shard_documents(docs.repartition(7)))))


def test_rows_alike_are_spread(spark):
    """A third of the rows without an id and with one text, a third with one id, the rest ordinary: shards still have like sizes."""
    docs = spark.range(12000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7L ELSE id END AS doc_id",
        "CASE WHEN id % 3 = 0 THEN 'the same text everywhere' ELSE repeat('y', CAST(id % 89 AS INT)) END AS text")
    rows = _all(sharding.shard_documents(docs))
    assert len(rows) == 12000 and {r["map_version"] for r in rows} == {2}
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 24
    for shard in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    few = sharding.measured_rows(docs, block=100).groupBy("virtual_slot").count().collect()
    assert sorted(few) == sorted(sharding.measured_rows(docs).groupBy("virtual_slot").count().collect())


def test_rows_lie_where_the_stored_map_sends_them(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('z', CAST(id % 61 AS INT)) AS text")
    rows = _all(sharding.shard_documents(docs, 5, str(tmp_path)))
    first, edited = (sharding.load_map(spark, str(tmp_path), 5, v) for v in (1, 2))
    assert edited == sharding.rebalance(first, list(first.slot_bytes), list(first.slot_rows), slack=sharding.SLACK)
    assert all(edited.shard_of[r["virtual_slot"]] == r["shard"] for r in rows)
    assert [sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)] == edited.loads()
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.store_map(spark, edited, str(tmp_path))


def test_map_versions(spark, tmp_path):
    sizes = [(i * 37) % 101 + 1 for i in range(500)]
    first = sharding.first_map(sizes, [1] * 500, 8)
    sharding.store_map(spark, first, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), 8, 1) == first
    grown = sharding.rebalance(first, sizes, [1] * 500, 9)
    moved = [(a, b) for a, b in zip(first.shard_of, grown.shard_of) if a != b]
    assert moved and {b for _, b in moved} == {8} and grown.version == 2
    assert max(grown.loads()) <= 1.03 * sum(sizes) / 9
    heavier = [s * (5 if o == 3 else 1) for s, o in zip(sizes, grown.shard_of)]
    third = sharding.rebalance(grown, heavier, [1] * 500, slack=0.1)
    assert {a for a, b in zip(grown.shard_of, third.shard_of) if a != b} == {3}
    assert max(third.loads()) <= 1.11 * sum(heavier) / 9

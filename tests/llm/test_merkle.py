"""The manifest against plain recursive trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postingflow.llm import merkle
from tests.llm.helpers import empty_frame, odd_documents, odd_frame

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, level string, node long, digest string, tree string, block int"


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return _h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def _tree(nodes):
    """All levels."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h("".join(last[i:i + 16])) for i in range(0, len(last), 16)])
    return levels


def _siblings(levels, i):
    for level in levels[:-1]:
        run = list(range(i - i % 16, min(i - i % 16 + 16, len(level))))
        yield i % 16, [level[j] for j in run if j != i]
        i //= 16


def _plain(rows):
    """rows: (doc_id, source, lang, n_chars, text); the query's rows."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, places = {}, {}
    for s in sources:
        own = sorted((r[0] is not None, r[0] or 0, _leaf(*r), n) for n, r in enumerate(rows) if r[1] == s)
        trees[s] = _tree([k[2] for k in own])
        places |= {k[3]: i for i, k in enumerate(own)}
    top = _tree([trees[s][-1][0] for s in sources])
    out = []
    for n, r in enumerate(rows):
        path = [*_siblings(trees[r[1]], places[n]), *_siblings(top, sources.index(r[1]))]
        node = leaf = _leaf(*r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            node = _leaf(*r[:4], r[4].translate(lower))
        for at, others in path:
            node = _h("".join([*others[:at], node, *others[at:]]))
        root = top[-1][0]
        out.append((r[0], leaf, trees[r[1]][-1][0], root, _h("".join(h for _, o in path for h in o)), node, node == root))
    return sorted(out, key=repr)


def _query(df):
    docs = df.select(*merkle.FIELDS, *[c for c in df.columns if c not in merkle.FIELDS])
    made = merkle.build_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return made, sorted(map(tuple, merkle.proofs(made).collect()), key=repr)


def test_positions_are_those_of_a_postorder_walk():
    for n in [*range(1, 40), 255, 256, 257, 273, 4095, 4096, 4097, 5000]:
        h, places = merkle.height(n), {}

        def walk(level, node):
            if level:
                for child in range(node * 16, min(node * 16 + 16, merkle.width(n, level - 1))):
                    walk(level - 1, child)
            places[level, node] = len(places)

        walk(h, 0)
        assert places == {k: merkle.position(n, *k) for k in places}
        assert len(places) == sum(merkle.width(n, j) for j in range(h + 1))


def test_query_against_plain_trees(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.choice([None, i, 7]) if i % 50 == 0 else i * 3 - 900, rng.choice(["big", "big", "big", "é", "", None, "z"]),
             rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "Big Words", "small", "É " * 9])) for i in range(900)]
    rows += [(i, "long", "en", 1, f"Text {i}") for i in range(4500)] + [(5, "one", None, None, None)] * 20 + [(i, f"s{i}", "fr", 0, "x") for i in range(40)]
    rng.shuffle(rows)
    made, got = _query(spark.createDataFrame([(*r, "l", 1, "d", "t", 2) for r in rows], SCHEMA).repartition(5))
    assert got == _plain(rows)
    # The log is gapless and in completion order, and a proof can be fetched from it by places alone.
    merkle.store_log(made, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    trees = {r.source: r for r in made.trees.collect()}
    long = trees["long"]
    assert sorted(r.position for r in log.where(F.col("tree") == long.tree).collect()) == list(range(sum(merkle.width(4500, j) for j in range(5))))
    path = merkle.stored_proof(log, [(long.tree, 4500, 4321), (merkle.SOURCES, len(trees), long.tree)])
    assert merkle.fold(_leaf(4321, "long", "en", 1, "Text 4321").encode(), path) == made.root
    whole = merkle.proofs(made, paths=True).where("doc_id = 4321 AND leaf = '" + _leaf(4321, "long", "en", 1, "Text 4321") + "'").first()
    assert merkle.unpack_path(whole.path) == path


@pytest.mark.parametrize("one_source", [True, False])
def test_odd_rows(spark, one_source):
    df = odd_frame(spark).withColumn("source", F.lit("s")) if one_source else odd_frame(spark)
    rows = [(r[0], "s" if one_source else r[3], r[2], r[4], r[1]) for r in odd_documents()]
    assert _query(df)[1] == _plain(rows)


def test_empty_and_single(spark):
    made, got = _query(empty_frame(spark))
    assert made.root is None and got == []
    rows = [(3, None, None, None, "A")]
    assert _query(spark.createDataFrame([(*rows[0], "l", 1, "d", "t", 2)], SCHEMA))[1] == _plain(rows)

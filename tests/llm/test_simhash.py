"""SimHash links against all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from postingflow.llm import simhash
from postingflow.llm.components import smallest_reachable

SCHEMA = "doc_id long, text string, n_chars string, component string"


def _plain_fingerprint(text):
    words, word = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    """prints: {node: (id, fp)}; the smallest id reachable over links of at most 3 bits."""
    nodes = list(prints)
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                group[root(a)] = root(b)
    least = {}
    for n in nodes:
        r = root(n)
        least[r] = min(least.get(r, prints[n][0]), prints[n][0])
    return {n: least[root(n)] for n in nodes}


def test_whole_query_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["É", "ÉCOLE", "a b"]
    texts = [None, "", " \n", "One", "one", "ONE TWO", "x" * 200_000]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("\t".join(base))
    rng.shuffle(texts)
    rows = [(i * 3, t, "n", "c") for i, t in enumerate(texts)] + [(0, texts[0], "n", "c")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: (i, _plain_fingerprint(t)) for i, t, *_ in rows}
    want = _components(prints)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, (_, p) in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_dense_buckets_are_complete(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for bucket in (2, 1 << 20):
        assert {(r.x, r.y) for r in simhash.near_pairs(df, bucket).collect()} == want


def test_long_chain_of_links(spark):
    order = list(range(200))
    random.Random(6).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in smallest_reachable(edges).collect()}
    assert got == dict.fromkeys(range(200), 0) | {1000: 1000, 1001: 1000}


def test_keep_one_and_empty(spark):
    rows = [(5, "a b c d", "1", None), (2, "a b c d", "2", None), (9, "other words in this one", "3", None), (9, "other words in this one", "3", None),
            (None, "a b c d", "4", None), (None, "no id but words of its own", "5", None), (None, "no id but words of its own", "6", None),
            (7, None, "7", None), (8, "", "8", None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n_chars", "component"]
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(repr, [
        (2, "a b c d"), (9, "other words in this one"), (None, "no id but words of its own"), (7, None)]))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one_is_one_row_of_each_component(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})
    named = docs.withColumns({c: F.lit("own") for c in ("row", "digest", "fingerprint", "component", "first", "none", "node", "first_id")})
    kept = simhash.keep_one(named, bucket=4)
    assert kept.columns == named.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == want and all(r.digest == r.first == "own" for r in rows)

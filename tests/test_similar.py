"""Similar word sets against all pairs."""

import random

import pytest

from postingflow.operators import similar

SCHEMA = "id string, title string, company_name string, description_text string"


def _clusters(rows, threshold):
    sets = [frozenset(t.split()) for _, t in rows]
    group = list(range(len(rows)))

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) / len(a | b) >= threshold:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def _rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = ["", "", "one", "one two", "one two three", "one two three four", "one two three four five", "a b c d e", "a b c d e f", "a b c d"]
    for size in (3, 6, 10, 25, 60):
        for _ in range(4):
            base = rng.sample(words, size)
            texts.append(" ".join(base))
            for _ in range(rng.randint(1, 6)):  # copies further and further away
                for _ in range(rng.randint(0, 1 + size // 8)):
                    base[rng.randrange(len(base))] = rng.choice(words)
                texts.append(" ".join(rng.sample(base, len(base))))
    common = [f"c{i}" for i in range(14)]  # words that very many sets share
    for _ in range(25):
        texts.append(" ".join(rng.sample(common, rng.randint(9, 14)) + rng.sample(words, rng.randint(0, 2))))
    hub = [f"h{i}" for i in range(20)]  # one group of near copies around a text, and sets beside it
    for _ in range(20):
        texts.append(" ".join(hub[:18] + rng.sample(words, rng.randint(0, 3))))
    rng.shuffle(texts)
    return [(f"{i:04d}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,threshold,paired", [(1, 0.8, 64), (2, 0.8, 2)])
def test_all_similar_sets_are_connected(spark, monkeypatch, seed, threshold, paired):
    monkeypatch.setattr(similar.similar_links, "__defaults__", (paired,))
    rows = _rows(seed)
    df = spark.createDataFrame([(i, "", None, t) for i, t in rows], SCHEMA)
    assert {r.id: r.cluster_id for r in similar.cluster_similar(df, threshold).collect()} == _clusters(rows, threshold)


def test_no_rows_and_no_words(spark):
    assert similar.cluster_similar(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("2", None, None, None), ("1", " ", "", "..."), ("3", "x", None, None)], SCHEMA)
    assert {r.id: r.cluster_id for r in similar.cluster_similar(df).collect()} == {"1": "1", "2": "1", "3": "3"}


def test_sets_that_share_a_few_rare_words_fetch_no_words(spark, monkeypatch):
    rng = random.Random(3)
    rare, common = [f"r{i}" for i in range(3000)], [f"c{i}" for i in range(1000)]
    texts = [" ".join(rng.sample(rare, 75) + rng.sample(common, 430)) for _ in range(30)]
    texts.append(texts[0] + " another")
    fetched, verified = [], similar._verified

    def counted(pairs, *rest):
        fetched.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(similar, "_verified", counted)
    rows = [(f"{i:02d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, "", None, t) for i, t in rows], SCHEMA)
    assert {r.id: r.cluster_id for r in similar.cluster_similar(df).collect()} == _clusters(rows, 0.8)
    assert sum(fetched) < 60

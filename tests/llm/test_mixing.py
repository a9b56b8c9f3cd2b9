"""Targets against literal resharing, copies against decisions, positions against the schedules."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from postingflow.llm import mixing
from tests.llm.helpers import empty_frame, odd_frame


def _reshare(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / share for s in names}
        over = {s for s in names if target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over - full:
            return target
        full |= over


def _docs(spark, n=3000):
    return spark.range(n).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(1 + (id * 7919) % 50 AS INT)) AS text",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL WHEN id % 40 = 2 THEN 'tiny' ELSE concat('s', CAST(id % 5 AS STRING)) END AS source", "'x' AS size", "id AS _class")


def test_targets_and_taken_words(spark):
    docs = _docs(spark)
    rows = mixing.mix_decisions(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target, longest = defaultdict(int), defaultdict(int), {}, 50
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert len(rows) == 3000
    want = _reshare(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= longest


def test_copies_follow_the_decisions_in_training_order(spark):
    docs = _docs(spark)
    decided = {r.doc_id: r.copies for r in mixing.mix_decisions(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    seen = defaultdict(int)
    for r in rows:
        seen[r.doc_id] += 1
    assert dict(seen) == {k: v for k, v in decided.items() if v}
    # 's0' sorts third after 'hot': class by place in the list; early weight must exceed late weight for the first class.
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    first = [i for i, r in enumerate(rows) if r.source == names[0]]
    third = [i for i, r in enumerate(rows) if r.source == names[2]]
    assert np.mean(first) < 0.47 * len(rows) < 0.53 * len(rows) < np.mean(third)


def test_schedule_inversion(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.5))
    rows = spark.range(101).select((F.col("id") / 100).alias("s")).select("s", mixing.invert_demand(F.col("s"), knots).alias("t")).collect()

    def demand(t):
        grid = np.linspace(0, t, 20001)
        return np.trapezoid(np.interp(grid, *zip(*knots)), grid)

    for r in rows:
        assert abs(demand(r.t) / demand(1.0) - r.s) < 1e-6


def test_odd_rows_and_empty(spark):
    rows = mixing.mix_decisions(odd_frame(spark)).collect()
    assert len(rows) == 12 and {r["size"] for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.mix_decisions(empty_frame(spark)).collect() == []
    assert mixing.mix_documents(empty_frame(spark)).columns == empty_frame(spark).columns
    mixing.mix_documents(odd_frame(spark)).collect()

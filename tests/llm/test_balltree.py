"""Top-k against every product."""

import math
import random

from pyspark.sql import functions as F

from postingflow.llm import balltree


def _plain(rows, k):
    ok = [(i, n, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, qn, q in ok:
        if qi is None or qi % 5:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), 1 << 62 if i is None else i, n) for i, n, v in ok if n != qn and len(v) == len(q)]
        for rank, (s, i, _) in enumerate(sorted(scored)[:k], 1):
            out.append((qi, rank, None if i == 1 << 62 else i, max(-(1 << 63), min((1 << 63) - 1, -s))))
    return sorted(out, key=repr)


def test_against_all_products(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, list(rows[i % 7][1])) for i in range(400, 460)]  # ties
    rows += [(None, [9.0] * 6), (500, None), (505, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (510, [float("nan")] * 6), (515, [float("inf")] * 6), (520, [1.5, 2.5]), (525, []), (10, [0.0] * 6), (10, [0.0] * 6),
             (530, [3e7, 0.0, 0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, _row string, score int")
    for shard_rows, streams in ((40, 2), (10_000, 1)):
        got = balltree.top_k(df, F.col("_id") % 5 == 0, 5, shard_rows=shard_rows, query_rows=16, streams=streams)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == _plain(rows, 5)
    assert balltree.top_k(df.limit(0), F.col("_id") % 5 == 0).collect() == []


def test_whole_nodes_are_skipped():
    import numpy as np
    rng = np.random.default_rng(0)
    centres = np.repeat(np.diag([2000] + [200] * 7), 512, axis=0)
    vectors = (centres + rng.normal(0, 20, centres.shape)).astype(np.int64)
    tree = balltree.build_tree(np.arange(len(vectors)), np.arange(len(vectors)), vectors)
    best, seen = balltree.Best(vectors[:3], np.arange(3), 5), []
    offer = best.offer
    best.offer = lambda q, t, a, z: (seen.append(z - a), offer(q, t, a, z))
    best.search(balltree.Tree.unpack(tree.pack()))
    assert sum(seen) < len(vectors) / 4
    dots = vectors[:3] @ vectors.T
    for q in range(3):
        dots[q, q] = -1 << 60
        assert [s for s, _, _ in best.scores[q]] == sorted(dots[q].tolist(), reverse=True)[:5]

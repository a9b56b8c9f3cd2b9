"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Candidates are cut into shards of a fixed number of rows. Each shard is one row that holds its vectors in ball-tree order with the
tree's centres and radii. A query block visits shards one after the other, in each the nodes by falling bound, and carries its queries'
current kth scores along, so a node or a whole shard that can't beat them is skipped.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postingflow.llm.common import table
from postingflow.session import cut_lineage

TOP = 5
SCALE = 256.0
EVERY = 50
SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF = 64
# Beyond this size of a scaled component, products are taken in exact Python integers.
SAFE = 1 << 26
NO_ID = (1 << 63) - 1


@dataclass
class Tree:
    """Vectors in tree order; node i covers rows first[i] to last[i], with children 2i+1 and 2i+2."""

    ids: np.ndarray
    rows: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    def pack(self) -> bytes:
        return pickle.dumps(self.__dict__, protocol=5)

    @staticmethod
    def unpack(raw: bytes) -> "Tree":
        return Tree(**pickle.loads(raw))


def build_tree(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """Split at the median along the axis of greatest spread until leaves are small."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
    count = (2 << depth) - 1
    order = np.arange(len(ids))
    values = vectors.astype(np.float64)
    first, last = np.zeros(count, np.int64), np.zeros(count, np.int64)
    last[0] = len(ids)
    for i in range((1 << depth) - 1):
        a, z = first[i], last[i]
        part = order[a:z]
        middle = (a + z) // 2
        if z - a > 1:
            axis = np.ptp(values[part], axis=0).argmax() if values.shape[1] else 0
            if values.shape[1]:
                order[a:z] = part[np.argsort(values[part, axis], kind="stable")]
        first[2 * i + 1], last[2 * i + 1] = a, middle
        first[2 * i + 2], last[2 * i + 2] = middle, z
    values = values[order]
    centre = np.zeros((count, values.shape[1]))
    radius = np.zeros(count)
    for i in range(count):
        own = values[first[i]:last[i]]
        if len(own):
            centre[i] = own.mean(axis=0)
            radius[i] = np.sqrt(((own - centre[i]) ** 2).sum(axis=1).max())
    return Tree(ids[order], rows[order], vectors[order], first, last, centre, radius)


class Best:
    """The top k of each query of a block: (score, id) pairs, best first. A kth score is shared by all shards that follow."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, k: int):
        self.vectors, self.rows, self.k = vectors, rows, k
        self.values = vectors.astype(np.float64)
        self.norm = np.sqrt((self.values ** 2).sum(axis=1))
        self.scores: list[list] = [[] for _ in rows]
        self.kth = np.full(len(rows), -np.inf)

    def offer(self, queries: np.ndarray, tree: Tree, a: int, z: int) -> None:
        """Compare some queries with a leaf."""
        if max(np.abs(self.vectors).max(initial=0), np.abs(tree.vectors[a:z]).max(initial=0)) < SAFE:
            dots = self.vectors[queries].astype(np.int64) @ tree.vectors[a:z].astype(np.int64).T
        else:
            dots = self.vectors[queries].astype(object) @ tree.vectors[a:z].astype(object).T
        possible = (dots >= self.kth[queries][:, None]) & (tree.rows[a:z][None, :] != self.rows[queries][:, None])
        for i in np.flatnonzero(possible.any(axis=1)):
            q = queries[i]
            found = self.scores[q] + [(int(dots[i][j]), int(tree.ids[a + j]), int(tree.rows[a + j])) for j in np.flatnonzero(possible[i])]
            found.sort(key=lambda x: (-x[0], x[1], x[2]))
            self.scores[q] = found[:self.k]
            if len(self.scores[q]) == self.k:
                self.kth[q] = float(self.scores[q][-1][0])

    def search(self, tree: Tree) -> None:
        """Visit the nodes by falling bound, each with the queries whose kth score it may still reach."""
        if not len(tree.ids):
            return
        # The bound is widened for rounding, so it never falls below a true score.
        bound = self.values @ tree.centre.T + self.norm[:, None] * tree.radius
        bound += 1e-9 * (self.norm[:, None] * (np.sqrt((tree.centre ** 2).sum(axis=1)) + tree.radius)) + 1e-6
        leaves = np.arange(len(tree.first) // 2, len(tree.first))
        live = bound[:, 0] >= self.kth
        level = [0]
        alive = {0: np.flatnonzero(live)}
        while level and level[0] < leaves[0]:
            following = {}
            for i in level:
                for child in (2 * i + 1, 2 * i + 2):
                    q = alive[i][bound[alive[i], child] >= self.kth[alive[i]]]
                    if len(q) and tree.last[child] > tree.first[child]:
                        following[child] = q
            alive, level = following, sorted(following)
        for i in sorted(level, key=lambda n: -bound[alive[n], n].max(initial=-np.inf)):
            q = alive[i][bound[alive[i], i] >= self.kth[alive[i]]]
            if len(q):
                self.offer(q, tree, int(tree.first[i]), int(tree.last[i]))


def scaled_vectors(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """_id, _row (a number of its own for every row), _size and _v: floor(256 x) of every component. Vectors that are null or hold
    nulls or non-finite components are left out."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(v.isNotNull() & whole)
    # Floors that don't fit a long stay at its ends.
    return rows.select(F.col(key).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.size(v).alias("_size"),
                       F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(-9.2e18)), F.lit(9.2e18)).cast("long")).alias("_v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Numbered groups of about ``size`` rows of one vector length."""
    counts = rows.groupBy("_size").count().collect()  # a row per vector length
    many = None
    for r in counts:
        n = -(-r["count"] // size)
        many = (F.when if many is None else many.when)(F.col("_size") == r["_size"], F.lit(n))
    return rows.withColumn("_block", F.pmod(F.xxhash64("_row"), many if many is not None else F.lit(1)).cast("int"))


def shard_trees(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard: _size, _block, _tree (packed), and _centre and _radius of its root."""
    def build(pdf):
        tree = build_tree(pdf["_id"].to_numpy(np.int64), pdf["_row"].to_numpy(np.int64), np.stack(pdf["_v"].to_numpy()).reshape(len(pdf), -1))
        return pd.DataFrame({"_size": [int(pdf["_size"].iloc[0])], "_block": [int(pdf["_block"].iloc[0])], "_tree": [tree.pack()]})

    known = rows.withColumn("_id", F.coalesce("_id", F.lit(NO_ID)))  # pandas would make floats of ids among nulls
    return _blocks(known, shard_rows).groupBy("_size", "_block").applyInPandas(build, "_size int, _block int, _tree binary")


def query_blocks(rows: DataFrame, query_rows: int = QUERY_ROWS) -> DataFrame:
    """A row per block of queries: _size, _queries (their number), ids, row numbers and vectors."""
    return (_blocks(rows, query_rows).groupBy("_size", "_block")
            .agg(F.collect_list(F.struct("_id", "_row", "_v")).alias("_q")).withColumnRenamed("_block", "_queries"))


def top_k(embeddings: DataFrame, wanted, k: int = TOP, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, streams: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` highest integer inner products of every query row with every other row.

    ``wanted`` is a condition on _id that says which rows are queries. Ties go to the smaller id, then the earlier row; a missing id
    comes last. A query row is never its own candidate, but a repeated row is. Vectors are compared with those of their own length
    only. Scores beyond a long stay at its ends. Null, partly null and non-finite vectors take no part; an empty table gives an
    empty result.

    Every query block meets every shard in ``streams`` streams, each of which takes its shards one after the other.
    """
    rows = cut_lineage(scaled_vectors(embeddings, vector, key))
    trees = cut_lineage(shard_trees(rows, shard_rows))
    queries = query_blocks(rows.where(wanted), query_rows)
    pairs = trees.withColumn("_stream", F.pmod(F.xxhash64("_block"), F.lit(streams)).cast("int"))

    def run(batches):
        key, best, ids = None, None, None
        for b in batches:
            for r in range(b.num_rows):
                at = (b.column("_size")[r].as_py(), b.column("_queries")[r].as_py(), b.column("_stream")[r].as_py())
                if at != key:
                    if best is not None:
                        yield _results(best, ids)
                    key, q = at, b.column("_q").slice(r, 1).flatten()
                    best = Best(_matrix(q.field("_v")), np.asarray(q.field("_row")), k)
                    ids = q.field("_id")
                best.search(Tree.unpack(b.column("_tree")[r].as_py()))
        if best is not None:
            yield _results(best, ids)

    met = pairs.join(queries, "_size").repartition("_size", "_queries", "_stream").sortWithinPartitions("_size", "_queries", "_stream", "_block")
    found = met.select("_size", "_queries", "_stream", "_q", "_tree").mapInArrow(run, "query_row long, query_id long, vec_id long, row long, score decimal(38,0)")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    limit = F.lit((1 << 63) - 1)
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"),
        F.least(F.greatest("score", F.lit(-(1 << 63)).cast("decimal(38,0)")), limit.cast("decimal(38,0)")).cast("long").alias("score"))


def _results(best: Best, ids: pa.Array) -> pa.RecordBatch:
    flat = [(int(best.rows[i]), ids[i].as_py(), v, row, Decimal(s)) for i, found in enumerate(best.scores) for s, v, row in found]
    cols = list(zip(*flat)) if flat else [[], [], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.decimal128(38, 0))], ["query_row", "query_id", "vec_id", "row", "score"])


def op4_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("_id") % EVERY == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.r AS qr, b.vec_id AS vec_id, b.r AS r, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""

QUERIES = {"op4_ball_tree": (op4_ball_tree, OP4_SQL)}

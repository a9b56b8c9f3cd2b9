"""Merkle manifest of a dataset as a postorder append log.

Every source has a tree over its documents in id order: each run of 16 nodes becomes one node, level by level, until one is left.
A tree of sources over these gives the root. The log lists all nodes in the order in which they are complete, children before
their parent. Its size and every place in it follow from the number of leaves alone: when the last leaf below a node is written, the
nodes complete so far are counted level by level. So builders work apart on aligned blocks of 16^3 nodes, each knows where its nodes
go, and a proof is a list of places in the log.

Blocks are the unit of work: a source that holds most rows is many blocks, a small one is one. Three levels are built at a time, so
the builders of the next three see one node per block.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm.common import table
from postingflow.operators.scan import number_rows, option_join
from postingflow.session import cut_lineage

FAN = 16
BITS = 4
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SOURCES = -1  # the number of the tree whose leaves are the sources' roots
LOG = "tree long, level int, node long, position long, digest binary"
UPPER = "abcdefghijklmnopqrstuvwxyz".upper()


def digest(children: list[bytes]) -> bytes:
    """H of nodes: SHA-256 of their hexadecimal texts one after the other, as hexadecimal text."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // FAN), h + 1
    return h


def width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    return -(-leaves // FAN ** level)


def position(leaves: int, level: int, node: int) -> int:
    """Place in the log of a tree: how many of its nodes are complete before this one.

    With ``end`` leaves written, a level up to the node's own has all nodes over them, also those that the last leaf closes; a
    level above it only those that an earlier leaf closed.
    """
    end = min((node + 1) * FAN ** level, leaves)
    return sum(-(-end // FAN ** j) for j in range(level + 1)) - 1 + sum((end - 1) // FAN ** j for j in range(level + 1, height(leaves) + 1))


@lru_cache(1 << 12)
def run_places(leaves: int, level: int, first: int) -> tuple[int, ...]:
    """Places in the log of the run of siblings that begins with node ``first``."""
    return tuple(position(leaves, level, i) for i in range(first, min(first + FAN, width(leaves, level))))


def sibling_places(leaves: int, node: int, level: int, top: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """For each level up to ``top``: the node's place in its run, and the log places of the run."""
    for at in range(level, top):
        yield node % FAN, run_places(leaves, at, node - node % FAN)
        node //= FAN


def fold(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The node above, after every level of ``path``, all as hexadecimal text."""
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
    return node


def pack_path(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: per level its place, how many siblings there are, and they."""
    return b"".join(bytes((place, len(others))) + unhexlify(b"".join(others)) for place, others in path)


def unpack_path(raw: bytes) -> list[tuple[int, list[bytes]]]:
    """The path in ``pack_path``'s bytes."""
    path, at = [], 0
    while at < len(raw):
        place, n = raw[at], raw[at + 1]
        path.append((place, [hexlify(raw[i:i + 32]) for i in range(at + 2, at + 2 + 32 * n, 32)]))
        at += 2 + 32 * n
    return path


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """H of a document's fields, with ``text`` as its text: 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(text if f == "text" else F.col(f)) for f in FIELDS]), 256))


def tampered_text() -> Column:
    """The text with A-Z lower-cased."""
    return F.translate("text", UPPER, UPPER.lower())


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, leaves (of the tree), node, doc_id, digest, other; trees: tree (the source's rank), source, leaves; log: all nodes."""

    leaves: DataFrame
    trees: DataFrame
    log: DataFrame
    root: bytes | None


def numbered_leaves(docs: DataFrame, tampered: Column) -> tuple[DataFrame, DataFrame]:
    """(leaves, trees) of a manifest. ``other`` is a leaf's digest after tampering where ``tampered`` holds, else null."""
    plain = docs.select(
        F.col("source").cast("string").alias("source"), "doc_id", leaf_digest(F.col("text")).alias("digest"),
        F.when(tampered & F.col("text").isNotNull(), leaf_digest(tampered_text())).alias("other"),
        F.monotonically_increasing_id().alias("tie"))  # repeated rows may lie in several ranges
    rows = number_rows(plain, ["source", "doc_id", "digest", "tie"])
    named = rows.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    held = named.groupBy("source", "_none", "_name").agg(F.min("seq").alias("_start"), F.count(F.lit(1)).alias("leaves"))
    trees = cut_lineage(number_rows(held, ["source"], "tree"))
    placed = option_join(named, trees.drop("source"), ["_none", "_name"])
    leaves = placed.select("tree", "leaves", (F.col("seq") - F.col("_start")).alias("node"), "doc_id", "digest", "other")
    return cut_lineage(leaves), trees.select("tree", "source", "leaves")


def _build_block(rows: pd.DataFrame) -> pd.DataFrame:
    """One builder: what it adds to the log over an aligned block, in completion order. ``rows`` are the block's nodes of one level."""
    rows = rows.sort_values("node")
    tree, level, leaves = (int(rows[c].iloc[0]) for c in ("tree", "level", "leaves"))
    top = min(height(leaves), level + LEVELS)
    last = width(leaves, level) - 1
    log: list[tuple] = []
    runs: list[list[bytes]] = [[] for _ in range(level, top)]

    def complete(at: int, node: int, value: bytes, final: bool) -> None:
        """Write a node; ``final``: its level has no further one, so its run ends here as well."""
        if at > level or not level:  # nodes that come from the pass before are in the log
            log.append((tree, at, node, position(leaves, at, node), unhexlify(value)))
        if at < top:
            run = runs[at - level]
            run.append(value)
            if len(run) == FAN or final:
                above = digest(run)
                run.clear()
                complete(at + 1, node // FAN, above, final)

    for node, value in zip(rows["node"], rows["digest"]):
        complete(level, int(node), hexlify(value), int(node) == last)
    return pd.DataFrame(log, columns=["tree", "level", "node", "position", "digest"])


def _passes(sizes: DataFrame) -> list[int]:
    """The lowest levels of the passes that trees of these sizes need."""
    most = sizes.agg(F.max("leaves")).first()[0]
    return [] if most is None else list(range(0, max(1, height(most)), LEVELS))


def build_log(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """The log (tree, level, node, position, digest) of the trees over ``leaves`` (tree, leaves, node, digest).

    Three levels a pass; a pass takes one node of each block of the pass before, of trees that have more than one block.
    """
    nodes = leaves.select("tree", "leaves", F.lit(0).alias("level"), "node", "digest")
    log = leaves.sparkSession.createDataFrame([], LOG)
    for level in _passes(sizes):
        if level:
            nodes = done.where(F.col("level") == level).join(sizes.where(F.col("leaves") > FAN ** level), "tree").select(*nodes.columns)
        block = F.shiftright("node", BITS * LEVELS).alias("block")
        done = cut_lineage(nodes.groupBy("tree", block).applyInPandas(_build_block, LOG))
        log = log.unionAll(done)
    return log


def _roots(log: DataFrame) -> DataFrame:
    """The last node of each tree."""
    return log.groupBy("tree").agg(F.max_by("digest", "position").alias("digest"))


def build_manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of ``docs``.

    Leaves ascend by doc_id, those without one first, equal ids by digest; a repeated row is a leaf of its own. Null values are told
    from empty ones. Documents without a source are a tree of their own, before all others. An empty table has no nodes and no root.
    Columns besides the five fields don't matter. ``tampered`` marks documents for which a second leaf, over the tampered text, is kept.
    """
    spark = docs.sparkSession
    leaves, trees = numbered_leaves(docs, F.lit(False) if tampered is None else tampered)
    log = build_log(leaves, trees)
    n = trees.count()
    if not n:
        return Manifest(leaves, trees, log, None)
    sources = cut_lineage(_roots(log).select(F.lit(SOURCES).cast("long").alias("tree"), F.lit(n).cast("long").alias("leaves"), F.col("tree").alias("node"), "digest"))
    top = build_log(sources, spark.createDataFrame([(SOURCES, n)], "tree long, leaves long"))
    return Manifest(leaves, trees, log.unionAll(top), hexlify(_roots(top).first().digest))


def store_log(manifest: Manifest, path: str) -> None:
    """The log as a table in the order of tree and position, so that a proof reads few row groups."""
    manifest.log.repartitionByRange("tree", "position").sortWithinPartitions("tree", "position").write.parquet(path)


def stored_proof(log: DataFrame, steps: list[tuple[int, int, int]]) -> list[tuple[int, list[bytes]]]:
    """The path of one leaf through the trees in ``steps`` (tree, its number of leaves, the leaf's node in it), fetched by log places alone."""
    path = []
    for tree, leaves, node in steps:
        wanted = list(sibling_places(leaves, node, 0, height(leaves)))
        places = [p for _, run in wanted for p in run]  # at most 16 a level
        found = {r.position: hexlify(r.digest) for r in log.where((F.col("tree") == tree) & F.col("position").isin(places)).collect()}
        path += [(own, [found[p] for i, p in enumerate(run) if i != own]) for own, run in wanted]
    return path


def _slices(log: DataFrame, sizes: DataFrame, level: int, above: DataFrame) -> DataFrame:
    """Per aligned block of nodes of ``level``: its part of the log, three levels high, and as level -1 the path above it."""
    rows = log.where(F.col("level").between(level, level + LEVELS - 1)).join(sizes, "tree")
    block = F.expr(f"shiftright(node, {BITS} * ({level + LEVELS} - level))")
    parts = rows.select("tree", block.alias("block"), "leaves", "level", "node", "position", "digest")
    tops = above.join(sizes, "tree").select(
        "tree", F.col("node").alias("block"), "leaves", F.lit(-1).alias("level"), "node", F.lit(-1).cast("long").alias("position"), F.col("path").alias("digest"))
    return parts.unionAll(tops)


def _read_slice(rows: pd.DataFrame, level: int) -> tuple[int, dict[int, bytes], bytes]:
    """(leaves of the tree, hexadecimal digest by log place, packed path above) of a block."""
    top = rows["level"] == -1
    low = rows[~top]
    return int(rows["leaves"].iloc[0]), dict(zip(low["position"], map(hexlify, low["digest"]))), rows.loc[top, "digest"].iloc[0]


def _path(leaves: int, at: dict[int, bytes], node: int, level: int) -> list[tuple[int, list[bytes]]]:
    """The path of a node inside its block."""
    top = min(height(leaves), level + LEVELS)
    return [(own, [at[p] for i, p in enumerate(run) if i != own]) for own, run in sibling_places(leaves, node, level, top)]


def _block_paths(log: DataFrame, sizes: DataFrame, level: int, above: DataFrame) -> DataFrame:
    """(tree, node, path) of all nodes of ``level``."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        leaves, at, rest = _read_slice(rows, level)
        nodes = [int(n) for n in rows.loc[rows["level"] == level, "node"]]
        return pd.DataFrame({"tree": int(rows["tree"].iloc[0]), "node": nodes, "path": [pack_path(_path(leaves, at, n, level)) + rest for n in nodes]})

    return cut_lineage(_slices(log, sizes, level, above).groupBy("tree", "block").applyInPandas(run, "tree long, node long, path binary"))


def _paths_above(log: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, node, path) of the blocks of leaves: paths from their upper ends to the root of all, fetched pass by pass from above.

    ``roots`` has (tree, path) of the trees' own roots.
    """
    known = roots.select("tree", F.lit(0).cast("long").alias("node"), "path").join(sizes, "tree")
    above = None
    for level in reversed(_passes(sizes)):
        within = known.where((F.col("leaves") <= FAN ** (level + LEVELS)) & (F.col("leaves") > (FAN ** level if level else 0))).select("tree", "node", "path")
        above = within if above is None else above.unionAll(within)
        if not level:
            return above
        larger = sizes.where(F.col("leaves") > FAN ** level)
        above = _block_paths(log, larger, level, above)


def _leaf_paths(log: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, node, path) of all leaves; for trees of few leaves."""
    return _block_paths(log, sizes, 0, _paths_above(log, sizes, roots))


def proofs(manifest: Manifest, paths: bool = False) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256 (SHA-256 of its siblings' texts from the leaf's level up), folded_root (from the
    tampered leaf, where there is one, and the siblings in the log), verified (it is the root), and with ``paths`` the packed path."""
    spark, root = manifest.leaves.sparkSession, manifest.root or b""
    given = manifest.leaves.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {given}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
              + (", path binary" if paths else ""))
    if manifest.root is None:
        return spark.createDataFrame([], schema)
    n = manifest.trees.count()
    one = spark.createDataFrame([(SOURCES, n)], "tree long, leaves long")
    upper = _leaf_paths(manifest.log.where(F.col("tree") == SOURCES), one, spark.createDataFrame([(SOURCES, bytearray())], "tree long, path binary"))
    log = manifest.log.where(F.col("tree") != SOURCES)
    sizes = manifest.trees.select("tree", "leaves")
    above = _paths_above(log, sizes, upper.select(F.col("node").alias("tree"), "path"))
    slices = _slices(log, sizes, 0, above).groupBy("tree", "block")
    docs = manifest.leaves.select("tree", "node", "doc_id", "digest", "other").withColumn("block", F.shiftright("node", BITS * LEVELS))

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        leaves, at, packed = _read_slice(rows, 0)
        rest, levels = unpack_path(packed), height(leaves)
        out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path")}
        for node, doc_id, leaf, other in zip(own["node"], own["doc_id"], own["digest"], own["other"]):
            path = _path(leaves, at, int(node), 0) + rest
            leaf = hexlify(leaf)
            subroot = fold(leaf, path[:levels])
            folded = fold(leaf if other is None else hexlify(other), path)
            proof = hashlib.sha256(b"".join(h for _, others in path for h in others)).hexdigest()
            row = (doc_id, leaf.decode(), subroot.decode(), root.decode(), proof, folded.decode(), folded == root, pack_path(path) if paths else None)
            for column, value in zip(out.values(), row):
                column.append(value)
        frame = pd.DataFrame(out)
        frame["doc_id"] = own["doc_id"].array
        return frame if paths else frame.drop(columns="path")

    return slices.cogroup(docs.groupBy("tree", "block")).applyInPandas(run, schema)


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the manifest, its proof, and whether a tampered text is found out."""
    docs = table(spark, folder, "documents")
    return proofs(build_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))


def _sql_levels(name: str, tree: str, levels: int) -> list[str]:
    """CTEs of a tree over ``{name}0`` (tree key, i, h): per level the runs, and the nodes above where a key has more than one."""
    out = []
    for j in range(levels):
        out.append(f"{name}r{j} AS (SELECT {tree}, i // 16 AS i, list(h ORDER BY i) AS run FROM "
                   f"(SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {name}{j}) WHERE n > 1 GROUP BY {tree}, i // 16)")
        out.append(f"{name}{j + 1} AS (SELECT {tree}, i, sha256(array_to_string(run, '')) AS h FROM {name}r{j})")
    return out


def _sql_climb(start: str, name: str, tree: str, levels: int) -> list[str]:
    """CTEs that carry each document (w, i, a, b, proof) up the levels: a folds the leaf, b the tampered one."""
    out, before = [], start
    for j in range(levels):
        now = f"{start}{j + 1}"
        out.append(f"""{now} AS (SELECT d.* EXCLUDE (i, a, b, proof), d.i // 16 AS i,
          CASE WHEN r.run IS NULL THEN a ELSE sha256(array_to_string(r.run, '')) END AS a,
          CASE WHEN r.run IS NULL THEN b ELSE sha256(array_to_string(r.run[:d.i % 16] || [b] || r.run[d.i % 16 + 2:], '')) END AS b,
          proof || CASE WHEN r.run IS NULL THEN '' ELSE array_to_string(r.run[:d.i % 16] || r.run[d.i % 16 + 2:], '') END AS proof
          FROM {before} d LEFT JOIN {name}r{j} r ON d.{tree} = r.{tree} AND d.i // 16 = r.i)""")
        before = now
    return out


def _sql() -> str:
    levels = 6
    def leaf(text: str) -> str:
        fields = [f if f != "text" else text for f in FIELDS]
        return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END" for f in fields) + ")"

    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    parts = [
        "bits AS (SELECT 0 AS k, n, n AS c FROM range(256) t(n) UNION ALL "
        "SELECT k + 1, n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8)",
        "crcs AS (SELECT list(c ORDER BY n) AS crc FROM bits WHERE k = 8)",
        f"docs AS (SELECT row_number() OVER () AS w, doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) AS t, {leaf('text')} AS h, {leaf(lower)} AS o, "
        "xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], "
        "lambda c, x: xor(c // 256, crc[(xor(c, x) % 256) + 1])), 4294967295) AS crc FROM documents, crcs)",
        "s0 AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h, w) - 1 AS i, h FROM docs)",
        *_sql_levels("s", "t", levels),
        "subroots AS (SELECT t, h FROM (" + " UNION ALL ".join(f"SELECT t, h, {j} AS j FROM s{j}" for j in range(levels + 1)) + ") QUALIFY row_number() OVER (PARTITION BY t ORDER BY j DESC) = 1)",
        "u0 AS (SELECT 0 AS z, t - 1 AS i, h FROM subroots)",
        *_sql_levels("u", "z", levels),
        "root AS (SELECT h FROM (" + " UNION ALL ".join(f"SELECT h, {j} AS j FROM u{j}" for j in range(levels + 1)) + ") ORDER BY j DESC LIMIT 1)",
        "d AS (SELECT s0.w, s0.t, 0 AS z, s0.i, s0.h AS a, CASE WHEN crc % 5 = 0 AND o IS NOT NULL THEN o ELSE s0.h END AS b, '' AS proof FROM s0 JOIN docs USING (w))",
        *_sql_climb("d", "s", "t", levels),
        f"e AS (SELECT * EXCLUDE (i, a), t - 1 AS i, a FROM d{levels})",
        *_sql_climb("e", "u", "z", levels),
    ]
    return ("WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT docs.doc_id, docs.h AS leaf, subroots.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, b AS folded_root, b = root.h AS verified
FROM e{levels} x JOIN docs USING (w) JOIN subroots ON subroots.t = docs.t, root""")


QUERIES = {"op12_merkle": (op12_merkle, _sql())}

"""SimHash near-duplicates by multi-index hashing over the two halves of a fingerprint.

Two fingerprints that differ in at most three bits have a half in which they differ in at most one. Each half of a fingerprint is a
table key; every fingerprint asks for its own halves and all halves one bit away, and the full distance decides. Only distinct
fingerprints are looked up. A half shared by very many distinct fingerprints is indexed again by the quarters of its other half, in
the same way, so no bucket is compared pair by pair in full.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm.common import table
from postingflow.llm.components import smallest_reachable
from postingflow.session import cut_lineage

SHINGLE = 3
SEED = 42
DISTANCE = 3
BUCKET = 1024
HASHES_AT_ONCE = 1 << 17

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_bytes(text: str | None, width: int) -> list[bytes]:
    """Space-joined runs of ``width`` words with A-Z lower-cased; all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and ASCII white space only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; 0 without shingles."""
    shingles = shingle_bytes(text, width)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), HASHES_AT_ONCE):
        part = shingles[at:at + HASHES_AT_ONCE]
        h = np.fromiter(map(_hash, part), "<u8", len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (a signed long with the same bits) of every row."""
    def run(batches):
        for b in batches:
            bits = np.fromiter((fingerprint(t, width) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _ball(key: Column, bits: int) -> Column:
    """The key and all keys one bit away."""
    return F.explode(F.array(key, *[key.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(bits)]))


def _part(name: str, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _parts(rows: DataFrame, name: str, shifts: Column, bits: int, ball: bool, at: str, key: str) -> DataFrame:
    """A row for each part of ``name`` and, if ``ball``, each key near it: columns at (0 or 1) and key."""
    cut = rows.withColumn(at, F.explode(F.array(F.lit(0), F.lit(1))))
    value = F.when(F.col(at) == 0, _part(name, shifts[0], bits)).otherwise(_part(name, shifts[1], bits))
    return cut.withColumn(key, value) if not ball else cut.withColumn("_v", value).withColumn(key, _ball(F.col("_v"), bits)).drop("_v")


def near_pairs(distinct: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """(x, y) fingerprints at most ``distance`` (3 or less) bits apart, from distinct fingerprints in column ``fp``; pairs may repeat.

    ``bucket`` only decides which halves are indexed a second time; the pairs are the same for any value.
    """
    if distance > 3:
        raise ValueError("two halves with balls of radius one reach a distance of 3")
    index = cut_lineage(_parts(distinct, "fp", (0, 32), 32, False, "half", "key"))
    hot = index.groupBy("half", "key").count().where(F.col("count") > bucket).select("half", "key")
    hot = cut_lineage(hot)
    near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance) & (F.col("x") != F.col("y"))
    asks = _parts(distinct.select(F.col("fp").alias("x")), "x", (0, 32), 32, True, "half", "key")
    common = index.join(hot, ["half", "key"], "left_anti").withColumnRenamed("fp", "y")
    out = asks.join(common, ["half", "key"]).where(near).select("x", "y")
    if hot.isEmpty():
        return out
    # The other half of hot members: a quarter in which a pair differs in at most one bit.
    held = index.join(hot, ["half", "key"]).withColumnRenamed("fp", "y")
    centres = hot.withColumn("near", _ball(F.col("key"), 32)).withColumnRenamed("key", "centre")
    asking = index.withColumnRenamed("key", "near").join(centres, ["half", "near"]).select("half", F.col("centre").alias("key"), F.col("fp").alias("x"))

    def rest(rows: DataFrame, name: str, ball: bool) -> DataFrame:
        other = rows.withColumn("_rest", F.when(F.col("half") == 0, _part(name, 32, 32)).otherwise(_part(name, 0, 32)))
        return _parts(other, "_rest", (0, 16), 16, ball, "quarter", "sub").drop("_rest")

    deep = rest(asking, "x", True).join(rest(held, "y", False), ["half", "key", "quarter", "sub"]).where(near).select("x", "y")
    return out.unionAll(deep)


def _members(nodes: DataFrame, bucket: int) -> DataFrame:
    """fingerprint and component (the smallest fingerprint reachable) of the distinct fingerprints in ``nodes``."""
    pairs = near_pairs(nodes.select(F.col("fingerprint").alias("fp")), bucket)
    # Fingerprints are the nodes; ids may be missing.
    found = smallest_reachable(pairs.where("x > y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    return nodes.join(found, nodes["fingerprint"] == found["node"], "left").select(
        *nodes.columns, F.coalesce("component", "fingerprint").alias("component"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row: the smallest doc_id reachable over links of 3 bits or fewer.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other. A repeated row is a row of its own with the
    same result. Rows without an id get a fingerprint and the component of their equals; if no row of it has an id it is null. An
    empty table gives an empty one. Only doc_id and text are read.
    """
    rows = cut_lineage(fingerprints(docs, width))
    nodes = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    member = cut_lineage(_members(nodes, bucket))
    smallest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = member.join(smallest, "component").select("fingerprint", "component_id")
    return rows.join(labels, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row, with all its columns, of each component: that with the smallest id.

    Rows without an id come after those with one; among rows alike in that, the smallest 128-bit digest of the whole row stays, and
    rows alike in everything are one. Null, empty and wordless texts are one component. An empty table gives an empty one.
    Columns may have any names.
    """
    whole = F.struct(*docs.columns)
    packed = docs.select(whole.alias("row"), "doc_id", "text", F.md5(F.to_json(whole, {"ignoreNullFields": "false"})).alias("digest"))
    given = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            bits = np.fromiter((fingerprint(t, width) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array(bits.view(np.int64))], ["doc_id", "digest", "fingerprint"])

    texts = packed.select("doc_id", "digest", F.col("text").cast("string").alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    nodes = cut_lineage(texts.mapInArrow(run, f"doc_id {given}, digest string, fingerprint long").groupBy("fingerprint").agg(first))
    kept = cut_lineage(_members(nodes, bucket).groupBy("component").agg(F.min("first").alias("first")))
    stays = packed.join(kept.select(F.col("first.digest").alias("digest")), "digest", "left_semi")
    # Rows alike in everything have one digest; they meet only among the rows that stay.
    return stays.groupBy("digest").agg(F.first("row").alias("row")).select("row.*")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, folder, "documents"))


QUERIES = {"op2_simhash": (op2_simhash, None)}

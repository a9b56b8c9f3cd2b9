"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained on a small labelled URL table. Where none is given, the table is a bounded sample of the urls that the rules
decide, labelled by the rule; the model then judges the urls that no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postingflow.llm.common import annotated, table, without
from postingflow.llm.features import Texts, byte_grams, chunks
from postingflow.llm.linear import logistic, sigmoid

# (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LABELLED = 1000
BITS = 12
ORDERS = (3, 4, 5, 6)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, ties to the smaller code points; null if none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(text))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(kind))
    return rule, verdict


def _grams(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of every n-gram that lies within one text, for each n."""
    row = np.repeat(np.arange(len(t)), np.diff(t.starts))
    out = []
    for n in ORDERS:
        if len(row) >= n:
            at = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
            out.append((row[at], (byte_grams(t.data, n)[at] >> np.uint64(64 - BITS)).astype(np.int64)))
    return out


def gram_matrix(t: Texts) -> np.ndarray:
    """1 where a text has a gram of the bucket; a row per text. Meant for small chunks."""
    x = np.zeros((len(t), 1 << BITS), np.float32)
    for row, bucket in _grams(t):
        x[row, bucket] = 1
    return x


@dataclass(frozen=True)
class Model:
    """Weight of each bucket; the last is the bias."""

    weights: np.ndarray

    def scores(self, t: Texts) -> np.ndarray:
        pairs = [np.unique((row << BITS) | bucket) for row, bucket in _grams(t)]
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return sigmoid(np.bincount(both >> BITS, self.weights[both & (1 << BITS) - 1], len(t)) + self.weights[-1])


def train(labelled: DataFrame, limit: int = LABELLED) -> Model:
    """Fit on distinct (host, path, blocked) rows, at most ``limit`` of each label, picked by a hash. With one label only, that label is the answer."""
    def run(batches):
        for b in batches:
            for first, t in chunks(b.column("place"), 1 << 18, 256):
                yield pa.RecordBatch.from_arrays([b.column("blocked").slice(first, len(t)), pa.array([r.tobytes() for r in gram_matrix(t).astype(np.uint8)], pa.binary())], ["blocked", "x"])

    rows = labelled.select(F.concat("host", "path").alias("place"), "blocked").distinct().withColumn("_key", F.xxhash64("place"))
    parts = [rows.where("blocked" if b else "NOT blocked").orderBy("_key", "place").limit(limit).select("place", "blocked") for b in (True, False)]
    got = parts[0].unionAll(parts[1]).mapInArrow(run, "blocked boolean, x binary").toArrow()  # at most twice the limit
    y = np.asarray(got.column("blocked")).astype(int)
    if y.sum() in (0, len(y)):
        return Model(np.append(np.zeros(1 << BITS), 4.0 if y.sum() else -4.0))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(len(y), -1).astype(np.float32)
    order = np.lexsort((x.sum(axis=1), y))
    return Model(logistic(x[order], y[order]))


def judge(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, verdict and block_score (chance of block by the model, whatever the rules say).

    A null url or one without ``://`` has an empty host and path, which no rule fits: the model alone judges it. Rows with the same
    url get the same verdict. ``labelled`` has url and blocked (boolean). Columns of ``pages`` named like a result are replaced.
    """
    added = ("host", "path", "rule", "verdict", "block_score")
    rows = without(pages, added).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    if labelled is None:
        seen = rows.select("host", "path", (verdict == "block").alias("blocked")).where("blocked IS NOT NULL")
    else:
        seen = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked")
    model = train(seen)

    def compute(get, n):
        out = np.zeros(n)
        for first, t in chunks(get("place")):
            out[first:first + len(t)] = model.scores(t)
        return [pa.array(out)]

    score = StructType([StructField("block_score", DoubleType())])
    scored = annotated(rows, score, compute, {"place": F.concat("host", "path")}).select("row.*", "block_score")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))})


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page url."""
    return judge(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op10_urls": (op10_urls, None)}

"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled documents are all the classifiers see. A text's features are which words and which pieces of
words, five and seven bytes long, it holds, hashed; those that stand out among the confirmed rows are selected, so a long clean text collects no weight
from ordinary words. Samples are bounded: POSITIVES confirmed and about UNLABELLED other documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postingflow.llm.common import KEY_BITS, annotated, fold, shuffle_key, table, without
from postingflow.llm.features import LOWER, SPACE, Texts, byte_grams, chunks, text_of, word_hashes, word_limits
from postingflow.llm.linear import nn_pu, sigmoid
from postingflow.session import cut_lineage

POSITIVES = 4000
UNLABELLED = 12000
SELECTED = 1024
BITS = 22
GRAMS = (5, 7)
SEEDS = (0, 1, 2)
HELD_OUT = 5
EDGE = np.isin(np.arange(256), np.frombuffer(b"!\"'(),-.:;?[]", np.uint8))


def text_features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, without punctuation at their ends, and pieces inside words, lower-cased: (text, bucket) of each."""
    data = LOWER[t.data]
    plain = data.copy()
    plain[EDGE[data]] = 0x20
    starts, ends = word_limits(Texts(plain, t.starts))
    words = word_hashes(plain, starts, ends)
    space = SPACE[plain].astype(np.int32)
    gaps = np.concatenate([[0], np.cumsum(space)])
    where, hashes = [starts], [words]
    for n in GRAMS:
        if len(plain) >= n:
            where.append(np.flatnonzero(gaps[n:] == gaps[:-n]))
            hashes.append(byte_grams(plain, n)[where[-1]])
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(where), bucket


def _once(texts: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((texts.astype(np.int64) << BITS) | buckets)
    return both >> BITS, both & (1 << BITS) - 1


@dataclass(frozen=True)
class Model:
    """Selected buckets in order, and the mean of the classifiers' weights (the last is the bias)."""

    buckets: np.ndarray
    weights: np.ndarray

    def scores(self, t: Texts, slot: np.ndarray) -> np.ndarray:
        """Score of each text; ``slot`` maps a bucket to its selected number or -1."""
        where, bucket = text_features(t)
        hit = np.flatnonzero(slot[bucket] >= 0)
        texts, chosen = _once(text_of(t, where[hit]), bucket[hit])
        margin = np.bincount(texts, self.weights[slot[chosen]], len(t)) + self.weights[-1]
        return sigmoid(margin)

    def slots(self) -> np.ndarray:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.buckets] = np.arange(len(self.buckets))
        return slot


def training_sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """text, positive and unlabelled (booleans): confirmed toxic rows outside the held-out fold, and documents outside it picked by a hash of
    their id, confirmed or not, so that the unlabelled rows are drawn as all documents are.

    Only the picked ids are broadcast, at most ``positives``. A repeated id counts once.
    """
    confirmed = (labels.where((F.col("toxic") == 1) & (fold(F.col("doc_id"), HELD_OUT) > 0)).select("doc_id").distinct()
                 .withColumn("_key", shuffle_key(F.col("doc_id"))).orderBy("_key", "doc_id").limit(positives).select("doc_id", F.lit(True).alias("_positive")))
    share = min(1.0, unlabelled / max(1, docs.count()))
    picked = (docs.select("doc_id", "text").where(fold(F.col("doc_id"), HELD_OUT) > 0)
              .join(F.broadcast(confirmed), "doc_id", "left")
              .select("doc_id", "text", F.coalesce("_positive", F.lit(False)).alias("positive"), (shuffle_key(F.col("doc_id")) < int(share * (1 << KEY_BITS))).alias("unlabelled"))
              .where("positive OR unlabelled"))
    return picked.dropDuplicates(["doc_id"]).select("positive", "unlabelled", "text")


def class_prior(labels: DataFrame) -> float:
    """Share of toxic rows among the labels outside the held-out fold."""
    r = labels.where((fold(F.col("doc_id"), HELD_OUT) > 0) & F.col("toxic").isNotNull()).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()
    return min(0.5, max(0.001, r.p or 0.0))


def select_features(sample: DataFrame, keep: int = SELECTED) -> tuple[np.ndarray, int, int]:
    """The buckets whose document share among positives exceeds that among unlabelled rows by most standard errors, and both row counts.

    At most ``keep`` and half as many as there are positives, but 32 at least: few rows can't tell many features apart.
    """
    def run(batches):
        counts = {k: np.zeros(1 << BITS, np.int32) for k in ("positive", "unlabelled")}
        rows = dict.fromkeys(counts, 0)
        for b in batches:
            for first, t in chunks(b.column("text")):
                where, bucket = text_features(t)
                texts, buckets = _once(text_of(t, where), bucket)
                for kind in counts:
                    own = np.asarray(b.column(kind))[first:first + len(t)]
                    counts[kind] += np.bincount(buckets[own[texts]], minlength=1 << BITS).astype(np.int32)
                    rows[kind] += int(own.sum())
        # Bucket -1 carries the rows seen.
        at = np.flatnonzero(counts["positive"] + counts["unlabelled"])
        p, u = (pa.array(np.append(counts[k][at], rows[k]), pa.int64()) for k in counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), p, u], ["bucket", "p", "u"])

    found = cut_lineage(sample.mapInArrow(run, "bucket int, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))
    rows = found.where("bucket < 0").first()
    if rows is None or not rows.p or not rows.u:
        return np.zeros(0, np.int64), 0, 0
    share_p, share_u = F.col("p") / rows.p, F.col("u") / rows.u
    pooled = (F.col("p") + F.col("u") + 1) / (rows.p + rows.u)
    score = (share_p - share_u) / F.sqrt(pooled * (1 / rows.p + 1 / rows.u))
    keep = min(keep, max(32, rows.p // 2))
    best = (found.where((F.col("bucket") >= 0) & (F.col("p") >= 3) & (share_p > share_u))
            .orderBy(score.desc(), "bucket").limit(keep).select("bucket").collect())
    return np.sort(np.array([r.bucket for r in best], np.int64)), rows.p, rows.u


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Fit the classifiers. Without confirmed or unlabelled rows the score is the prior everywhere."""
    prior = class_prior(labels) if prior is None else prior
    sample = cut_lineage(training_sample(docs, labels))
    buckets, _, _ = select_features(sample)
    if not len(buckets):
        return Model(buckets, np.array([np.log(prior / (1 - prior))]))
    empty = Model(buckets, np.zeros(len(buckets) + 1))

    def run(batches):
        slot = empty.slots()
        for b in batches:
            for first, t in chunks(b.column("text")):
                where, bucket = text_features(t)
                hit = np.flatnonzero(slot[bucket] >= 0)
                texts, chosen = _once(text_of(t, where[hit]), bucket[hit])
                cuts = np.searchsorted(texts, np.arange(len(t) + 1))
                found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(slot[chosen], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(first, len(t)) for k in ("positive", "unlabelled")), found], ["positive", "unlabelled", "features"])

    rows = sample.mapInArrow(run, "positive boolean, unlabelled boolean, features array<int>").toArrow()  # bounded sample, selected features only
    lists = rows.column("features").combine_chunks()
    positive, unlabelled = (np.asarray(rows.column(k)) for k in ("positive", "unlabelled"))
    x = np.zeros((len(positive), len(buckets)), np.float32)
    x[np.repeat(np.arange(len(x)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())] = 1
    order = np.lexsort((*x.T[:8], x.sum(axis=1)))  # the sample's row order must not matter much
    x, positive, unlabelled = x[order], positive[order], unlabelled[order]
    return Model(buckets, np.mean([nn_pu(x[positive], x[unlabelled], prior, seed=s) for s in SEEDS], axis=0))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of ``docs``) and _toxicity."""
    def compute(get, n):
        slot, out = model.slots(), np.zeros(n)
        for first, t in chunks(get("text")):
            out[first:first + len(t)] = model.scores(t, slot)
        return [pa.array(out)]

    return annotated(docs, StructType([StructField("_toxicity", DoubleType())]), compute)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with _toxicity (0 to 1); a column of that name is replaced.

    A null or empty text scores what no evidence scores. Whole texts are read; equal texts score alike, an empty table gives none.
    """
    return _scored(without(docs, ["_toxicity"]), model).select("row.*", "_toxicity")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with all their columns as they are, whatever their names; 0.5 itself is rejected."""
    return _scored(docs, train(docs, labels)).where("_toxicity < 0.5").select("row.*")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    return score_documents(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": (op9_toxicity, None)}

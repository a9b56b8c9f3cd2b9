"""Quality rules: counts over whole texts, and a log-likelihood ratio of hashed n-grams between trusted text and the raw corpus.

The raw model counts the words and word pairs of all documents in hashed buckets; the trusted model those of documents labelled as
good. A document's score is the mean log ratio over its own n-grams. Documents below the threshold are dropped. It lies below the score
that all but a fixed share of the trusted documents reach, by that score's distance from their median; equal documents get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from postingflow.llm.common import annotated, table, without
from postingflow.llm.features import Texts, chunks, mix, text_of, word_hashes, word_limits
from postingflow.operators.scan import number_rows
from postingflow.session import cut_lineage, stored

BITS = 16
PASSING = 0.995
SMOOTHING = 0.5
MIN_WORDS = 50
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ids(t: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each byte range; equal numbers mean equal bytes."""
    lengths = ends - starts
    take = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(t.data[take])])
    return np.asarray(values.dictionary_encode().indices).astype(np.int64)


def base_counts(t: Texts, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts for each text; ``starts`` and ``ends`` limit its words."""
    n = len(t)
    of_word = text_of(t, starts)
    n_words = np.bincount(of_word, minlength=n)
    # Code points: bytes in words that don't continue a character.
    head = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    word_chars = np.bincount(of_word, head[ends] - head[starts], n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[t.data])])
    n_symbols = symbols[t.starts[1:]] - symbols[t.starts[:-1]]

    # Lines end at a newline or at the text's closing space; only those with a word count.
    closing = np.zeros(len(t.data), bool)
    closing[t.starts[1:] - 1] = True
    line_end = np.flatnonzero((t.data == 0x0A) | closing)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    first_word = np.searchsorted(starts, line_start)
    wordy = (first_word < len(starts)) & (np.append(starts, len(t.data))[first_word] < line_end)
    line_start, line_end = line_start[wordy], line_end[wordy]
    of_line = text_of(t, line_start)
    same = _repeats(of_line, _ids(t, line_start, line_end))
    n_dup_lines = np.bincount(of_line[same[1]], minlength=n)

    # Words covered by a window of three that occurs again in the text.
    ids = _ids(t, starts, ends)
    covered = np.zeros(len(ids), bool)
    if len(ids) >= 3:
        inside = np.flatnonzero(of_word[2:] == of_word[:-2])
        pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
        window = pair[inside] * (ids.max() + 1) + ids[inside + 2]
        again, _ = _repeats(of_word[inside], window)
        for k in range(3):
            covered[inside[again] + k] = True
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
            "n_repeat_words": np.bincount(of_word[covered], minlength=n)}


def _repeats(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose value occurs more than once in their group, and those among them that aren't the first. Groups come in order."""
    order = np.argsort(value, kind="stable")
    g, v = group[order], value[order]
    equal = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    later = np.concatenate([[False], equal])
    any_ = later | np.concatenate([equal, [False]])
    return order[any_[:len(order)]], order[later[:len(order)]]


def gram_buckets(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and of every pair of neighbouring words; pairs use the upper half of the buckets."""
    of_word, h = text_of(t, starts), word_hashes(t.data, starts, ends)
    both = np.flatnonzero(of_word[1:] == of_word[:-1]) if len(h) > 1 else np.zeros(0, np.int64)
    pairs = mix(h[both] * np.uint64(3) + h[both + 1])
    shift = np.uint64(64 - BITS)
    return (np.concatenate([of_word, of_word[both]]),
            np.concatenate([(h >> shift).astype(np.int64), (pairs >> shift).astype(np.int64) + (1 << BITS)]))


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, and the least mean that passes."""

    ratio: np.ndarray
    threshold: float

    def means(self, t: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log ratio of each text; 0 without words."""
        texts, buckets = gram_buckets(t, starts, ends)
        # Rounded, so that the order of summing can't decide.
        return np.round(np.bincount(texts, self.ratio[buckets], len(t)) / np.maximum(1, np.bincount(texts, minlength=len(t))), 9)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket over all rows. A task sends at most one row per bucket."""
    def run(batches):
        counts = np.zeros(2 << BITS, np.int64)
        for b in batches:
            for _, t in chunks(b.column("text")):
                counts += np.bincount(gram_buckets(t, *word_limits(t))[1], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 << BITS, np.int64)  # as many rows as buckets
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return out


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text of every document labelled as good; rows with one id count once."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    return docs.select("doc_id", "text").join(good, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("text")


def _at_ranks(means: DataFrame, *shares) -> list[float]:
    """The numbers of column m whose place by size, from 0, ``shares`` give for a count of them; sorted over the cluster, only those are sent back."""
    spread = means.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # copies have one mean
    ranked = cut_lineage(number_rows(spread, ["m", "tie"], "place"))
    count = ranked.count()
    wanted = [share(count) for share in shares]
    held = {r.place: r.m for r in ranked.where(F.col("place").isin(wanted)).collect()}
    return [held[k] for k in wanted]


def train(docs: DataFrame, labels: DataFrame, passing: float = PASSING) -> Model:
    """Count both models and set the threshold. Without trusted documents every ratio is 0 and everything passes."""
    trusted = stored(trusted_documents(docs, labels))
    raw, good = corpus_counts(docs), corpus_counts(trusted)
    if not good.sum():
        return Model(np.zeros(2 << BITS), 0.0)
    half = 1 << BITS
    # A bucket the trusted documents are too few to show says little: both models are smoothed by the raw share.
    share = [np.maximum(raw[k:k + half], 0) + SMOOTHING for k in (0, half)]
    share = np.concatenate([s / s.sum() for s in share])
    total = np.concatenate([np.full(half, good[:half].sum()), np.full(half, good[half:].sum())])
    prior = SMOOTHING * half
    ratio = np.log((good + prior * share) / (total + prior)) - np.log(share)
    model = Model(ratio, 0.0)

    def run(batches):
        for b in batches:
            for _, t in chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(model.means(t, *word_limits(t)))], ["m"])

    low, below, above = _at_ranks(trusted.mapInArrow(run, "m double"), lambda n: int((1 - passing) * n), lambda n: (n - 1) // 2, lambda n: n // 2)
    # Documents that weren't counted as trusted score lower than those that were, so the limit lies as far below again.
    return Model(ratio, low - ((below + above) / 2 - low))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with the base counts, quality_ratio, base_failed and kept; columns of these names are replaced.

    A null, empty or wordless text has no words and fails the base rules. Whole texts are read; repeated rows get the same verdict; a ratio
    equal to the threshold is kept; an empty table gives an empty result.
    """
    def compute(get, n):
        out = {k: np.zeros(n, np.int64) for k in BASE}
        mean = np.zeros(n)
        for first, t in chunks(get("text")):
            at, words = slice(first, first + len(t)), word_limits(t)
            for k, v in base_counts(t, *words).items():
                out[k][at] = v
            mean[at] = model.means(t, *words)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        return [pa.array(out[k]) for k in BASE] + [pa.array(mean), pa.array(failed), pa.array(~failed & (mean >= model.threshold))]

    more = StructType([*[StructField(k, LongType()) for k in BASE], StructField("quality_ratio", DoubleType()),
                       StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])
    return annotated(without(docs, more.names), more, compute).select("row.*", *more.names)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels").select("doc_id", "quality"))
    return judge(docs, model).drop("text")


QUERIES = {"op8_quality": (op8_quality, None)}

"""Language identification in two steps: the family first, then one-versus-one support vector machines within it.

Features are the shares of hashed byte 1- to 4-grams of the lower-cased text. Models are trained on a bounded sample, about
PER_LANGUAGE documents of each language, however many languages there are. Each model is fitted in a task of its own: one per pair of
languages of a family, one per family against about FAMILY_ROWS rows of the others. The driver gets weights only. Every document is
then scored whole, at one table lookup per gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from postingflow.llm.common import KEY_BITS, annotated, fold, shuffle_key, table, without
from postingflow.llm.features import LOWER, Texts, byte_grams, chunks
from postingflow.llm.linear import linear_svm, sigmoid
from postingflow.operators.scan import option_join
from postingflow.session import cut_lineage

PER_LANGUAGE = 400
FAMILY_ROWS = 4096
BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
SCALE = 60.0
TRAIN_CHUNK, TRAIN_ROWS = 1 << 18, 256
FOLDS, HELD_OUT = 4, 2

# Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "indo_aryan": ("hi", "bn", "ur", "pa", "mr", "gu", "ne", "si"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am", "mt"),
}


def family(lang: str) -> str:
    """The family of a language code."""
    return next((name for name, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), lang)


def _grams(t: Texts) -> list[np.ndarray]:
    """Bucket of the gram from each position on, for each order."""
    data = LOWER[t.data]
    return [(byte_grams(data, n, t.starts) >> np.uint64(64 - 13)).astype(np.int64) for n in ORDERS]


def share_matrix(t: Texts) -> np.ndarray:
    """Scaled gram shares of each text, a row per text. Meant for small chunks."""
    lengths = np.diff(t.starts)
    row = np.repeat(np.arange(len(t)), lengths)
    counts = np.zeros(len(t) * BUCKETS)
    for g in _grams(t):
        counts += np.bincount(row * BUCKETS + g, minlength=len(counts))
    return (counts.reshape(len(t), BUCKETS) / (lengths[:, None] * len(ORDERS)) * SCALE).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Column i of ``weights`` (the last row is the bias) belongs to family i or to a pair of languages."""

    languages: tuple[str, ...]
    families: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    def margins(self, t: Texts) -> np.ndarray:
        """Decision values, a row per text: each gram adds its weights."""
        lengths = np.diff(t.starts)
        total = np.zeros((len(t), self.weights.shape[1]))
        table = np.ascontiguousarray(self.weights[:-1])
        for g in _grams(t):
            for c in range(table.shape[1]):
                total[:, c] += np.add.reduceat(table[:, c][g], t.starts[:-1])
        return total / (lengths[:, None] * len(ORDERS)) * SCALE + self.weights[-1]

    def predict(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score of 0 to 1 for each text."""
        n, nf = len(t), len(self.families)
        if len(self.languages) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        m = self.margins(t)
        if nf > 1:
            chosen = m[:, :nf].argmax(axis=1)
            p = sigmoid(2 * m[:, :nf])
            sure = p.max(axis=1) / p.sum(axis=1)
        else:
            chosen, sure = np.zeros(n, np.int64), np.ones(n)
        votes = np.zeros((n, len(self.languages)))
        for k, (a, b) in enumerate(self.pairs):
            p = sigmoid(2 * m[:, nf + k])
            votes[:, a] += (p >= 0.5) + 1e-3 * p
            votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
        of = [family(x) for x in self.languages]
        member = np.array([[x == f for x in of] for f in self.families])
        votes = np.where(member[chosen], votes, -1.0)
        best = votes.argmax(axis=1)
        for k, (a, b) in enumerate(self.pairs):
            p = sigmoid(2 * m[:, nf + k])
            sure = np.where(best == a, np.minimum(sure, p), np.where(best == b, np.minimum(sure, 1 - p), sure))
        return best, np.clip(sure, 0.0, 1.0)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang and text of about ``per_language`` documents of every language, outside the held-out fold.

    Documents are picked by a hash of their id against a share that follows from the language's count. A repeated id counts once.
    """
    usable = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    whole = float(1 << KEY_BITS)
    shares = usable.groupBy("lang").agg(F.least(F.lit(whole), F.lit(per_language * whole) / F.count(F.lit(1))).cast("long").alias("_share"))
    picked = option_join(usable, shares, ["lang"]).where(shuffle_key(F.col("doc_id")) < F.col("_share"))
    return picked.dropDuplicates(["doc_id"]).select("lang", "text")


def _fit(key, rows):
    """Weights of one model from its rows (lang, sign, x), whatever order they arrive in."""
    langs, features, signs = (rows.column(c).to_pylist() for c in ("lang", "x", "sign"))
    order = sorted(range(len(langs)), key=lambda i: (langs[i], features[i]))
    x = np.frombuffer(b"".join(features[i] for i in order), np.float32).reshape(len(order), BUCKETS)
    weights = linear_svm(x, np.array([signs[i] for i in order])).astype(np.float32)
    return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary())})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, family_rows: int = FAMILY_ROWS) -> Model | None:
    """Fit the two steps; None if no document has a language.

    A family's model sees all sampled rows of the family and, of the others, about ``family_rows`` picked by a hash of their features.
    """
    def run(batches):
        for b in batches:
            for first, t in chunks(b.column("text"), TRAIN_CHUNK, TRAIN_ROWS):
                x = share_matrix(t)
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").slice(first, len(t)), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    sample = cut_lineage(training_sample(docs, per_language).mapInArrow(run, "lang string, x binary"))
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    languages = tuple(sorted(counts))
    of = {x: family(x) for x in languages}
    families = tuple(sorted(set(of.values())))
    pairs = tuple((i, j) for i, a in enumerate(languages) for j, b in enumerate(languages) if i < j and of[a] == of[b])
    nf, total = len(families), sum(counts.values())
    weights = np.zeros((nf + len(pairs), BUCKETS + 1), np.float32)
    uses = []  # (lang, model, sign, share of the rows)
    for k, f in enumerate(families if nf > 1 else ()):
        others = total - sum(n for x, n in counts.items() if of[x] == f)
        share = min(1.0, family_rows / others)
        uses += [(x, k, 1, 1.0) if of[x] == f else (x, k, -1, share) for x in languages]
    for k, pair in enumerate(pairs):
        uses += [(languages[i], nf + k, sign, 1.0) for i, sign in zip(pair, (1, -1))]
    if uses:
        models = docs.sparkSession.createDataFrame(uses, "lang string, model int, sign int, share double").groupBy("lang").agg(
            F.collect_list(F.struct("model", "sign", "share")).alias("uses"))
        rows = option_join(sample, models, ["lang"]).select("lang", "x", F.explode("uses").alias("use")).select("lang", "x", "use.*")
        chance = F.pmod(F.xxhash64("x", "model"), F.lit(1 << 30)) / float(1 << 30)
        fitted = rows.where((F.col("share") >= 1) | (chance < F.col("share"))).groupBy("model").applyInArrow(_fit, "model int, weights binary")
        for r in fitted.toArrow().to_pylist():
            weights[r["model"]] = np.frombuffer(r["weights"], np.float32)
    return Model(languages, families, pairs, weights.T)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and lang_score; columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, as are all texts without a model. Equal texts get the same answer; equal votes
    go to the larger margins, then to the language first by name. An empty table gives an empty result.
    """
    def compute(get, n):
        lang, score = np.full(n, "und", object), np.zeros(n)
        lettered = np.asarray(get("lettered").fill_null(False))
        for first, t in chunks(get("text")):
            if model is None:
                break
            best, sure = model.predict(t)
            at = slice(first, first + len(t))
            lang[at] = np.where(lettered[at], np.array(model.languages, object)[best], "und")
            score[at] = np.where(lettered[at], sure, 0.0)
        return [pa.array(lang, pa.string()), pa.array(score)]

    added = StructType([StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return annotated(without(docs, added.names), added, compute, {"lettered": F.col("text").rlike(r"\p{L}")}).select("row.*", *added.names)


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, folder, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op1_language": (op1_language, None)}

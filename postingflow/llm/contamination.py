"""Benchmark decontamination with suffix arrays over the training texts.

The documents that one task reads are cut into shards of about a million words. A shard's words become the numbers that the benchmark's
vocabulary gives them; all other words and the ends of documents are 0, which ends a match. The shard's suffixes are sorted by prefix
doubling as deep as the longest benchmark item, and every suffix of every item is looked up by binary search, all at once. That gives its
longest verbatim match and where it is, and for each window of ten words the range of suffixes that begin with it: its occurrences.

The benchmark goes to the tasks in blocks of bounded size, one job a block; usually there is one. Documents never leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from postingflow.llm.common import table
from postingflow.session import cut_lineage

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 4 << 20
STEP = 8
# Word characters of a UTF-8 text as they are, A-Z in lower case, every other byte a space.
LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else c if c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased; none for null."""
    return text.encode("utf-8").translate(LETTERS).split() if text else []


@dataclass
class Items:
    """A block of the benchmark: distinct word sequences as numbers of ``vocabulary``, a 0 after each, and all their suffixes."""

    vocabulary: dict[bytes, int]
    ids: list[list[str]]      # item ids of each sequence, as text
    words: np.ndarray         # the sequences, a 0 after each and more at the end
    item: np.ndarray          # of each suffix: its sequence,
    start: np.ndarray         # its first word in ``words``
    left: np.ndarray          # and how many words it has
    size: np.ndarray          # of each sequence: its words
    windows: np.ndarray       # distinct windows: a suffix that begins with it,
    length: np.ndarray        # how many words it has,
    holders: list[list[int]]  # and the sequences that have it
    deepest: int              # words of the longest sequence


def read_items(rows: list[tuple], window: int) -> Items:
    """The block of (item_id, text) rows. Rows with the same words are one sequence; rows without words have no window."""
    by_words: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in rows:
        own = tuple(words(text))
        if own:
            by_words.setdefault(own, set()).add("null" if item_id is None else str(item_id))
    vocabulary: dict[bytes, int] = {}
    numbers = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in own] for own in by_words]
    size = np.array([len(n) for n in numbers], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int64)
    flat = np.zeros(int((size + 1).sum()) + max(STEP, window), np.int64)
    for at, own in zip(begin, numbers):
        flat[at:at + len(own)] = own
    item = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
    found: dict[bytes, int] = {}
    windows, length, holders = [], [], []
    for s in np.flatnonzero((inside + window <= size[item]) | (inside == 0)):
        n = min(window, int(size[item[s]]))
        at = int(begin[item[s]] + inside[s])
        key = flat[at:at + n].tobytes()
        if key not in found:
            found[key] = len(windows)
            windows.append(int(s))
            length.append(n)
            holders.append([])
        of = holders[found[key]]
        if not of or of[-1] != item[s]:
            of.append(int(item[s]))
    return Items(vocabulary, [sorted(i) for i in by_words.values()], flat, item, begin[item] + inside, size[item] - inside, size,
                 np.array(windows, np.int64), np.array(length, np.int64), holders, int(size.max(initial=0)))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the words other than 0, sorted by what follows up to a 0, at least ``depth`` words deep; ``text`` ends with a 0.

    Prefix doubling: a rank is the first place of the suffixes that are alike so far, and only those are sorted again.
    """
    at = np.flatnonzero(text)
    ends = np.flatnonzero(text == 0)
    order = at[np.argsort(text[at], kind="stable")]
    rank = np.zeros(len(text), np.int64)
    run = ends[np.searchsorted(ends, order)] - order
    first = text[order]
    slots, reach = np.arange(len(order)), 1
    while len(slots):
        fresh = np.concatenate([[True], first[1:] != first[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))] + 1
        tied = ~fresh | np.concatenate([~fresh[1:], [False]])
        # Suffixes that are alike and have ended stay alike.
        slots = slots[tied & (run[slots] >= reach)]
        if reach >= depth or not len(slots):
            break
        p = order[slots]
        after = np.where(run[slots] > reach, rank[np.minimum(p + reach, len(text) - 1)], 0)
        key = rank[p] * (len(text) + 1) + after
        by = np.argsort(key, kind="stable")
        order[slots], run[slots], first = p[by], run[slots][by], key[by]
        reach *= 2
    return order


def _common(text: np.ndarray, p: np.ndarray, items: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from ``p`` in ``text`` on are those from ``start`` in ``items`` on, ``most`` at most; by steps, all pairs at once."""
    out = np.zeros(len(p), np.int64)
    active, step = np.arange(len(p)), np.arange(STEP)
    while len(active):
        d = out[active]
        left = most[active] - d
        same = (text[(p[active] + d)[:, None] + step] == items[(start[active] + d)[:, None] + step]) & (step < left[:, None])
        n = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
        out[active] = d + n
        active = active[(n == STEP) & (left > STEP)]
    return out


def _bound(text: np.ndarray, array: np.ndarray, items: np.ndarray, start: np.ndarray, most: np.ndarray, above: bool) -> np.ndarray:
    """Binary search of patterns: the first suffix in ``array`` that is not smaller, or with ``above`` that is greater and doesn't begin with it."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        p, s, m = array[mid], start[open_], most[open_]
        n = _common(text, p, items, s, m)
        right = np.where(n < m, text[p + n] < items[s + n], above)
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


@dataclass
class Found:
    """What a shard holds of a block: longest match of every suffix and its place, and the occurrences (place, window) of windows."""

    longest: np.ndarray
    place: np.ndarray
    at: np.ndarray
    window: np.ndarray


def search_shard(text: np.ndarray, items: Items) -> Found:
    """Look up all suffixes of ``items`` in the suffix array of ``text``, which ends with STEP zeros."""
    array = suffix_array(text, items.deepest)
    none = np.zeros(0, np.int64)
    if not len(array):
        return Found(np.zeros(len(items.start), np.int64), np.zeros(len(items.start), np.int64), none, none)
    low = _bound(text, array, items.words, items.start, items.left, False)
    # The longest match is that of a neighbour of the place where the suffix would stand; ties go to the suffix after it.
    beside = [array[np.clip(low - k, 0, len(array) - 1)] for k in (0, 1)]
    after, before = (_common(text, p, items.words, items.start, items.left) for p in beside)
    longest = np.maximum(after, before)
    place = np.where(after >= before, *beside)
    met = np.flatnonzero(longest[items.windows] >= items.length)
    if not len(met):
        return Found(longest, place, none, none)
    start, most = items.start[items.windows[met]], items.length[met]
    lo = _bound(text, array, items.words, start, most, False)
    n = _bound(text, array, items.words, start, most, True) - lo
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return Found(longest, place, array[np.repeat(lo, n) + inside], np.repeat(met, n))


def _shards(texts: list[str | None], vocabulary: dict[bytes, int], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of its first text, words of each text, where each begins, all words as numbers) of shards of whole texts."""
    numbers: list[np.ndarray] = []
    first, held = 0, 0
    for i, t in enumerate(texts):
        own = words(t)
        numbers.append(np.fromiter((vocabulary.get(w, 0) for w in own), np.int64, len(own)))
        held += len(own) + 1
        if held >= most or i == len(texts) - 1:
            size = np.array([len(n) for n in numbers], np.int64)
            begin = np.cumsum(size + 1) - size - 1
            flat = np.zeros(int((size + 1).sum()) + STEP, np.int64)
            for at, n in zip(begin, numbers):
                flat[at:at + len(n)] = n
            yield first, size, begin, flat
            numbers, first, held = [], i + 1, 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _judge(texts: list[str | None], items: Items, most: int) -> list[tuple[int, list[dict], list[str]]]:
    """(words, hit spans, ids of the items met) of each text."""
    out: list[tuple[int, list[dict], list[str]]] = []
    for _, size, begin, flat in _shards(texts, items.vocabulary, most):
        found = search_shard(flat, items)
        spans: list[list[dict]] = [[] for _ in size]
        met: list[list[str]] = [[] for _ in size]
        if len(found.at):
            edge = np.bincount(found.at, minlength=len(flat)) - np.bincount(found.at + items.length[found.window], minlength=len(flat))
            a, z = _runs(edge.cumsum() > 0)
            of = np.searchsorted(begin, a, "right") - 1
            for i, x, y in zip(of.tolist(), (a - begin[of]).tolist(), (z - begin[of]).tolist()):
                spans[i].append({"from": x, "to": y})
            pairs = np.unique((np.searchsorted(begin, found.at, "right") - 1) * len(items.windows) + found.window)
            doc, window = np.divmod(pairs, len(items.windows))
            known: dict[bytes, list[str]] = {}  # copies meet the same windows
            for own in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
                key = window[own].tobytes()
                if key not in known:
                    known[key] = sorted({x for w in window[own].tolist() for s in items.holders[w] for x in items.ids[s]})
                met[int(doc[own[0]])] = known[key]
        out += zip(size.tolist(), spans, met)
    return out


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes``, rows with equal texts together."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = 1 + total // block_bytes
    cut = cut_lineage(rows.withColumn("_block", F.pmod(F.xxhash64("text"), F.lit(n))))
    for b in range(n):
        yield read_items([(r.item_id, r.text) for r in cut.where(F.col("_block") == b).collect()], window)  # one block


SPANS = ArrayType(StructType([StructField("from", LongType()), StructField("to", LongType())]))
FOUND = [StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))]


def _search_block(rows: DataFrame, items: Items, most: int) -> DataFrame:
    """``rows`` (row, text) with n_words, spans and items in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(items)  # a block

    def run(batches):
        for b in batches:
            judged = _judge(b.column("text").to_pylist(), shared.value, most)
            cols = list(zip(*judged)) if judged else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(cols[0], pa.int64()), pa.array(
                cols[1], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(cols[2], pa.list_(pa.string()))],
                ["row", "n_words", "spans", "items"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], *FOUND]))


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["from"], s["to"])):
        if out and s["from"] <= out[-1]["to"]:
            out[-1]["to"] = max(out[-1]["to"], s["to"])
        else:
            out.append(dict(s))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, shard_words: int = SHARD_WORDS,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: row (a struct of the columns in ``keep``), n_words, spans (runs of hit words, from inclusive to exclusive) and
    items (ids, as text, of the items met, sorted).

    A null or wordless text has no words and meets nothing, a null or wordless item has no window. Items of fewer words than ``window`` are
    met as a whole. Repeated rows are judged alike; an item id that occurs several times counts once, a missing id is the item ``null``.
    An empty table gives an empty result, an empty benchmark meets nothing. Columns may have any names.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark, window, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _search_block(rows, first, shard_words)
    # Further blocks: rows get numbers, what each block finds is put together by them.
    numbered = cut_lineage(rows.withColumn("n", F.monotonically_increasing_id()))
    alone = numbered.select(F.struct("n").alias("row"), "text")
    found = cut_lineage(_search_block(alone, first, shard_words))
    while second is not None:
        found = found.unionAll(cut_lineage(_search_block(alone, second, shard_words).where(F.size("items") > 0)))
        second = next(blocks, None)

    def run(batches):
        for b in batches:
            yield b.set_column(b.schema.get_field_index("spans"), "spans", pa.array(
                [_merged(s) for s in b.column("spans").to_pylist()], b.schema.field("spans").type))

    whole = found.groupBy("row.n").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                       F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = whole.mapInArrow(run, whole.schema)
    return numbered.select("row", "n").join(merged, "n").drop("n")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that meet no item; null and wordless texts stay."""
    return find_contamination(docs, benchmark, docs.columns, **how).where(F.size("items") == 0).select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per benchmark row with words that shares one with ``docs``: item_id, n_words of its longest verbatim match, item_start (first word in the item),
    doc_id and doc_start (where it is); of equally long matches the smallest (item_start, doc_id, doc_start)."""
    spark = docs.sparkSession
    given = docs.schema["doc_id"].dataType
    schema = StructType([StructField("item_id", StringType()), *(StructField(c, LongType()) for c in ("n_words", "item_start", "doc_start")), StructField("doc_id", given)])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = None
    for items in benchmark_blocks(benchmark, WINDOW, block_bytes):
        shared = spark.sparkContext.broadcast(items)  # a block

        def run(batches, shared=shared):
            own: Items = shared.value
            inside = np.concatenate([np.arange(n) for n in own.size]) if len(own.size) else np.zeros(0, np.int64)
            for b in batches:
                for first, _, begin, flat in _shards(b.column("text").to_pylist(), own.vocabulary, shard_words):
                    found = search_shard(flat, own)
                    # The first of the longest suffixes of each sequence.
                    order = np.lexsort((inside, -found.longest, own.item))
                    lead = order[np.concatenate([[True], own.item[order][1:] != own.item[order][:-1]])] if len(order) else order
                    lead = lead[found.longest[lead] > 0]
                    doc = np.searchsorted(begin, found.place[lead], "right") - 1
                    flat_rows = [(i, s, d) for s, d in zip(lead.tolist(), doc.tolist()) for i in own.ids[own.item[s]]]
                    at = [s for _, s, _ in flat_rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i for i, _, _ in flat_rows], pa.string()), pa.array(found.longest[at]), pa.array(inside[at]),
                        pa.array(found.place[at] - begin[[d for _, _, d in flat_rows]]),
                        b.column("doc_id").take(pa.array([first + d for _, _, d in flat_rows], pa.int64()))], schema.names)

        some = cut_lineage(rows.mapInArrow(run, schema))
        parts = some if parts is None else parts.unionAll(some)
    best = parts.groupBy("item_id").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "item_start", "doc_id", "doc_start")).alias("b"))
    return best.select("item_id", (-F.col("b.n")).alias("n_words"), "b.item_start", "b.doc_id", "b.doc_start")


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """What every document shares with the benchmark."""
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        "row.doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH b AS (SELECT DISTINCT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, w, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
p AS (SELECT item, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
q AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
  SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM p))),
m AS (SELECT DISTINCT r, q.k, s, item FROM q JOIN p ON q.k = p.k AND q.g = p.g),
h AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(s, s + k)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

QUERIES = {"op13_decontaminate": (op13_decontaminate, OP13_SQL)}

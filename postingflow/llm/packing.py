"""Best-fit packing with exact complements.

Documents become token ids, long ones are cut, and the pieces are packed into sequences of a fixed capacity. All that a packing needs
to know is how many pieces there are of each length, at most ``capacity`` numbers whatever the input. The plan made from them says
how often each combination of lengths is used; pieces are numbered within their length on the cluster and take their places from it.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm.common import running_total, shuffle_key, slice_bits, table, trimmed
from postingflow.llm.features import Texts, chunks
from postingflow.session import cut_lineage

CAPACITY = 2048
END_ID = 0
REMEMBERED = 600_000
LINE = 200
CHUNK_BYTES = 1 << 20  # a chunk's arrays take some sixty times its bytes
_WORD = re.compile(r" ?\S+")
# Kinds of bytes that a text may be cut between; 0: never.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[0x30:0x3A] = 2
KIND[[0x27, 0x7C]] = 0
PIECE_SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    """The public byte-level vocabulary of the box."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokens:
    """Token ids of whole texts from a ``tokenizers`` byte-level vocabulary, with the ids of seen word chunks remembered.

    A text may be cut before a single space between visible characters, and between an ASCII letter, digit or other sign and one of another
    of these kinds: the vocabulary's pattern always begins a token there, so the ids of the parts laid end to end are the ids of the text.
    Never beside ``'``, which may begin a shortened word, nor beside ``|``, so that ``<|endoftext|>`` stays whole. Equal parts are encoded
    once; the memory holds REMEMBERED parts, and when it is full those met least often leave it.
    """

    def __init__(self, path: str):
        # Spark already runs a worker per core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.line_break = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = [0]
        self.met = np.zeros(0, np.int32)

    def _make_room(self) -> None:
        """Keep the parts met more than once, at most half of what may be held."""
        often = np.flatnonzero(self.met > 1)
        if len(often) > REMEMBERED // 2:
            often = np.sort(often[np.argsort(-self.met[often], kind="stable")[:REMEMBERED // 2]])
        names, limits, flat, met = list(self.known), np.array(self.ends), self.flat, self.met
        self._forget()
        size = limits[often + 1] - limits[often]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(limits[often] - ends[:-1], size) + np.arange(ends[-1])]
        self.flat = np.concatenate([ids, np.zeros(1 << 16, np.uint32)])
        self.ends = ends.tolist()
        self.known = {names[i]: k for k, i in enumerate(often.tolist())}
        self.met = met[often] // 2

    def _encode(self, parts: list[str], line: int) -> tuple[np.ndarray, list[int]]:
        """Ids of all parts end to end, and how many each has; ``line`` parts are encoded at once, with a line break between two."""
        lines = ["\n".join(parts[i:i + line]) for i in range(0, len(parts), line)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        if line == 1:
            return np.concatenate(found), list(map(len, found))
        ids = np.concatenate(list(chain.from_iterable((f, self.line_break) for f in found)))
        breaks = np.flatnonzero(ids == self.line_break[0])
        return np.delete(ids, breaks), (np.diff(breaks, prepend=-1) - 1).tolist()

    def _learn(self, parts: list[bytes]) -> None:
        """Ids of parts not met before. Those without white space but for a space before them are encoded in lines of many: the line break
        between two of them is always a token of its own."""
        texts = [p.decode("utf-8") for p in parts]
        alone = [len(self.line_break) != 1 or not _WORD.fullmatch(x) for x in texts]
        for line, some in ((LINE, [i for i, a in enumerate(alone) if not a]), (1, [i for i, a in enumerate(alone) if a])):
            for at in range(0, len(some), 20_000):
                now = some[at:at + 20_000]
                ids, sizes = self._encode([texts[i] for i in now], line)
                while self.ends[-1] + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.flat[self.ends[-1]:self.ends[-1] + len(ids)] = ids
                self.known.update(zip([parts[i] for i in now], range(len(self.ends) - 1, len(self.ends) - 1 + len(now))))
                self.ends.extend((self.ends[-1] + np.cumsum(sizes)).tolist())

    def ids(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin (one more than texts)."""
        d = t.data
        seen = (d >= 0x21) & (d <= 0x7E)
        after = seen | (d == 0xC3)  # C3 begins a Latin letter
        before = seen.copy()
        before[1:] |= d[:-1] == 0xC3
        cut = np.zeros(len(d), bool)
        cut[1:-1] = (d[1:-1] == 0x20) & before[:-2] & after[2:]
        kind = KIND[d]
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        closing = t.starts[1:] - 1
        cut[closing] = False
        cut[t.starts[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(d))
        last = np.searchsorted(starts, t.starts[1:]) - 1
        ends[last] = closing
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(t) + 1, np.int64)
        lengths = ends - starts
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        inner = np.ones(len(d), bool)
        inner[closing] = False
        values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(d[inner])]).dictionary_encode()
        held = values.dictionary.buffers()
        raw, limits = held[2].to_pybytes(), np.frombuffer(held[1], np.int64)[:len(values.dictionary) + 1].tolist()
        parts = [raw[a:b] for a, b in zip(limits, limits[1:])]
        if len(self.known) + len(parts) > REMEMBERED:
            self._make_room()
        new = [p for p in parts if p not in self.known]
        self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        self.met = np.concatenate([self.met, np.zeros(len(self.known) - len(self.met), np.int32)])
        self.met[number] += 1
        number = number[np.asarray(values.indices)]
        limits = np.array(self.ends)
        first, size = limits[number], limits[number + 1] - limits[number]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, t.starts)]


_tokens: dict[str, WordTokens] = {}


def _shared_tokens(path: str) -> WordTokens:
    """One per Python worker."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids: whole ones, after a first that may be shorter."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document, and the ids themselves if asked for.

    A document's ids end with END_ID; a null or empty text has that id alone.
    """
    path = path or default_vocabulary()

    def run(batches):
        tokens = _shared_tokens(path)
        for b in batches:
            for first, t in chunks(b.column("text"), CHUNK_BYTES):
                ids, begin = tokens.ids(t)
                rows: dict[str, list] = {"at": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
                for i in range(len(t)):
                    own = np.append(ids[begin[i]:begin[i + 1]], np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for k, n in enumerate(cut_lengths(len(own), capacity)):
                        part = own[start:start + n]
                        for name, v in zip(rows, (first + i, k, start, n, zlib.crc32(part.tobytes()), part if with_ids else None)):
                            rows[name].append(v)
                        start += n
                out = [b.column("doc_id").take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()),
                       *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(rows["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = PIECE_SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


@dataclass
class Plan:
    """Runs of places: the pieces numbered from ``first`` to before ``last`` of a length go to sequences from ``sequence`` on, at ``offset``."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, last, sequence, offset


class _Stock:
    """Pieces left of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for n, k in counts.items():
            self.left[n] = k
        self.used = np.zeros(capacity + 1, np.int64)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair of available lengths with that sum whose longer one is longest."""
        low = np.arange(1, gap // 2 + 1)
        ok = np.flatnonzero((self.left[low] > 0) & (self.left[gap - low] > 0) & ((low * 2 != gap) | (self.left[low] > 1)))
        return (gap - int(low[ok[0]]), int(low[ok[0]])) if len(ok) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple of available lengths with that sum whose longest one is longest."""
        for a in np.flatnonzero(self.left[:max(0, gap - 1)])[::-1]:
            a = int(a)
            if 3 * a < gap:
                return None
            self.left[a] -= 1
            rest = self.pair(gap - a)
            self.left[a] += 1
            if rest and rest[0] <= a:
                return (a, *rest)
        return None


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """How often each combination is used, from the number of pieces of each length.

    From the longest length down, the gap that a piece leaves is filled exactly by one, two or three pieces as long as there are such;
    a combination is used as often as the scarcest of its lengths allows. What is left goes by best fit, longest first, where all
    equal bins are handled at once. The work depends on the number of lengths, not on that of pieces.
    """
    plan, stock = Plan(capacity), _Stock(counts, capacity)

    def use(lengths: tuple[int, ...], times: int) -> None:
        offset = 0
        for n in lengths:
            plan.runs.append((n, int(stock.used[n]), int(stock.used[n]) + times, plan.sequences, offset))
            stock.used[n] += times
            stock.left[n] -= times
            offset += n
        plan.sequences += times

    if stock.left[capacity]:
        use((capacity,), int(stock.left[capacity]))
    for n in range(capacity - 1, capacity // 4, -1):
        for search in (stock.single, stock.pair, stock.triple):
            while stock.left[n]:
                stock.left[n] -= 1
                rest = search(capacity - n)
                stock.left[n] += 1
                if rest is None or rest[0] > n:
                    break
                lengths = (n, *rest)
                use(lengths, int(min(stock.left[x] // lengths.count(x) for x in lengths)))

    # Best fit of the rest: groups of equal bins, as (gap, first sequence, how many).
    bins: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []

    def add(gap: int, at: int, many: int) -> None:
        if gap > 0 and many:
            if gap not in bins:
                bins[gap] = []
                bisect.insort(gaps, gap)
            bins[gap].append((at, many))

    for n in range(capacity, 0, -1):
        while stock.left[n]:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                per = capacity // n
                many = int(-(-stock.left[n] // per))
                at = plan.sequences
                plan.sequences += many
                full = int(stock.left[n] // per)
                for j in range(per):
                    times = full + (1 if j < stock.left[n] - full * per else 0)
                    if times:
                        plan.runs.append((n, int(stock.used[n]), int(stock.used[n]) + times, at, j * n))
                        stock.used[n] += times
                rest = int(stock.left[n] - full * per)
                add(capacity - per * n, at, full)
                add(capacity - rest * n, at + full, 1 if rest else 0)
                stock.left[n] = 0
                continue
            gap = gaps[k]
            at, many = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(k)
            times = int(min(many, stock.left[n]))
            plan.runs.append((n, int(stock.used[n]), int(stock.used[n]) + times, at, capacity - gap))
            stock.used[n] += times
            stock.left[n] -= times
            add(gap - n, at, times)
            add(gap, at + times, many - times)
    return plan


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces of one length are numbered in a shuffled order of slices, so a length that very many share is spread over tasks. The plan
    has a few runs per length whatever the input; it is broadcast.
    """
    spark = pieces.sparkSession
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    plan = make_plan({r.length: r.n for r in found}, capacity)
    bits = slice_bits(sum(r.n for r in found))
    keyed = pieces.withColumns({"_key": shuffle_key(F.col("doc_id"), F.col("piece")), "_one": F.lit(1)})
    numbered = running_total(keyed, ["length"], "_key", ["doc_id", "piece", "ids_crc32"], "_one", "_number", bits)
    runs = spark.createDataFrame(plan.runs, "_length long, _first long, _last long, _sequence long, _offset long")
    fits = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_last"))
    placed = numbered.join(F.broadcast(runs), fits)
    return placed.select(*pieces.columns, (F.col("_sequence") + F.col("_number") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every row of ``docs`` with its place: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Repeated rows are packed as often as they occur; null and empty texts give one piece of length 1; texts longer than the capacity
    are cut; an empty table gives an empty result. Only doc_id and text are read.
    """
    return place_pieces(cut_lineage(token_pieces(docs, path, capacity, with_ids)), capacity)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, folder, "documents"))


QUERIES = {"op6_packing": (op6_packing, None)}

"""Conversation structure repair by a shortest path over edits, decided by one big integer.

The rows of a conversation are edited (Keep, Rerole, Delete, Insert) until their roles read: an optional system turn, then user and
assistant in turn; or nothing. A path through (row, place in that pattern) is weighed by a single integer: its high digits are the cost, its
low digits the letters of the edits at fixed places, first letter first, with zeros after the last one. The smaller integer is the
cheaper path, and among equally cheap ones the one whose letters come first in ASCII. Prepending an edit adds its cost and shifts the
letters by one digit, so the minimum over what follows is all a node needs to know.

Rows are sorted by ranges, so a conversation of any length is spread over tasks. A conversation inside one range and of bounded length is
done there. The others are cut into segments; a segment becomes a table of weights, from every place to every place, and tables
are put together by the same minimum, some at a time, until one is left.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from postingflow.llm.common import small_batches, table
from postingflow.operators.scan import number_rows
from postingflow.session import cut_lineage

ROWS = 1024           # rows of a segment
BYTES = 4 << 20       # and about how much text
TABLES = 64           # tables that are put together at once
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
DIGIT = {DELETE: 1, INSERT: 2, KEEP: 3, REROLE: 4}  # in ASCII order; 0 is the padding
LETTER = {d: c for c, d in DIGIT.items()}
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
BITS = 3
START, SYSTEM, USER, ASSISTANT = range(4)  # the place: nothing yet, or the role of the last turn that stays
PLACES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the place after a turn with the only role that may follow; a system turn may also begin
NAME = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"
ENDS = tuple(".!?")


@dataclass
class Weights:
    """Paths over some rows: ``table[p][q]`` is the least weight of a path from place p to place q, None without one; ``digits`` letters wide."""

    digits: int
    table: list[list[int | None]]


def least_weights(rows: list[tuple[str, str]], digits: int, ends: list[int | None]) -> list[int | None]:
    """From each place before ``rows`` (initial, fault), the least weight of a path to a place in ``ends``, where that has a weight.

    At most two inserts follow each other on a cheapest path, as a third returns to a place left before; so three letters a row and two
    more are enough ``digits``.
    """
    top = BITS * digits
    low = (1 << top) - 1
    add = {c: (COST[c] << top) + (DIGIT[c] << top - BITS) for c in COST}
    truncated = TRUNCATED << top

    def then(edit: int, weight: int | None) -> int | None:
        """An edit before a path: its cost is added, the letters move one digit down."""
        return None if weight is None else weight - (weight & low) + ((weight & low) >> BITS) + edit

    def least(*options: int | None) -> int | None:
        return min((w for w in options if w is not None), default=None)

    def inserts(at: list[int | None]) -> list[int | None]:
        user, assistant = least(at[USER], then(add[INSERT], at[ASSISTANT])), least(at[ASSISTANT], then(add[INSERT], at[USER]))
        first = then(add[INSERT], user)
        return [least(at[START], first), least(at[SYSTEM], first), user, assistant]

    after = inserts(ends)
    for initial, fault in reversed(rows):
        here = []
        for place in PLACES:
            options = [then(add[DELETE], after[place])]
            if fault in ("", "truncated"):
                extra, to = truncated if fault else 0, NEXT[place]
                options.append(then(add[REROLE] + extra, after[to]))
                if initial == NAME[to][0]:
                    options.append(then(add[KEEP] + extra, after[to]))
                elif initial == "s" and place == START:
                    options.append(then(add[KEEP] + extra, after[SYSTEM]))
            here.append(least(*options))
        after = inserts(here)
    return after


def letters(weight: int, digits: int) -> str:
    """The edits in a weight."""
    out = []
    for at in range(BITS * (digits - 1), -1, -BITS):
        digit = weight >> at & (1 << BITS) - 1
        if not digit:
            break
        out.append(LETTER[digit])
    return "".join(out)


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    digits = 3 * len(rows) + 2
    weight = least_weights(rows, digits, [0, None, None, 0])[START]
    return weight >> BITS * digits, letters(weight, digits)


def segment_weights(rows: list[tuple[str, str]]) -> Weights:
    """Weights from every place to every place."""
    digits = 3 * len(rows) + 2
    columns = [least_weights(rows, digits, [0 if q == end else None for q in PLACES]) for end in PLACES]
    return trimmed(Weights(digits, [[columns[q][p] for q in PLACES] for p in PLACES]))


def trimmed(w: Weights) -> Weights:
    """The same without digits that are padding in every entry."""
    spare = min((_padding(v, w.digits) for row in w.table for v in row if v is not None), default=0)
    return Weights(w.digits - spare, [[None if v is None else v >> BITS * spare for v in row] for row in w.table])


def _padding(weight: int, digits: int) -> int:
    """Digits after the last letter."""
    low = weight & (1 << BITS * digits) - 1
    return ((low & -low).bit_length() - 1) // BITS if low else digits


def joined(a: Weights, b: Weights) -> Weights:
    """Paths over the rows of ``a``, then those of ``b``: the letters of the second follow those of the first at once."""
    digits = a.digits + b.digits
    low_a, low_b = (1 << BITS * a.digits) - 1, (1 << BITS * b.digits) - 1

    def both(x: int, y: int) -> int:
        cost = (x >> BITS * a.digits) + (y >> BITS * b.digits)
        return (cost << BITS * digits) + ((x & low_a) << BITS * b.digits) + ((y & low_b) << BITS * _padding(x, a.digits))

    return trimmed(Weights(digits, [[min((both(a.table[p][m], b.table[m][q]) for m in PLACES if a.table[p][m] is not None and b.table[m][q] is not None),
                                         default=None) for q in PLACES] for p in PLACES]))


def faults(rows: list[dict]) -> list[tuple[str, str]]:
    """(initial of the role, first fault or '') of rows with role, text and duplicate."""
    out = []
    for r in rows:
        text = r["text"].rstrip(SPACES)
        out.append((r["role"][:1], "blank" if not text else "duplicate" if r["duplicate"] else "" if text.endswith(ENDS) else "truncated"))
    return out


def messages(rows: list[dict], edits: str, place: int) -> Iterator[tuple[str, str]]:
    """(role, text) of what the edits leave, from ``place`` on."""
    source = iter(rows)
    for edit in edits:
        row = next(source) if edit != INSERT else None
        if edit == DELETE:
            continue
        place = SYSTEM if edit == KEEP and place == START and row["role"][:1] == "s" else NEXT[place]
        yield row["role"] if edit == KEEP else NAME[place], row["text"] if row else ""


@dataclass
class Summary:
    """What is counted over consecutive rows of a conversation, and what the rows beside them need to know."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str = ""
    last_role: str = ""

    def gaps(self) -> int:
        """Turns that are missing between the first and the last."""
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0

    def then(self, b: Summary) -> Summary:
        """Both, ``b`` after this."""
        if not self.rows or not b.rows:
            return self if self.rows else b
        border = self.last_role + b.first_role not in LEGAL
        same = self.turns and b.turns and self.last_turn == b.first_turn
        return Summary(
            self.rows + b.rows, self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated, self.illegal + b.illegal + border,
            self.turns + b.turns - bool(same), self.first_turn if self.turns else b.first_turn, b.last_turn if b.turns else self.last_turn,
            self.first_role, b.last_role)


LEGAL = ("su", "ua", "au")


def summary(rows: list[dict], found: list[tuple[str, str]]) -> Summary:
    """Of rows in order and their ``faults``."""
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    named = [f for _, f in found]
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(found, found[1:]))
    return Summary(len(rows), *(named.count(f) for f in ("blank", "duplicate", "truncated")), illegal, len(turns),
                   turns[0] if turns else None, turns[-1] if turns else None, found[0][0] if found else "", found[-1][0] if found else "")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of every row after the damage that crc32 of ``conv_id:turn`` modulo 20 does.

    0 drops the row (it stays marked, without role and text), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets role user.
    Nulls are read as one space in the key, role and text; conv_id and turn stay null.
    """
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the columns of ``damage``."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", "turn", *shown, F.lit(False).alias("dropped"))


REPORT = StructType([*(StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
LINES = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))


def _hashed(lines: Iterator[tuple[str, str]], state, begun: bool) -> bool:
    """Add turns to a hash; whether there is one before the next."""
    for role, text in lines:
        state.update(("\n" * begun + role + ":" + text).encode())
        begun = True
    return begun


def _report(total: Summary, cost: int, audit: str, sha: str) -> dict:
    return {"gaps": total.gaps(), "blank": total.blank, "duplicate": total.duplicate, "truncated": total.truncated, "illegal": total.illegal,
            "cost": cost, "audit": audit, "repaired_sha256": sha}


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn in ranges; a conversation of many rows lies in several."""
    # Rows of one turn go by role and text: by its first characters, then by its hash. Rows alike in all of them may be split anywhere.
    keyed = rows.withColumns({"_begin": F.left("text", F.lit(128)), "_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_begin", "_hash", "_tie"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns)


def _first_pass(rows: DataFrame, lines: bool, most_rows: int, most_bytes: int) -> DataFrame:
    """conv_id with report (and lines) of conversations that lie inside a range and are short; of the others seg, growing with the order,
    and rows, which are segments of bounded size."""
    conv, turn = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    segment = ArrayType(StructType([StructField("turn", turn), *LINES.elementType.fields, StructField("duplicate", rows.schema["dropped"].dataType)]))
    schema = StructType([StructField("conv_id", conv), StructField("seg", LongType()), StructField("report", REPORT), StructField("lines", LINES), StructField("rows", segment)])

    def run(batches):
        base, n_segments = TaskContext.get().partitionId() << 32, 0
        out: list[dict] = []
        held: list[dict] = []
        seen: set[tuple[str, str]] = set()
        now, size, whole, begun = None, 0, False, False

        def segment_of() -> dict:
            nonlocal n_segments
            n_segments += 1
            return {"conv_id": now, "seg": base + n_segments, "report": None, "lines": None, "rows": held}

        def finished() -> dict:
            found = faults(held)
            cost, audit = cheapest(found)
            state = hashlib.sha256()
            turns = list(messages(held, audit, START))
            _hashed(iter(turns), state, False)
            shown = [{"role": r, "text": t} for r, t in turns] if lines else None
            return {"conv_id": now, "seg": None, "report": _report(summary(held, found), cost, audit, state.hexdigest()), "lines": shown, "rows": None}

        for b in batches:
            for conv_id, turn_, role, text, dropped in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped"))):
                if not begun or conv_id != now:
                    if begun:
                        out.append(finished() if whole else segment_of())
                    # The first conversation of a range may have begun in the one before.
                    now, held, size, whole, begun = conv_id, [], 0, begun, True
                    seen.clear()
                if dropped:
                    continue
                if held and (len(held) >= most_rows or size >= most_bytes):
                    out.append(segment_of())
                    held, size, whole = [], 0, False
                    seen.clear()
                held.append({"turn": turn_, "role": role, "text": text, "duplicate": (role, text) in seen})
                seen.add((role, text))
                size += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if begun:  # the last one may go on in the next range
            yield pa.RecordBatch.from_pylist([segment_of()], arrow)

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def _marked(segments: DataFrame) -> DataFrame:
    """Segments with ``later``: the rows whose role and text an earlier segment of the conversation has."""
    rows = segments.select("conv_id", "seg", F.posexplode("rows").alias("at", "row")).where("NOT row.duplicate")
    own = rows.select(F.md5(F.to_json(F.struct("conv_id", "row.role", "row.text"))).alias("key"), "seg", "at")
    firsts = own.groupBy("key").agg(F.min("seg").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    later = own.join(firsts, "key").where("seg > first").groupBy("seg").agg(F.collect_list("at").alias("later"))  # rows of a segment at most
    return cut_lineage(segments.join(later, "seg", "left").select("conv_id", "seg", "rows", "later"))


def _segment_rows(rows: list[dict], later: list[int] | None) -> list[dict]:
    for i in later or ():
        rows[i]["duplicate"] = True
    return rows


def _tables(marked: DataFrame) -> DataFrame:
    """conv_id, seg and part: the segment's weights, summary and [(seg, rows)], pickled."""
    def run(batches):
        for b in batches:
            parts = []
            for seg, rows, later in zip(*(b.column(c).to_pylist() for c in ("seg", "rows", "later"))):
                found = faults(_segment_rows(rows, later))
                parts.append(pickle.dumps((segment_weights(found), summary(rows, found), [(seg, len(rows))])))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array(parts, pa.binary())], ["conv_id", "seg", "part"])

    return marked.mapInArrow(run, StructType([marked.schema["conv_id"], StructField("seg", LongType()), StructField("part", BinaryType())]))


def _together(parts: pd.DataFrame) -> pd.DataFrame:
    """Parts of a conversation that follow each other as one."""
    parts = parts.sort_values("n")
    weights, total, segments = pickle.loads(parts["part"].iloc[0])
    for raw in parts["part"].iloc[1:]:
        w, s, more = pickle.loads(raw)
        weights, total, segments = joined(weights, w), total.then(s), segments + more
    out = parts[["conv_id", "n", "part"]].iloc[:1].copy()
    out["n"] //= TABLES
    out["part"] = [pickle.dumps((weights, total, segments))]
    return out


def _decided(parts: DataFrame) -> DataFrame:
    """conv_id, report (still without a hash) and pieces: each segment's edits, the place before them and how many turns were sent by then."""
    piece = StructType([StructField("seg", LongType()), StructField("edits", StringType()), StructField("place", IntegerType()), StructField("sent", LongType())])
    schema = StructType([parts.schema["conv_id"], StructField("report", REPORT), StructField("pieces", ArrayType(piece))])

    def pieces(audit: str, segments: list[tuple[int, int]]) -> list[dict]:
        kept = len(audit) - audit.count(DELETE)
        out, at, sent = [], 0, 0
        for i, (seg, rows) in enumerate(segments):
            begin = at
            while rows or i == len(segments) - 1 and at < len(audit):
                rows -= audit[at] != INSERT
                at += 1
            # An odd number of turns begins with that of the system; from then on roles alternate.
            place = START if not sent else SYSTEM if kept % 2 and sent == 1 else USER if (sent - kept) % 2 else ASSISTANT
            out.append({"seg": seg, "edits": audit[begin:at], "place": place, "sent": sent})
            sent += at - begin - audit.count(DELETE, begin, at)
        return out

    def run(batches):
        for b in batches:
            out = []
            for conv_id, part in zip(b.column("conv_id").to_pylist(), b.column("part").to_pylist()):
                w, total, segments = pickle.loads(part)
                best = min(v for v in (w.table[START][START], w.table[START][ASSISTANT]) if v is not None)
                audit = letters(best, w.digits)
                out.append({"conv_id": conv_id, "report": _report(total, best >> BITS * w.digits, audit, ""), "pieces": pieces(audit, segments)})
            yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = to_arrow_schema(schema)
    return cut_lineage(parts.mapInArrow(run, schema))


def _sent(marked: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id, seg, sent (turns before) and lines (turns) of every segment."""
    cut = decided.select(F.explode("pieces").alias("p")).select("p.*")
    schema = StructType([marked.schema["conv_id"], StructField("seg", LongType()), StructField("sent", LongType()), StructField("lines", LINES)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for conv_id, seg, sent, rows, later, edits, place in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seg", "sent", "rows", "later", "edits", "place"))):
                turns = [{"role": r, "text": t} for r, t in messages(_segment_rows(rows, later), edits, place)]
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "seg": seg, "sent": sent, "lines": turns}], arrow)

    return cut_lineage(marked.join(cut, "seg").mapInArrow(run, schema))


def _hashes(sent: DataFrame) -> DataFrame:
    """conv_id and sha of its turns. A hash has no parallel form: a conversation's segments pass one task in order, a batch at a time."""
    def run(batches):
        now, state, begun, open_ = None, hashlib.sha256(), False, False
        for b in batches:
            done = []
            for conv_id, lines in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
                if open_ and conv_id != now:
                    done.append((now, state.hexdigest()))
                    state, begun = hashlib.sha256(), False
                now, open_ = conv_id, True
                begun = _hashed(((x["role"], x["text"]) for x in lines), state, begun)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.column("conv_id").type), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([now], arrow.field("conv_id").type), pa.array([state.hexdigest()])], ["conv_id", "sha"])

    schema = StructType([sent.schema["conv_id"], StructField("sha", StringType())])
    arrow = to_arrow_schema(schema)
    return sent.repartition("conv_id").sortWithinPartitions("conv_id", "seg").select("conv_id", "lines").mapInArrow(run, schema)


def repair(rows: DataFrame, lines: bool = False, most_rows: int = ROWS, most_bytes: int = BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(report, turns) of conversations, from the columns of ``damage`` or ``undamaged``.

    The report has a row per conv_id, also for one whose rows were all dropped: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. With ``lines``, turns has the repaired conversations: conv_id, at (from 0), role, text. Rows go by turn, nulls first;
    rows of one turn by role and text (its first 128 characters, then its hash). Rows without a conv_id are one conversation. A repeated
    row is a duplicate turn. An empty table gives empty results. Columns besides the four don't matter. ``most_rows`` and ``most_bytes``
    bound a segment; they change the work, not the result.
    """
    spark = rows.sparkSession
    with small_batches(spark):
        first = cut_lineage(_first_pass(_ordered(rows), lines, most_rows, most_bytes))
        marked = _marked(first.where("seg IS NOT NULL").select("conv_id", "seg", "rows"))
        parts = number_rows(_tables(marked), ["seg"], "n").select("conv_id", "n", "part")
        while True:
            parts = cut_lineage(parts.groupBy("conv_id", F.floor(F.col("n") / TABLES).alias("g")).applyInPandas(_together, parts.schema))
            if parts.groupBy("conv_id").count().where("count > 1").isEmpty():
                break
        decided = _decided(parts)
        sent = _sent(marked, decided)
        hashes = cut_lineage(_hashes(sent).select(F.col("conv_id").alias("of"), "sha"))
    late = decided.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", F.col("report").withField("repaired_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).alias("report"))
    report = first.where("report IS NOT NULL").select("conv_id", "report").unionAll(late).select("conv_id", "report.*")
    if not lines:
        return report, None
    early = first.where("lines IS NOT NULL").select("conv_id", F.lit(0).cast("long").alias("sent"), "lines")
    turns = early.unionAll(sent.select("conv_id", "sent", "lines")).select("conv_id", "sent", F.posexplode("lines").alias("i", "line"))
    return report, turns.select("conv_id", (F.col("sent") + F.col("i")).alias("at"), "line.role", "line.text")


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    return repair(damage(table(spark, folder, "conversations")))[0]


_SPACES = r"\x20\x09-\x0D"
OP11_SQL = rf"""
WITH RECURSIVE
bits AS (SELECT 0 AS k, n, n AS c FROM range(256) t(n) UNION ALL
  SELECT k + 1, n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY n) AS crc FROM bits WHERE k = 8),
src AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
    lambda c, x: xor(c // 256, crc[(xor(c, x) % 256) + 1])), 4294967295) % 20 AS x
  FROM conversations, crcs),
hurt AS (SELECT k, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role,
  CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE x WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE x <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
bad AS (SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^{_SPACES}]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][{_SPACES}]*$') THEN 'truncated' ELSE '' END AS f,
  lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS prev FROM num),
sums AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
  count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND prev || r NOT IN ('su', 'ua', 'au')) AS illegal FROM bad GROUP BY k),
-- Least (cost, edits) that reach each place after i rows: nothing yet, system, user, assistant. Equally cheap prefixes over the same rows never begin each other.
dp AS (
  SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS p0, NULL::STRUCT(c BIGINT, a VARCHAR) AS p1,
    {{'c': 5::BIGINT, 'a': 'I'}} AS p2, {{'c': 10::BIGINT, 'a': 'II'}} AS p3 FROM src
  UNION ALL
  SELECT k, i, p0, p1, u AS p2, CASE WHEN u IS NULL THEN a ELSE least(a, {{'c': u.c + 5, 'a': u.a || 'I'}}) END AS p3
  FROM (SELECT k, i, p0, p1, a, least(u, CASE WHEN p0 IS NOT NULL THEN {{'c': p0.c + 5, 'a': p0.a || 'I'}} END,
      CASE WHEN p1 IS NOT NULL THEN {{'c': p1.c + 5, 'a': p1.a || 'I'}} END, CASE WHEN a IS NOT NULL THEN {{'c': a.c + 5, 'a': a.a || 'I'}} END) AS u
    FROM (SELECT d.k, b.i,
        CASE WHEN p0 IS NOT NULL THEN {{'c': p0.c + 2, 'a': p0.a || 'D'}} END AS p0,
        least(CASE WHEN p1 IS NOT NULL THEN {{'c': p1.c + 2, 'a': p1.a || 'D'}} END, CASE WHEN p0 IS NOT NULL AND b.r = 's' AND keep THEN {{'c': p0.c + t, 'a': p0.a || 'K'}} END) AS p1,
        least(CASE WHEN p2 IS NOT NULL THEN {{'c': p2.c + 2, 'a': p2.a || 'D'}} END,
          CASE WHEN p0 IS NOT NULL AND keep THEN {{'c': p0.c + t + 1, 'a': p0.a || 'R'}} END, CASE WHEN p0 IS NOT NULL AND keep AND b.r = 'u' THEN {{'c': p0.c + t, 'a': p0.a || 'K'}} END,
          CASE WHEN p1 IS NOT NULL AND keep THEN {{'c': p1.c + t + 1, 'a': p1.a || 'R'}} END, CASE WHEN p1 IS NOT NULL AND keep AND b.r = 'u' THEN {{'c': p1.c + t, 'a': p1.a || 'K'}} END,
          CASE WHEN p3 IS NOT NULL AND keep THEN {{'c': p3.c + t + 1, 'a': p3.a || 'R'}} END, CASE WHEN p3 IS NOT NULL AND keep AND b.r = 'u' THEN {{'c': p3.c + t, 'a': p3.a || 'K'}} END) AS u,
        least(CASE WHEN p3 IS NOT NULL THEN {{'c': p3.c + 2, 'a': p3.a || 'D'}} END,
          CASE WHEN p2 IS NOT NULL AND keep THEN {{'c': p2.c + t + 1, 'a': p2.a || 'R'}} END, CASE WHEN p2 IS NOT NULL AND keep AND b.r = 'a' THEN {{'c': p2.c + t, 'a': p2.a || 'K'}} END) AS a
      FROM dp d JOIN (SELECT *, f NOT IN ('blank', 'duplicate') AS keep, CASE f WHEN 'truncated' THEN 5 ELSE 0 END AS t FROM bad) b ON b.k = d.k AND b.i = d.i + 1))),
best AS (SELECT k, least(p0, p3) AS w FROM dp QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
edits AS (SELECT k, unnest(range(1, length(w.a) + 1)) AS j, w.a AS a, (length(w.a) - length(replace(w.a, 'D', ''))) AS dead FROM best),
acts AS (SELECT k, j, a[j] AS e, j - (length(a[:j]) - length(replace(a[:j], 'I', ''))) AS i, j - (length(a[:j]) - length(replace(a[:j], 'D', ''))) AS o, (length(a) - dead) % 2 AS odd FROM edits),
said AS (SELECT acts.k, string_agg(CASE e WHEN 'K' THEN b.role ELSE CASE WHEN (o + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
  CASE e WHEN 'I' THEN '' ELSE b.text END, chr(10) ORDER BY j) AS s FROM acts LEFT JOIN bad b ON b.k = acts.k AND b.i = acts.i AND e <> 'I' WHERE e <> 'D' GROUP BY acts.k)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.w.c AS cost, best.w.a AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM src) c JOIN best USING (k) LEFT JOIN sums USING (k) LEFT JOIN said USING (k)
"""

QUERIES = {"op11_repair": (op11_repair, OP11_SQL)}

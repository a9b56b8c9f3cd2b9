"""Repairs against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from postingflow.llm import repair as m

SCHEMA = "conv_id long, turn long, role string, text string, seg string, rows string, report string, dropped string, kind string"
SPACE = " \t\n\x0b\x0c\r"


def _edits(row, place):
    """(letter, cost, next place) of a row (initial, fault); places are what was sent last: '', s, u, a."""
    initial, fault = row
    yield "D", 2, place
    if fault in ("blank", "duplicate"):
        return
    extra = 5 if fault == "truncated" else 0
    after = {"": "su", "s": "u", "u": "a", "a": "u"}[place]
    if initial and initial in after:
        yield "K", extra, initial
    for role in "ua":
        if role in after:
            yield "R", 1 + extra, role


def _inserts(place):
    return [r for r in "ua" if r in {"": "u", "s": "u", "u": "a", "a": "u"}[place]]


def _cheapest(rows):
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, place = heapq.heappop(heap)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(rows) and place in ("", "a"):
            return cost, audit
        for role in _inserts(place):
            heapq.heappush(heap, (cost + 5, audit + "I", i, role))
        if i < len(rows):
            for letter, c, to in _edits(rows[i], place):
                heapq.heappush(heap, (cost + c, audit + letter, i + 1, to))
    raise AssertionError


def _all_paths(rows):
    out, stack = [], [(0, "", 0, "")]
    while stack:
        cost, audit, i, place = stack.pop()
        if i == len(rows) and place in ("", "a"):
            out.append((cost, audit))
        if not audit.endswith("III"):
            stack += [(cost + 5, audit + "I", i, role) for role in _inserts(place)]
        if i < len(rows):
            stack += [(cost + c, audit + letter, i + 1, to) for letter, c, to in _edits(rows[i], place)]
    return min(out)


def _faults(rows):
    out = []
    for n, (_, role, text) in enumerate(rows):
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in [r[1:] for r in rows[:n]] else "truncated" if body[-1] not in ".!?" else "")
    return out


def _plain(conversations, hurt):
    ids = {r[0] for r in conversations}
    rows = []
    for conv, turn, role, text in conversations:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        rows += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = _faults(own)
        turns = {r[0] for r in own} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit = _cheapest([(r[1][:1], f) for r, f in zip(own, found)])
        lines, at = [], 0
        for letter in audit:
            row = own[at] if letter != "I" else None
            at += letter != "I"
            if letter != "D":
                lines.append([row[1] if letter == "K" else None, row[2] if row else ""])
        before = ""
        for line in lines:
            if line[0] is None:
                line[0] = {"": "user", "s": "user", "u": "assistant", "a": "user"}[before]
            before = line[0][0]
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def _made(seed, long):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "umpire", "User"]
    texts = ["Fine.", "Yes!", "No?", "cut", "", " \n", None, "Same.", "é.", "x" * 200 + ".", "a.b", "tail. \t"]

    def text():
        return rng.choice(texts) if rng.random() < 0.4 else f"Number {rng.randint(0, 400)}" + rng.choice([".", ".", ".", ""])

    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.03 else turn + rng.choice([0, 0, 0, 1]), ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles), text()))
    rows += [(None, rng.choice([None, i]), rng.choice(roles), text()) for i in range(12)]
    rows += [(1000, i * 2, ("user", "assistant")[i % 2] if rng.random() < 0.8 else rng.choice(roles), text()) for i in range(long)]
    rows += [(1001, 5, "user", "Same.")] * 40 + [(1002, i, "assistant", "") for i in range(20)]
    rng.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", "p", "d", "k") for r in rows], SCHEMA).repartition(3)


def _got(report):
    return sorted(map(tuple, report.collect()), key=repr)


def test_all_edits_of_short_conversations():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice("ssuuuaaat"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 4))]
        assert m.cheapest(rows) == _all_paths(rows) == _cheapest(rows)


def test_joined_segments_weigh_as_one():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice("ssuuuaaat"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 30))]
        cut = sorted(rng.choices(range(len(rows) + 1), k=rng.randint(1, 4)))
        parts = [m.segment_weights(rows[a:z]) for a, z in zip([0, *cut], [*cut, len(rows)])]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [m.joined(*parts[i:i + 2])]
        best = min(w for w in (parts[0].table[m.START][m.START], parts[0].table[m.START][m.ASSISTANT]) if w is not None)
        assert (best >> m.BITS * parts[0].digits, m.letters(best, parts[0].digits)) == _cheapest(rows) == m.cheapest(rows)


@pytest.mark.parametrize("most_rows,most_bytes,long", [(1024, 1 << 20, 300), (3, 1 << 20, 700), (1024, 30, 200)])
def test_whole_conversations(spark, most_rows, most_bytes, long):
    rows = _made(most_rows, long)
    report, turns = m.repair(m.damage(_frame(spark, rows)), True, most_rows, most_bytes)
    want = _plain(rows, True)
    assert report.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert _got(report) == want
    said = {}
    for r in sorted(turns.collect(), key=lambda r: r.at):
        assert r.at == len(said.setdefault(r.conv_id, []))
        said[r.conv_id].append(f"{r.role}:{r.text}")
    assert {r[0]: r[-1] for r in want} == {r[0]: hashlib.sha256("\n".join(said.get(r[0], [])).encode()).hexdigest() for r in want}


def test_undamaged_and_empty(spark):
    rows = _made(9, 20)
    assert _got(m.repair(m.undamaged(_frame(spark, rows)))[0]) == _plain(rows, False)
    report, turns = m.repair(m.damage(_frame(spark, [])), True)
    assert report.collect() == [] and turns.collect() == []

"""Token ids against the tokenizer on whole texts, plans against their own rules."""

import copy
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postingflow.llm import packing
from postingflow.llm.features import chunks
from tests.llm.helpers import empty_frame, odd_documents, odd_frame

TEXT = st.text(st.sampled_from("ab É'é s t  \n\t\r 12,.;!你\U0001f600́<|endoftext|>ß ÿ\x85"), max_size=60)
_tokens = packing.WordTokens(packing.default_vocabulary())


def _whole(text):
    return _tokens.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_ids_are_those_of_the_whole_text(texts):
    for _, t in chunks(pa.array(texts)):
        ids, begin = _tokens.ids(t)
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [_whole(x) for x in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 2'|sre.,(<>\u00a0é\n"), max_size=40), min_size=1, max_size=5))
def test_ids_where_letters_digits_and_signs_meet(texts):
    fresh = copy.copy(_tokens)
    fresh._forget()
    for _, t in chunks(pa.array(texts)):
        ids, begin = fresh.ids(t)
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [_whole(x) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "one", "É", " ", "  ", "\n", "<|", "|>", "'s", "\u00a0", "."]), max_size=12).map("".join), min_size=1, max_size=4))
def test_special_tokens_written_in_a_text(texts):
    fresh = Tokenizer.from_file(packing.default_vocabulary())
    want = [fresh.encode(x, add_special_tokens=False).ids for x in ["one <|endoftext|> two", *texts]]
    assert want[0] == [505, 220, 50256, 734]
    for _, t in chunks(pa.array(["one <|endoftext|> two", *texts])):
        ids, begin = _tokens.ids(t)
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == want


def test_memory_that_fills_up(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    tokens = packing.WordTokens(packing.default_vocabulary())
    for text in ("one two three four five six", "seven eight", "one nine ten eleven"):
        for _, t in chunks(pa.array([text])):
            assert tokens.ids(t)[0].tolist() == _whole(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(counts):
    plan = packing.make_plan(counts, 64)
    places, numbers = defaultdict(list), defaultdict(list)
    for length, first, last, sequence, offset in plan.runs:
        for k in range(last - first):
            places[sequence + k].append((offset, length))
            numbers[length].append(first + k)
    assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(k)) for n, k in counts.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    words = sum(n * k for n, k in counts.items())
    assert len(places) == plan.sequences <= 2 * words / 64 + 1


def test_exact_complements_fill_whole_sequences():
    rng = random.Random(0)
    counts = defaultdict(int)
    for _ in range(4000):
        counts[min(2048, int(rng.lognormvariate(6, 1)) + 1)] += 1
    plan = packing.make_plan(counts)
    assert plan.sequences <= -(-sum(n * k for n, k in counts.items()) // 2048) + 2


def test_documents(spark):
    rows = packing.pack_documents(odd_frame(spark), capacity=64, with_ids=True).collect()
    want = sorted((repr(d), *_whole(t or ""), 0) for d, t, *_ in odd_documents())
    pieces = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 64
        pieces[repr(r.doc_id)].append(r)
    got = []
    for doc, own in pieces.items():
        by_start = defaultdict(list)
        for r in own:
            by_start[r.start].append(r)
        if doc == "None":  # two rows without an id
            continue
        for k in range(len(by_start[0])):
            ids = [i for s in sorted(by_start) for i in by_start[s][k].ids]
            got.append((doc, *ids))
    assert sorted(got) == [w for w in want if w[0] != "None"]
    assert sum(r.length for r in pieces["None"]) == sum(len(w) - 1 for w in want if w[0] == "None")
    assert all(r.length == 64 for r in rows if r.piece > 0)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own[:i]) == at for own in map(sorted, seqs.values()) for i, (at, _) in enumerate(own))
    assert packing.pack_documents(empty_frame(spark)).collect() == []

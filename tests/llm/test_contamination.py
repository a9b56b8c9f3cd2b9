"""Suffix arrays and the decontamination query against plain search."""

import random

import numpy as np
import pytest

from postingflow.llm import contamination as c
from tests.llm.helpers import empty_frame, odd_documents, odd_frame

DOCS = "doc_id long, text string, row string, n string, spans string, items string, n_words string"
ITEMS = "item_id long, text string, _block string, w string"


def _words(text):
    out, word = [], ""
    for ch in text or "":
        if ch.isascii() and not ch.isalnum():
            out, word = out + [word] * bool(word), ""
        else:
            word += ch.lower() if ch.isascii() else ch
    return out + [word] * bool(word)


def _plain(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        own = _words(text)
        hit, met = set(), set()
        for item_id, item in items:
            w = _words(item)
            k = min(window, len(w))
            grams = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
            for i in range(len(own) - k + 1 if k else 0):
                if tuple(own[i:i + k]) in grams:
                    hit |= set(range(i, i + k))
                    met.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(own), sorted(hit), sorted(met)))
    return sorted(out, key=repr)


def _made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30, 60])))) for i in range(1, 25) if i != 7]
    items = [(i, t) for i, t in items if len(_words(t)) != 1] + [(90, "lonely"), (91, None), (92, ".,!"), (None, "no id here at all"), (93, "a a a a a a a a a a a a"),
                                                                     (3, items[5][1]), (4, items[5][1] + " more"), (94, items[8][1]), (94, items[8][1])]
    docs = [None, "", "...", "a " * 3000, "Lonely", "a lonely word", "W1-w2"]
    for _ in range(120):
        text = [rng.choice([*vocabulary, "other", "words", "b", "c2"]) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(own))
            at = rng.randint(0, len(text))
            text[at:at] = own[a:a + rng.randint(1, 40)]
        docs.append(rng.choice([" ", "\n", ", ", "_"]).join(text).replace("w1 ", "W1 "))
    docs += docs[-30:]
    rng.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)] + [(5, docs[5])] * 3 + [(None, docs[9])], items


def _rows(df):
    return sorted(((r.row.doc_id, r.n_words, sorted(x for s in r.spans for x in range(s["from"], s["to"])), list(r.items)) for r in df.collect()), key=repr)


def test_suffix_array_order():
    rng = np.random.default_rng(2)
    for n, kinds in ((0, 2), (1, 2), (300, 2), (300, 4), (300, 40)):
        text = np.concatenate([rng.integers(0, kinds, n), np.zeros(c.STEP, np.int64)])
        tail = [tuple(text[p:p + int((text[p:] == 0).argmax())]) for p in range(n)]
        for depth in (1, 3, 400):
            got = [tail[p][:depth] for p in c.suffix_array(text, depth)]
            assert got == sorted(t[:depth] for t in tail if t)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 20), (50, 1 << 20), (400, 300)])
def test_every_window_is_found(spark, shard, block):
    docs, items = _made(3)
    df = spark.createDataFrame([(*d, "r", "n", "s", "i", "w") for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, "b", "w") for i in items], ITEMS)
    want = _plain(docs, items)
    assert sum(bool(hit) for _, _, hit, _ in want) > 50
    assert _rows(c.find_contamination(df, bench, ["doc_id"], shard_words=shard, block_bytes=block)) == want
    kept = c.remove_contaminated(df, bench, shard_words=shard, block_bytes=block)
    assert kept.columns == df.columns
    clean = {repr((i, n)) for i, n, hit, _ in want if not hit}
    rows = kept.collect()
    assert sorted(repr((r.doc_id, len(_words(r.text)))) for r in rows) == sorted(repr((i, n)) for i, n, hit, _ in want if not hit)
    assert clean and all(r.row == "r" and r.spans == "s" for r in rows)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 20), (60, 300)])
def test_longest_matches(spark, shard, block):
    docs, items = _made(4)
    docs = [(i, " ".join(_words(t)[:80])) for i, (_, t) in enumerate(docs)]
    df = spark.createDataFrame([(*d, "r", "n", "s", "i", "w") for d in docs], DOCS).repartition(3)
    got = {r.item_id: (r.n_words, r.item_start, r.doc_id, r.doc_start) for r in c.longest_matches(
        df, spark.createDataFrame([(*i, "b", "w") for i in items], ITEMS), shard, block).collect()}
    words = [(i, _words(t)) for i, t in docs]
    longest = {}
    for item_id, text in items:
        own, key = _words(text), "null" if item_id is None else str(item_id)
        for s in range(len(own)):
            n = longest.get(key, 0)
            while s + n < len(own) and any(w[x:x + n + 1] == own[s:s + n + 1] for _, w in words for x in range(len(w) - n)):
                n += 1
            longest[key] = max(longest.get(key, 0), n)
    assert {k: v[0] for k, v in got.items()} == {k: n for k, n in longest.items() if n}
    texts, sources = dict(words), {}
    for item_id, text in items:
        sources.setdefault("null" if item_id is None else str(item_id), []).append(_words(text))
    for item, (n, s, doc, at) in got.items():
        assert any(own[s:s + n] == texts[doc][at:at + n] for own in sources[item])


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (2, "One"), (3, "no id at all"), (4, "你好 \U0001f600 word"), (None, "12 34")]
    bench = spark.createDataFrame([(*i, "b", "w") for i in items], ITEMS)
    want = _plain([(r[0], r[1]) for r in odd_documents()], items)
    assert _rows(c.find_contamination(odd_frame(spark), bench, ["doc_id"])) == want
    assert c.find_contamination(empty_frame(spark), bench, ["doc_id"]).collect() == []
    none = c.find_contamination(odd_frame(spark), spark.createDataFrame([], ITEMS), ["doc_id"]).collect()
    assert len(none) == len(odd_documents()) and not any(r.spans or r["items"] for r in none)
    assert c.longest_matches(odd_frame(spark), spark.createDataFrame([], ITEMS)).collect() == []

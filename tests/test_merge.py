import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import types as T

import sequential_model as model
from postingflow.operators import merge, resolve, scan
from postingflow.schema import STATE_COLUMNS, STATE_SCHEMA

NOW = datetime(2024, 5, 1)
RECORD_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(f"_given_{c}", T.BooleanType()) for c in model.ENUMS]
    + list(STATE_SCHEMA.fields)
)


def record(rng, case, seq, policy, stored=False):
    def some(values, none=0.3):
        return None if rng.random() < none else rng.choice(values)

    def key(kind, n, none=0.3):
        v = some(range(n), none)
        return None if v is None else f"c{case}-{kind}{v}"

    url = key("u", 4, 0.1)
    r = {f.name: None for f in STATE_SCHEMA.fields}
    r.update(
        seq=seq, id=f"{'s' if stored else 'i'}{case:04d}-{abs(seq):06d}", _seq=-1 if stored else seq,
        source_name=f"c{case}-{rng.choice('ab')}", source_type=rng.choice(["Gupy", "Workday"]),
        source_url=url or (f"c{case}-only{seq}" if policy == "bulk" else None), source_job_id=key("j", 3, 0.4),
        origin_url=key("o", 4, 0.6) if policy == "bulk" else None,
        title=rng.choice(["Dev", "QA"]), company_name=f"c{case}", location_text=rng.choice(["", "SP"]),
        company_website=some(["w1", "w2"], 0.6), company_industry=some(["x"], 0.7),
        work_mode=rng.choice(["Unknown", "Unknown", "Remote", "Hybrid"]), seniority=rng.choice(["Unknown", "Senior"]),
        employment_type=rng.choice(["Unknown", "CLT"]),
        description_text="d" * rng.choice([0, 10, 30, 45, 60, 90, 110, 140]), tags=rng.sample(["a", "b", "c", "d"], rng.randint(0, 2)),
        languages=["en"], posted_at=some([NOW - timedelta(days=d) for d in range(5)], 0.4),
        captured_at=NOW + timedelta(hours=(0 if stored else 1 + (case % 2) * (seq % 2) if policy == "crawl" else 1 + seq // 6)),
        last_seen_at=NOW + timedelta(hours=1 + max(seq, 0)), status="Expired" if stored else "Active",
        metadata={rng.choice("kl"): str(seq)} if rng.random() < 0.6 else {},
    )
    for c in model.ENUMS:
        r[f"_given_{c}"] = False if stored else r[c] != "Unknown" or rng.random() < 0.2
    if policy == "crawl" and rng.random() < 0.6:
        r.update(salary_min=Decimal("1.00"), salary_max=some([Decimal("2.00")]), salary_currency=some(["BRL"]), salary_period=some(["month"]))
    r["fingerprint"] = model.print_of(r)
    return r


def cases(seed, policy, n_cases, n_items):
    rng = random.Random(seed)
    state, items, seq = [], [], 0
    for case in range(n_cases):
        mine = []
        for k in range(rng.randint(0, 3)):
            r = record(rng, case, -(k + 1), policy, stored=True)
            if not model.clash(mine, None, r):
                mine.append(r)
        state += mine
        last = None
        for _ in range(rng.randint(1, n_items)):
            r = record(rng, case, seq, policy)
            if last and rng.random() < 0.3:
                r = {**last, "seq": seq, "_seq": seq, "id": r["id"]}
            last = r
            if policy == "bulk" or r["source_url"] or r["source_job_id"]:
                items.append(r)
                seq += 1
    return state, items


def run_spark(spark, state, items, policy):
    rows = spark.createDataFrame([tuple(r[f.name] for f in RECORD_SCHEMA.fields) for r in items], RECORD_SCHEMA)
    stored = spark.createDataFrame([tuple(r[c] for c in STATE_COLUMNS) for r in state], STATE_SCHEMA)
    postings, outcomes = merge.merge_records(rows, stored, policy)
    return merge.apply_to_state(stored, postings).collect(), outcomes.collect()


def check(spark, seed, policy, n_cases=150, n_items=9):
    state, items = cases(seed, policy, n_cases, n_items)
    got_state, got_out = run_spark(spark, state, items, policy)
    want = [dict(e) for e in state]
    expected = {}
    by_case = {}
    for r in items:
        by_case.setdefault(r["company_name"], []).append(r)
    final = []
    for name in {e["company_name"] for e in want} | set(by_case):
        mine = [e for e in want if e["company_name"] == name]
        expected |= model.run(mine, by_case.get(name, []), policy)
        final += mine
    assert {r.seq: (r.id, r.outcome, r.content_changed) for r in got_out} == expected
    got = {r.id: r.asDict() for r in got_state}
    assert set(got) == {e["id"] for e in final}
    for e in final:
        for c in STATE_COLUMNS:
            assert (got[e["id"]][c] or None) == (e[c] or None), (e["id"], c)
    assert {o for _, o, _ in expected.values()} >= {"Inserted", "Updated", "Duplicate", "Conflict"}


@pytest.mark.parametrize("policy", ["bulk", "crawl"])
def test_merge_equals_one_by_one(spark, policy):
    check(spark, 1, policy)


@pytest.mark.parametrize("policy", ["bulk", "crawl"])
def test_merge_with_split_groups(spark, policy, monkeypatch):
    """Tiny chunks and hot-key limits force the two-level and salted paths."""
    monkeypatch.setattr(scan, "CHUNK", 4)
    monkeypatch.setattr(scan, "HOT_ROWS", 3)
    monkeypatch.setattr(resolve, "PRUNE_ABOVE", 0)
    check(spark, 3, policy, n_cases=60)


def test_long_chain_settles(spark):
    """Every record shares a URL with the one before it and nothing else."""
    rng = random.Random(5)
    items = []
    for i in range(60):
        r = record(rng, 0, i, "crawl")
        r.update(source_job_id=f"j{i // 2}", source_url=f"u{(i + 1) // 2}", source_name="n", source_type="Gupy")
        items.append(r)
    state = [record(rng, 9, -1, "crawl", stored=True)]
    want = [dict(state[0])]
    expected = model.run(want, items, "crawl")
    _, out = run_spark(spark, state, items, "crawl")
    assert {r.seq: (r.id, r.outcome, r.content_changed) for r in out} == expected


@pytest.mark.parametrize("policy", ["bulk", "crawl"])
def test_small_components_need_no_rounds(spark, policy, monkeypatch):
    """Components of up to a chunk of records are resolved in one pass over their sorted records."""
    monkeypatch.setattr(resolve, "_by_rounds", None, raising=False)
    monkeypatch.setattr(resolve, "_round", None)
    check(spark, 7, policy, n_cases=60)


def test_components_reach_along_chains(spark):
    """Records are one component when keys lead from each to the next, and stay apart otherwise; a null key leads nowhere."""
    rows = [(i, f"n:{i}", f"u{i // 2}", f"j{(i + 1) // 2}" if i != 20 else None) for i in range(40)]
    rows = [(seq, ent, *[None if k is None else k.encode() for k in (u, j)]) for seq, ent, u, j in rows]
    df = spark.createDataFrame(rows, "seq long, ent string, u binary, j binary").selectExpr("*", "cast('s' as binary) AS src")
    found = {r.seq: r.component for r in resolve._connected(df, "crawl", 40).collect()}
    assert len({found[i] for i in range(20)}) == 1 and len({found[i] for i in range(20, 40)}) == 1
    assert found[0] != found[39]


def test_better_text(one):
    schema = "a string,b string"
    assert one(merge.better_text, schema, "x" * 10, "y" * 51) is True
    assert one(merge.better_text, schema, "x" * 10, "y" * 50) is False
    assert one(merge.better_text, schema, " ", "y") is True
    assert one(merge.better_text, schema, None, " ") is False


def test_merge_metadata(one):
    got = one(merge.merge_metadata, "a map<string,string>, b map<string,string>", {"k": "1", "z": "2"}, {"k": "3"})
    assert got == {"k": "3", "z": "2"}


def test_key_conflicts(spark):
    rows = [("1", "u", None, "T", "n", "j"), ("2", "u", "o", "T", "n", "j"), ("3", " ", "o2", "T", "m", "j")]
    df = spark.createDataFrame(rows, "id string, source_url string, origin_url string, source_type string, source_name string, source_job_id string")
    assert {(r.kind, r.n) for r in merge.key_conflicts(df).collect()} == {("source_url", 2), ("source_job_id", 2)}

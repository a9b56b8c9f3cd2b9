"""Which stored or new posting each incoming record belongs to, as if records arrived one by one.

A record sees the effects of all records before it: keys written by one decide where the next one
goes. Records that are connected over keys, however far, form a component, and components don't affect
each other. One of up to CHUNK rows is sorted into one task, which takes its records in their order.
Larger ones are resolved together in two stages of ordinary joins, aggregates and windows:

1. Records are grouped by shared keys. A group that shares no key with any other, has at most one
   stored row and is uniform (one fingerprint or one URL; for crawls one source id or one URL) can only
   ever fold into one posting, so its assignment is known without looking at the order.
2. The remaining records start from a guess and are re-evaluated together against the key history that
   the current assignment implies, until nothing changes. Record n depends only on earlier ones, so the
   arrival-order result is the only assignment that re-evaluation leaves alone; every round settles at
   least the next record of each chain and pointer jumps settle long chains in few rounds.

Histories are read with two-level prefix scans, so a key or posting that holds a third of all rows is
still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import null_if_blank
from postingflow.operators.dedupe import digest
from postingflow.operators import scan
from postingflow.operators.scan import prefix_scan, spread_join
from postingflow.operators.similar import follow_links
from postingflow.session import cut_lineage

KEYS = ["o", "src", "j", "u", "f"]
# Re-evaluation drops finished groups after this many rounds, when there are more records than this.
PRUNE_AFTER = 3
PRUNE_ABOVE = 1 << 17


def _narrow(df: DataFrame, policy: str) -> DataFrame:
    blank = F.lit(None).cast("binary")
    bulk = policy == "bulk"
    return df.select(
        "seq", "ent", "cap",
        (digest(null_if_blank(F.col("origin_url"))) if bulk else blank).alias("o"),
        digest(F.col("source_type"), F.col("source_name")).alias("src"),
        digest(null_if_blank(F.col("source_job_id"))).alias("j"),
        digest(null_if_blank(F.col("source_url"))).alias("u"),
        (digest(F.col("fingerprint")) if bulk else blank).alias("f"),
    )


def _triple() -> Column:
    return F.concat(F.col("src"), F.col("j"))


def _edges(records: DataFrame, policy: str, keep: list[str]) -> DataFrame:
    """(kind, key) rows of each record. Bulk links on the bare source id: a posting keeps its first id
    while its source changes, so two records may meet under a source neither of them names."""
    kinds = ["o", "j", "u", "f"] if policy == "bulk" else ["t", "u"]
    value = {"t": _triple(), **{k: F.col(k) for k in KEYS}}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), value[k].alias("key")) for k in kinds])
    return (
        records.select(*keep, F.explode(pairs).alias("_p"))
        .select(*keep, F.col("_p.kind").alias("kind"), F.col("_p.key").alias("key"))
        .filter(F.col("key").isNotNull())
    )


def _touched(items: DataFrame, state: DataFrame, policy: str) -> DataFrame:
    """Stored rows that can take part: they hold a key of some incoming record."""
    wanted = _edges(items, policy, []).distinct()
    ids = _edges(state, policy, ["ent"]).join(wanted, ["kind", "key"], "left_semi").select("ent").distinct()
    near = state.join(ids, "ent", "left_semi")
    if policy == "crawl":
        return near
    # A posting that changes source could run into another stored row with its old id.
    jobs = near.filter(F.col("j").isNotNull()).select("j").distinct()
    far = state.join(jobs, "j", "left_semi").join(ids, "ent", "left_anti")
    return near.unionByName(far.select(*near.columns))


def _group(records: DataFrame, policy: str, rows: int, hops: int = 2) -> DataFrame:
    """Label records by the smallest record reachable over shared keys in `hops` steps."""
    labelled = records.withColumn("label", F.struct("seq", "ent"))
    for _ in range(hops):
        edges = _edges(labelled, policy, ["ent", "label"])
        least = edges.groupBy("kind", "key").agg(F.min("label").alias("_least"))
        reached = spread_join(edges.drop("label"), least, ["kind", "key"], rows=rows * 4).groupBy("ent").agg(
            F.min("_least").alias("_reach"))
        labelled = cut_lineage(labelled.join(reached, "ent", "left").withColumn(
            "label", F.least("label", F.coalesce("_reach", "label"))).drop("_reach"))
    return labelled


def _simple(labelled: DataFrame, policy: str) -> DataFrame:
    """Labels of groups whose assignment does not depend on order."""
    pairs = _edges(labelled, policy, ["label"]).distinct()
    shared = pairs.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    mixed = pairs.join(shared, ["kind", "key"], "left_semi").select("label").distinct()
    rows = F.count(F.lit(1))

    def uniform(c: Column) -> Column:
        return (F.count(c) == rows) & (F.min(c) == F.max(c))

    same = uniform(F.col("f")) | uniform(F.col("u")) if policy == "bulk" else uniform(_triple()) | uniform(F.col("u"))
    groups = labelled.groupBy("label").agg(
        ((F.count(F.when(F.col("seq") < 0, 1)) <= 1) & ((rows == 1) | same)).alias("_one"))
    return groups.filter("_one").select("label").join(mixed, "label", "left_anti")


def _closed_groups(hard: DataFrame, policy: str) -> DataFrame:
    """seq and the group of incoming records that are connected over keys, however far."""
    named = hard.select("seq", *KEYS, F.col("label.ent").alias("node"))
    pairs = _edges(named, policy, ["node"]).distinct()
    heads = pairs.groupBy("kind", "key").agg(F.min("node").alias("head"))
    links = spread_join(pairs, heads, ["kind", "key"]).filter(F.col("node") != F.col("head")).select(
        F.col("node").alias("leader"), "head")
    reached = follow_links(links).select(F.col("leader").alias("node"), F.col("label").alias("closed"))
    items = named.filter(F.col("seq") >= 0).select("seq", "node")
    return cut_lineage(spread_join(items, reached, ["node"], "left").select("seq", F.coalesce("closed", "node").alias("closed")))


def _latest_holder(c: str) -> Column:
    """The posting of the last writer of a key, unless it has since written another value."""
    return F.when(F.col(f"{c}.nxt").isNull() | (F.col(f"{c}.nxt") >= F.col("seq")), F.col(f"{c}.ent"))


def _round(current: DataFrame, stored: DataFrame, policy: str, span: int, rows: int) -> DataFrame:
    """Re-evaluate every record against the key history of the current assignment."""
    bulk = policy == "bulk"
    cols = ["seq", "ent", "cap", *KEYS, "ok"]
    history = current.select(*cols).unionByName(stored.withColumn("ok", F.lit(True)).select(*cols))
    ok, seq = F.col("ok"), F.col("seq")
    writes = prefix_scan(history, ["ent"], "seq", {"nxt": ("min", F.when(ok, seq))}, reverse=True, span=span)
    if bulk:
        writes = prefix_scan(writes, ["ent"], "seq", {
            "had_o": ("max", ok & F.col("o").isNotNull()),
            "first_j": ("min", F.when(ok & F.col("j").isNotNull(), F.struct("seq", "j"))),
        }, span=span)
    else:
        writes = writes.withColumns({"had_o": F.lit(False), "first_j": F.lit(None).cast("struct<seq:bigint,j:binary>")})
    if span >= scan.CHUNK:
        writes = cut_lineage(writes)
    held_job = F.coalesce(F.col("first_j.j"), F.col("j")) if bulk else F.col("j")
    write = F.when(ok, F.struct("ent", "nxt"))

    def lane(df: DataFrame, key: Column, kind: str, value: Column, name: str, holder: Column) -> DataFrame:
        rows = df.withColumns({"_key": key, "_v": value}).filter(F.col("_key").isNotNull())
        found = prefix_scan(rows, ["_key"], "seq", {"_h": (kind, F.col("_v"))}, span=span)
        return found.filter(seq >= 0).select("seq", F.lit(name).alias("lane"), holder.alias("holder"))

    lanes = [lane(writes, F.col("u"), "last", write, "u", _latest_holder("_h"))]
    # Source ids: a record asks for its own (source, id) and its posting then holds (source, first id).
    asks = writes.filter(seq >= 0).withColumns({"_key": _triple(), "_v": F.lit(None).cast("struct<ent:string,nxt:bigint>"), "_at": seq * 2})
    puts = writes.withColumns({"_key": F.concat(F.col("src"), held_job), "_v": write, "_at": seq * 2 + 1})
    both = asks.unionByName(puts).filter(F.col("_key").isNotNull())
    found = prefix_scan(both.select("seq", "_key", "_v", "_at"), ["_key"], "_at", {"_h": ("last", F.col("_v"))}, span=2 * span + 1).filter(seq >= 0)
    lanes.append(found.select("seq", F.when(F.col("_at") % 2 == 0, "t").otherwise("own").alias("lane"), _latest_holder("_h").alias("holder")))
    if bulk:
        sets_o = ok & F.col("o").isNotNull() & ~F.coalesce("had_o", F.lit(False))
        lanes.append(lane(writes, F.col("o"), "min", F.when(sets_o, F.struct("seq", "ent")), "o", F.col("_h.ent")))
        born = (seq < 0) | (ok & (F.col("ent") == F.concat(F.lit("n:"), seq)))
        lanes.append(lane(writes, F.col("f"), "min", F.when(born, F.struct("seq", "cap", "ent")), "f", F.col("_h.ent")))

    hits = lanes[0]
    for more in lanes[1:]:
        hits = hits.unionByName(more)
    names = ["o", "t", "u", "f", "own"]
    wide = hits.groupBy("seq").agg(*[F.max(F.when(F.col("lane") == n, F.col("holder"))).alias(f"h_{n}") for n in names])
    judged = current.join(wide, "seq", "left").withColumn("_m", F.coalesce("h_o", "h_t", "h_u", "h_f"))
    clash = (F.col("h_u").isNotNull() & (F.col("h_u") != F.col("_m")))
    if bulk:
        clash = clash | (F.col("h_own").isNotNull() & (F.col("h_own") != F.col("_m")))
    judged = judged.withColumn("_ok", F.col("_m").isNull() | ~clash).withColumn(
        "_x", F.when(F.col("_m").startswith("n:"), F.substring(F.col("_m"), 3, 20).cast("long")))
    # One pointer jump: a match on a record that itself joined another posting moves on to that posting.
    seen = current.select(F.col("seq").alias("_x"), F.col("ent").alias("_to"))
    jumped = spread_join(judged, seen, ["_x"], "left", rows=rows)
    ent = F.coalesce("_to", "_m", F.concat(F.lit("n:"), seq))
    return jumped.select(
        "seq", ent.alias("ent"), "cap", *KEYS, F.col("_ok").alias("ok"),
        ((ent != F.col("ent")) | (F.col("_ok") != F.col("ok"))).alias("moved"))


def _connected(records: DataFrame, policy: str, rows: int) -> DataFrame:
    """Add `component`: equal for records that are connected over keys, however far.

    Records of one fingerprint (crawls: one URL) are one node from the start. Every round each node joins the least node it shares a key
    with, and a node's keys go to the one it joined. Nodes and keys are hashes, so that chains are cut at random places and few rounds
    are needed. Equal hashes of unequal keys can only put two components together.
    """
    lead, others = ("f", {k: F.col(k) for k in "ouj"}) if policy == "bulk" else ("u", {"t": _triple()})
    hashed = {k: F.when(c.isNotNull(), F.xxhash64(F.lit(k), c)) for k, c in {lead: F.col(lead), **others}.items()}
    noded = records.withColumn("node", F.coalesce(hashed[lead], F.xxhash64(F.lit("ent"), "ent")))
    edges = noded.select("node", F.explode(F.array_compact(F.array(*[hashed[k] for k in others]))).alias("key")).distinct()
    rounds = []
    while True:
        heads = edges.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        shared = cut_lineage(edges.join(heads.drop("_n"), "key"))
        joined = cut_lineage(shared.groupBy("node").agg(F.min("head").alias("to")).filter(F.col("to") < F.col("node")))
        if joined.isEmpty():
            break
        rounds.append(joined)
        edges = shared.join(joined, "node", "left").select(F.coalesce("to", "node").alias("node"), "key").distinct()
    if not rounds:
        return noded.withColumnRenamed("node", "component")
    ends = rounds.pop().withColumnRenamed("to", "component")
    for joined in reversed(rounds):
        later = ends.withColumnRenamed("node", "to")
        ends = joined.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component")).unionByName(
            ends.join(joined, "node", "left_anti"))
    found = spread_join(noded, ends, ["node"], "left", rows=rows)
    return found.select(*records.columns, F.coalesce("component", "node").alias("component"))


def _in_order(batches: Iterator[pd.DataFrame], bulk: bool) -> Iterator[pd.DataFrame]:
    """seq, ent and ok of each incoming record; rows come by component, stored ones first, then by seq.

    Held are the keys of one component: who holds each now, and what each posting holds.
    """
    component, by, postings = None, {}, {}
    for batch in batches:
        out = []
        columns = [batch[c].tolist() for c in ("component", "seq", "ent", *KEYS)]
        for comp, seq, ent, o, src, j, u, f in zip(*columns):
            if comp != component:
                component, postings = comp, {}
                by = {kind: {} for kind in "otuf"}
            asked = src + j if src is not None and j is not None else None
            new = seq < 0
            if not new:
                tests = ((o, "o"), (asked, "t"), (u, "u"), (f, "f"))
                match = next((by[kind][key] for key, kind in tests if key is not None and key in by[kind]), None)
                new = match is None
                ent = ent if new else match
            if new:
                held = postings[ent] = [o, asked, u, j]
                if f is not None:
                    by["f"].setdefault(f, ent)
            else:
                held = postings[ent]
                job = j if not bulk or held[3] is None else held[3]
                own = src + job if src is not None and job is not None else None
                if by["u"].get(u, ent) != ent or by["t"].get(own, ent) != ent:
                    out.append((seq, ent, False))
                    continue
                for kind, old, now in (("t", held[1], own), ("u", held[2], u)):
                    if old != now and by[kind].get(old) == ent:
                        del by[kind][old]
                held[:] = [o if held[0] is None else held[0], own, u, job]
            for kind, key in zip("otu", held):
                if key is not None:
                    by[kind].setdefault(key, ent)
            if seq >= 0:
                out.append((seq, ent, True))
        yield pd.DataFrame(out, columns=["seq", "ent", "ok"])


def resolve_entities(incoming: DataFrame, state: DataFrame, policy: str) -> DataFrame:
    """Assign incoming records to postings in `seq` order.

    `incoming` has a unique non-negative integer `seq` and the key columns; `state` is the state table.
    Returns seq, ent ('s:<stored id>' or 'n:<seq of the inserting record>') and ok (false when the write
    would give two postings the same unique key; such a record has no effect).
    """
    items = _narrow(incoming.withColumns({
        "ent": F.concat(F.lit("n:"), F.col("seq")), "cap": F.lit(None).cast("timestamp")}), policy)
    kept = _narrow(state.withColumns({
        "seq": F.lit(-1).cast("long"), "ent": F.concat(F.lit("s:"), F.col("id")), "cap": F.col("captured_at")}), policy)
    records = cut_lineage(items if state.isEmpty() else items.unionByName(_touched(items, kept, policy)))
    given = F.when(F.coalesce("seq", F.lit(0)) >= 0, F.col("seq"))
    size = records.agg(
        F.count(F.lit(1)).alias("rows"), F.max("seq").alias("span"), F.count(F.when(F.col("seq") < 0, 1)).alias("stored"),
        F.count_distinct(given).alias("given")).first()
    if size.given + size.stored < size.rows:  # without an order of their own records can't be taken one by one
        return _by_rounds(records, policy, size.rows, size.span)
    connected = _connected(records, policy, size.rows)
    large = None
    if size.rows > scan.CHUNK:
        connected = cut_lineage(connected)
        large = cut_lineage(connected.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(
            F.col("_n") > scan.CHUNK).select("component"))  # at most rows/CHUNK
        large = None if large.isEmpty() else F.broadcast(large)
    small = connected if large is None else connected.join(large, "component", "left_anti")
    ordered = small.repartition("component").sortWithinPartitions("component", "seq", "cap", "ent")
    bulk = policy == "bulk"
    settled = ordered.select("component", "seq", "ent", *KEYS).mapInPandas(
        lambda batches: _in_order(batches, bulk), "seq long, ent string, ok boolean")
    if large is None:
        return settled
    rest = cut_lineage(connected.join(large, "component", "left_semi").select(*records.columns))
    return settled.unionByName(_by_rounds(rest, policy, rest.count(), size.span))


def _by_rounds(records: DataFrame, policy: str, rows: int, span: int) -> DataFrame:
    """seq, ent and ok of the incoming ones of `records`, by groups and rounds; for groups of any size."""
    grouped = _group(records, policy, rows)
    simple = _simple(grouped, policy).withColumn("_simple", F.lit(True))
    flagged = cut_lineage(spread_join(grouped, simple, ["label"], "left", rows=rows))
    easy = flagged.filter(F.col("_simple") & (F.col("seq") >= 0)).select(
        "seq", F.col("label.ent").alias("ent"), F.lit(True).alias("ok"))
    hard = flagged.filter(F.col("_simple").isNull())
    if hard.isEmpty():
        return easy
    hard_state = hard.filter(F.col("seq") < 0).select("seq", "ent", "cap", *KEYS)
    current = hard.filter(F.col("seq") >= 0).select(
        "seq", F.col("label.ent").alias("ent"), "cap", *KEYS, F.lit(True).alias("ok"))
    settled, rounds, members = easy, 0, None
    while True:
        current = cut_lineage(_round(current, hard_state, policy, span, rows))
        moved = current.filter("moved")
        if moved.isEmpty():
            return settled.unionByName(current.select("seq", "ent", "ok"))
        rounds += 1
        if rounds >= PRUNE_AFTER and rows > PRUNE_ABOVE:
            # Groups in which nothing moved are done; only the others go round again.
            members = _closed_groups(hard, policy) if members is None else members
            open_groups = members.join(moved.select("seq"), "seq", "left_semi").select("closed").distinct()
            again = members.join(open_groups, "closed", "left_semi")
            settled = settled.unionByName(current.join(again, "seq", "left_anti").select("seq", "ent", "ok"))
            current = current.join(again.select("seq"), "seq", "left_semi")
        current = current.drop("moved")

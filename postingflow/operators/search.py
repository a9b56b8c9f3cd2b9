"""Search over the search documents: filters, text match, sort, pages, facets and saved searches in bulk."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postingflow.functions.infer import parse_enum
from postingflow.functions.text import normalize_text, null_if_blank, parse_date, parse_tag_csv
from postingflow.operators.scan import first_n, number_rows, spread_join
from postingflow.schema import ENUMS
from postingflow.session import broadcasts_measured, cut_lineage, stored

TEXT_FIELDS = ["title", "company", "tags", "locationText", "workMode", "seniority", "employmentType", "sourceName"]
ENUM_FIELDS = {"workMode": "WorkMode", "seniority": "Seniority", "employmentType": "EmploymentType"}
PLAIN_FIELDS = {"company": "company", "location": "locationText", "sourceName": "sourceName"}
FACETS = ["workMode", "seniority", "employmentType", "company", "locationText", "sourceName"]


def active_only(docs: DataFrame) -> DataFrame:
    """Active documents; a missing status passes."""
    return docs.filter(F.col("status").isNull() | (F.lower("status") == "active"))


def _enum_value(text: str | None, enum: str) -> str | None:
    """Enum name of a parameter; None when it is blank, unknown or 'Unknown'."""
    key = (text or "").strip().lower()
    names = {n.lower(): n for n in ENUMS[enum]} | {str(c): n for n, c in ENUMS[enum].items()}
    found = names.get(key)
    return None if found == "Unknown" else found


def filter_docs(
    docs: DataFrame, work_mode: str | None = None, seniority: str | None = None, employment_type: str | None = None,
    tags: str | None = None, company: str | None = None, location: str | None = None, source_name: str | None = None,
    posted_from: datetime | date | None = None,
) -> DataFrame:
    """Active documents that meet every given filter; blank and unknown values are ignored."""
    out = active_only(docs)
    for value, (field, enum) in zip((work_mode, seniority, employment_type), ENUM_FIELDS.items()):
        name = _enum_value(value, enum)
        if name:
            out = out.filter(F.col(field) == name)
    wanted = list(dict.fromkeys(t.strip().lower() for t in (tags or "").split(",") if t.strip()))
    if wanted:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])))
    for value, field in ((company, "company"), (location, "locationText"), (source_name, "sourceName")):
        if value and value.strip():
            out = out.filter(F.lower(field) == value.lower())
    if posted_from is not None:
        floor = posted_from.date() if isinstance(posted_from, datetime) else posted_from
        out = out.filter(F.col("postedAt") >= F.lit(datetime(floor.year, floor.month, floor.day)).cast("timestamp"))
    return out


def _tokens(field: str) -> Column:
    text = F.array_join("tags", " ") if field == "tags" else F.col(field)
    return _words(text)


def _words(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), r"\s+"), lambda t: t != "")


def _query_tokens(docs: DataFrame, q: str | None) -> list[str]:
    """The words of one query string, folded by the expression that folds documents; a local row, so no job runs."""
    if not (q or "").strip():
        return []
    return list(docs.sparkSession.createDataFrame([(q,)], "q string").select(_words(F.col("q")).alias("w")).first().w)


PREFIX = 10  # letters of a term that its deletions are taken from
LEAST = 4    # letters of the shortest term that a misspelt word can mean


def _slack(letters: int) -> int:
    """Edits that a query word may be off."""
    return 2 if letters >= 9 else 1 if letters >= 5 else 0


def _shorter(words: Column) -> Column:
    """All words with one letter left out."""
    return F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.lit(PREFIX))))))


def deletions(word: Column, most: Column) -> Column:
    """The first PREFIX letters of a word, and what is left of them without one or, if ``most`` is 2, two letters.

    Two words at most ``most`` edits apart have one of these in common: along a cheapest alignment, the letters of either beginning that the
    other's doesn't have are at most as many as the edits.
    """
    begin = F.array(F.left(word, F.lit(PREFIX)))
    once = F.when(most >= 1, F.filter(_shorter(begin), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    twice = F.when(most >= 2, F.filter(_shorter(F.array_distinct(once)), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(begin, once, twice))


@dataclass(frozen=True)
class TermIndex:
    """postings: term, id, weight (of the best field that has the term); terms: the distinct ones; near: deletion, term."""

    postings: DataFrame
    terms: DataFrame
    near: DataFrame


def _weights() -> list[float]:
    return [float(len(TEXT_FIELDS) - i) for i in range(len(TEXT_FIELDS))]


def build_index(docs: DataFrame) -> TermIndex:
    """The term index of search documents: every distinct term is filed once, under its deletions, however many documents have it."""
    def weighed(field: str, weight: float) -> Column:
        terms = F.transform(_tokens(field), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))
        return F.coalesce(terms, F.array().cast("array<struct<term:string,weight:double>>"))

    some = [weighed(f, w) for f, w in zip(TEXT_FIELDS, _weights())]
    rows = docs.select("id", F.explode(F.concat(*some)).alias("t")).groupBy(F.col("t.term").alias("term"), "id").agg(F.max("t.weight").alias("weight"))
    postings = cut_lineage(rows)
    terms = cut_lineage(postings.select("term").distinct())
    depth = F.when(F.length("term") >= 9 - 2, 2).otherwise(1)
    near = terms.where(F.length("term") >= LEAST).select(F.explode(deletions(F.col("term"), depth)).alias("deletion"), "term")
    return TermIndex(postings, terms, near)


def write_index(index: TermIndex, path: str) -> None:
    """The index as tables, ordered by what they are asked by."""
    index.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    index.near.repartitionByRange("deletion", "term").sortWithinPartitions("deletion", "term").write.parquet(f"{path}/near")


def read_index(spark: SparkSession, path: str) -> TermIndex:
    """A stored index."""
    return TermIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "near")))


def _meant(index: TermIndex, n: int, word: str, last: bool) -> DataFrame:
    """n, term and cost of the terms that a query word can mean: itself, what it begins if it is the last, and terms a few edits away."""
    itself = index.terms.where(F.col("term").startswith(word) if last else F.col("term") == word)
    out = itself.select(F.lit(n).alias("n"), "term", F.lit(0.0).alias("cost"))
    slack = _slack(len(word))
    if not slack:
        return out
    asked = index.terms.sparkSession.createDataFrame([(word,)], "word string").select(
        F.array_sort(deletions(F.col("word"), F.lit(slack))).alias("d")).first().d  # 56 at most
    close = index.near.where(F.col("deletion").isin(asked)).select("term").distinct().where(F.levenshtein("term", F.lit(word), slack) >= 0)
    return out.unionByName(close.select(F.lit(n).alias("n"), "term", F.lit(0.5).alias("cost")))


def match_index(docs: DataFrame, index: TermIndex, q: str | None) -> DataFrame:
    """Documents in which every query word or a near one occurs, with ``score``, by the term index: only the lists of terms that a word
    can mean are read, and the other documents are never looked at. ``docs`` are those the index was built of, or some of them."""
    words = _query_tokens(docs, q)
    if not words:
        return docs.withColumn("score", F.lit(0.0))
    meant = [_meant(index, n, word, n == len(words) - 1) for n, word in enumerate(words)]
    terms = reduce(lambda a, b: a.unionByName(b), meant).groupBy("n", "term").agg(F.min("cost").alias("cost"))
    found = index.postings.join(terms, "term").groupBy("id", "n").agg(F.max(F.col("weight") - F.col("cost")).alias("best"))
    hits = found.groupBy("id").agg(F.count(F.lit(1)).alias("met"), F.sum("best").alias("score")).where(F.col("met") == len(words))
    return docs.join(hits.select("id", "score"), "id").select(*docs.columns, "score")


def match_text(docs: DataFrame, q: str | None, typos: bool = False) -> DataFrame:
    """Keep documents in which every query word occurs (the last one as a prefix) and add `score`.

    A word scores by the best field it occurs in, title first. With `typos`, words of five letters may
    differ by one edit and words of nine by two, at a cost; `build_index` and `match_index` do the same for
    several searches over one index. This approximates a search engine's relevance.
    """
    if typos:
        return match_index(docs, build_index(docs), q)
    words = _query_tokens(docs, q)
    if not words:
        return docs.withColumn("score", F.lit(0.0))
    fields = [(f"_t{i}", weight) for i, weight in enumerate(_weights())]
    out = docs.withColumns({f"_t{i}": _tokens(f) for i, f in enumerate(TEXT_FIELDS)})
    hits = []
    for n, word in enumerate(words):
        last = n == len(words) - 1

        def found(column: str, word=word, last=last) -> Column:
            return F.exists(column, lambda t: t.startswith(word)) if last else F.array_contains(column, word)

        hits.append(F.greatest(F.lit(0.0), *[F.when(found(column), F.lit(weight)) for column, weight in fields]))
    out = out.withColumns({f"_h{n}": h for n, h in enumerate(hits)})
    out = out.filter(reduce(lambda a, b: a & b, [F.col(f"_h{n}") > 0 for n in range(len(hits))]))
    return out.withColumn("score", reduce(lambda a, b: a + b, [F.col(f"_h{n}") for n in range(len(hits))])).select(
        *docs.columns, "score")


def _sort_fields(sort: str | None) -> list[tuple[str, bool]]:
    """Sort columns of a sort parameter and whether they ascend; id breaks ties."""
    table = {
        "postedat:asc": [("postedAt", True), ("capturedAt", False)],
        "capturedat:asc": [("capturedAt", True)],
        "capturedat:desc": [("capturedAt", False)],
    }
    return [*table.get((sort or "").strip().lower(), [("postedAt", False), ("capturedAt", False)]), ("id", True)]


def _ordered(fields: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in fields]


def sort_order(sort: str | None) -> list[Column]:
    """Sort columns of a sort parameter; nulls last; id breaks ties."""
    return _ordered(_sort_fields(sort))


def search(docs: DataFrame, q: str | None = None, sort: str | None = None, page: int = 1, page_size: int = 20,
           typos: bool = False, **filters) -> DataFrame:
    """One page of hits: filters, then text match, then relevance and sort order."""
    page = 1 if page <= 0 else page
    page_size = 20 if page_size <= 0 or page_size > 100 else page_size
    hits = match_text(filter_docs(docs, **filters), q, typos)
    order = ([F.col("score").desc()] if _query_tokens(docs, q) else []) + sort_order(sort)
    return hits.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def _cursor(fields: list[tuple[str, bool]]) -> Column:
    """Where a hit stands in the order, as text; times are whole microseconds."""
    return F.to_json(F.struct(*[(F.unix_micros(c) if c.endswith("At") else F.col(c)).alias(c) for c, _ in fields]), {"ignoreNullFields": "false"})


def _behind(fields: list[tuple[str, bool]], cursor: str) -> Column:
    """Rows that come after a cursor: equal in some first fields and behind it in the next one."""
    at = json.loads(cursor)
    if list(at) != [c for c, _ in fields]:
        raise ValueError("the cursor is of another order")
    behind, level = F.lit(False), F.lit(True)
    for c, up in fields:
        value = F.timestamp_micros(F.lit(at[c])) if c.endswith("At") and at[c] is not None else F.lit(at[c])
        if at[c] is not None:  # nulls are last, so nothing is behind one in its own field
            behind = behind | level & (F.col(c).isNull() | (F.col(c) > value if up else F.col(c) < value))
            level = level & (F.col(c) == value)
        else:
            level = level & F.col(c).isNull()
    return F.coalesce(behind, F.lit(False))


def search_after(docs: DataFrame, cursor: str | None = None, q: str | None = None, sort: str | None = None, page_size: int = 20,
                 typos: bool = False, **filters) -> DataFrame:
    """The page of hits behind ``cursor``, the first one if it is None. Each hit has a ``cursor``; the last one's asks for the next page.

    Same hits in the same order as ``search``, but no page costs more than the first: the cursor is a filter on the sort fields, and a page
    is the first rows of what is left, where an offset would sort and pass over all pages before.
    """
    page_size = 20 if page_size <= 0 or page_size > 100 else page_size
    hits = match_text(filter_docs(docs, **filters), q, typos)
    fields = ([("score", False)] if _query_tokens(docs, q) else []) + _sort_fields(sort)
    if cursor is not None:
        hits = hits.filter(_behind(fields, cursor))
    return hits.orderBy(*_ordered(fields)).limit(page_size).withColumn("cursor", _cursor(fields))


def count_hits(docs: DataFrame, q: str | None = None, page_size: int = 20, typos: bool = False, **filters) -> DataFrame:
    """Total hits and page count of a search with the same arguments."""
    hits = match_text(filter_docs(docs, **filters), q, typos)
    return hits.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", page_count(F.col("total"), page_size))


def page_count(total: Column, page_size: int) -> Column:
    """Pages needed for `total` hits."""
    return F.ceil(total / F.lit(page_size)).cast("long")


def facets(docs: DataFrame) -> DataFrame:
    """Active documents per value of each filterable field: attribute, value, n."""
    live = active_only(docs)
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in FACETS])
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                       lambda t: F.struct(F.lit("tags").alias("attribute"), t.alias("value")))
    rows = live.select(F.explode(F.concat(pairs, tags)).alias("_p")).select("_p.attribute", "_p.value")
    return rows.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def get_posting(state: DataFrame, posting_id: str) -> DataFrame:
    """One posting whatever its status."""
    return state.filter(F.col("id") == posting_id)


def list_sources(sources: DataFrame) -> DataFrame:
    """Sources by name."""
    return sources.select("id", "name", "type", "base_url", "enabled").orderBy("name")


def _doc_terms() -> Column:
    """Everything a saved search can ask of a document, as (term, weight): its words with the weight of their field, its field values and tags."""
    def weighed(terms: Column, weight: int) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    words = [weighed(F.transform(_tokens(f), lambda t: F.concat(F.lit("w:"), t)), int(w)) for f, w in zip(TEXT_FIELDS, _weights())]
    fields = [F.concat(F.lit(f"{f}="), F.lower(F.col(f))) for f in [*ENUM_FIELDS, *PLAIN_FIELDS.values()]]
    tags = F.transform(F.col("tags"), lambda t: F.concat(F.lit("tag="), t))
    plain = [weighed(terms, 0) for terms in (F.array(*fields), tags)]
    none = F.array().cast("array<struct<term:string,weight:int>>")
    return F.filter(F.concat(*[F.coalesce(terms, none) for terms in [*words, *plain]]), lambda t: t["term"].isNotNull())


def _query_terms() -> Column:
    """(part, kind, term) of each condition; parts are AND-ed, terms of one part are OR-ed."""
    words = _words(F.col("q"))
    n = F.size(words)
    texts = F.transform(words, lambda w, i: F.struct(
        (i + 100).alias("part"), F.when(i == n - 1, "prefix").otherwise("exact").alias("kind"), F.concat(F.lit("w:"), w).alias("term")))
    fields = []
    for p, (f, enum) in enumerate(ENUM_FIELDS.items()):
        name = F.nullif(parse_enum(F.col(f), enum), F.lit("Unknown"))
        fields.append(F.struct(F.lit(p).alias("part"), F.lit("exact").alias("kind"), F.concat(F.lit(f"{f}="), F.lower(name)).alias("term")))
    for p, (param, f) in enumerate(PLAIN_FIELDS.items()):
        fields.append(F.struct(F.lit(10 + p).alias("part"), F.lit("exact").alias("kind"),
                               F.concat(F.lit(f"{f}="), F.lower(null_if_blank(F.col(param)))).alias("term")))
    tags = F.transform(parse_tag_csv(F.col("tags")), lambda t: F.struct(
        F.lit(20).alias("part"), F.lit("exact").alias("kind"), F.concat(F.lit("tag="), t).alias("term")))
    return F.filter(F.concat(texts, F.array(*fields), tags), lambda t: t["term"].isNotNull())


BLOCK = 1 << 10  # documents of a block, in sort order
GROWTH = 8       # how many more blocks each further round reads


def _asked_lists(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """key, block and entries: the documents that have what is asked, as ``place in the block * 16 + weight``, at most BLOCK of them.

    A prefix has a list of its own, made of those of the terms that it begins. Terms that nobody asks for have none.
    """
    postings = cut_lineage(ranked.select("pos", F.explode(_doc_terms()).alias("t")).select("pos", "t.term", "t.weight"))
    terms = cut_lineage(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    prefixed = asked.filter(F.col("kind") == "prefix")
    # Prefixes of the lengths that are asked for; a number per distinct length of a query's last word.
    sizes = sorted(r.n for r in prefixed.select(F.length("term").alias("n")).distinct().collect())
    lengths = F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")
    begun = terms.filter(F.col("term").startswith("w:")).select("term", F.explode(F.transform(
        F.filter(lengths, lambda n: n <= F.length("term")), lambda n: F.left("term", n))).alias("prefix"))
    wide = begun.join(prefixed.select(F.col("term").alias("prefix"), "key"), "prefix").select("term", "key")
    exact = asked.filter(F.col("kind") == "exact").join(terms, "term", "left_semi").select("term", "key")
    n_postings = terms.agg(F.sum("n")).first()[0] or 0
    met = spread_join(postings, cut_lineage(exact.unionByName(wide)), ["term"], rows=n_postings)
    best = met.groupBy("key", "pos").agg(F.max("weight").alias("weight"))
    entry = (F.col("pos") % BLOCK * 16 + F.col("weight")).cast("int")
    lists = best.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.collect_list(entry).alias("entries"), F.max("weight").alias("top"))
    # In the order of blocks, so that a round reads its own row groups only.
    return stored(lists.repartitionByRange("block", "key").sortWithinPartitions("block", "key"))


def _round(live: DataFrame, parts: DataFrame, here: DataFrame) -> DataFrame:
    """combo, pos and score of the documents of some blocks that meet all parts of a live search.

    A search looks only into blocks in which its rarest part occurs, and lists are laid over each other as arrays: rows are made of
    documents only where a block has a hit.
    """
    first = parts.filter("rarest").join(live.select("combo"), "combo").join(here.select("key", "block"), "key").select("combo", "block").distinct()
    fetched = first.join(parts.select("combo", "part", "key"), "combo").join(here.select("key", "block", "entries"), ["key", "block"])
    # Tags are the only part with several keys; all have weight 0, so a document's entries are equal.
    merged = fetched.groupBy("combo", "block", "part").agg(F.array_distinct(F.flatten(F.collect_list("entries"))).alias("entries"))
    whole = merged.groupBy("combo", "block").agg(F.collect_list("entries").alias("lists")).join(live.select("combo", "n_parts"), "combo")
    places = F.transform("lists", lambda entries: F.transform(entries, lambda e: F.shiftright(e, 4)))
    common = F.aggregate(places, F.try_element_at(places, F.lit(1)), F.array_intersect)
    hits = whole.filter((F.size("lists") == F.col("n_parts")) & (F.size(common) > 0))
    rows = hits.select("combo", "block", "n_parts", F.explode("lists").alias("entries")).select(
        "combo", "block", "n_parts", F.explode("entries").alias("e"))
    rows = rows.groupBy("combo", (F.col("block") * BLOCK + F.shiftright("e", 4)).alias("pos"), "n_parts").agg(
        F.count(F.lit(1)).alias("met"), F.sum(F.col("e") % 16).cast("double").alias("score"))
    return rows.filter(F.col("met") == F.col("n_parts")).select("combo", "pos", "score")


def batch_search(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """First `k` hits of each saved search: query_id, rank, id, score.

    `queries` has query_id and the string parameters q, tags, workMode, seniority, employmentType, company,
    location, sourceName, postedFrom. Equal searches are evaluated once. Documents are numbered in sort order and dealt to blocks;
    every term or prefix that is asked for has a list of places in each block. Rounds read ever more blocks, first the newest:
    a search leaves when it has `k` hits that no later document can beat (its words' best weights bound the score) or when the rest is
    older than its date. So a term that very many documents have is read a few blocks deep by searches with plenty of hits.
    Searches without a condition that a term can meet, also those with only a date, share the first `k` documents in sort order:
    the newest come first, so the ones after a date are the first of all.
    """
    with broadcasts_measured(docs.sparkSession):
        return stored(_batch_hits(queries, docs, k))


def _batch_hits(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The hits of ``batch_search``, whose last join has still to run."""
    params = ["q", "tags", "workMode", "seniority", "employmentType", "company", "location", "sourceName", "postedFrom"]
    keyed = queries.withColumn("combo", F.sha2(F.to_json(F.struct(*params)), 256))
    combos = cut_lineage(keyed.select("combo", *params).dropDuplicates(["combo"]).select(
        "combo", _query_terms().alias("terms"), F.date_trunc("day", parse_date(F.col("postedFrom"))).alias("floor")))
    live_docs = active_only(docs)
    ranked = number_rows(live_docs.select("id", "postedAt", "capturedAt", "tags", *[f for f in dict.fromkeys(
        [*TEXT_FIELDS, *ENUM_FIELDS, *PLAIN_FIELDS.values()]) if f != "tags"]), sort_order(None), "pos")
    ranked = stored(ranked)
    blocks = -(-ranked.count() // BLOCK)

    conditions = combos.select("combo", F.explode("terms").alias("c")).select(
        "combo", "c.part", "c.kind", "c.term", F.concat_ws(":", "c.kind", "c.term").alias("key"))
    lists = _asked_lists(conditions.select("kind", "term", "key").distinct(), ranked)
    known = cut_lineage(lists.groupBy("key").agg(F.sum(F.size("entries")).alias("df"), F.max("top").alias("top")))
    parts = conditions.select("combo", "part", "key").distinct().join(known, "key", "left")
    costs = parts.groupBy("combo", "part").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("cost"), F.max("top").alias("top"))
    plans = costs.groupBy("combo").agg(
        F.count(F.lit(1)).alias("n_parts"), F.min("cost").alias("least"), F.min_by("part", F.struct("cost", "part")).alias("rarest"), F.sum("top").alias("most"))
    plans = cut_lineage(plans.filter(F.col("least") > 0).join(combos.select("combo", "floor"), "combo"))
    parts = cut_lineage(parts.filter(F.col("df") > 0).join(plans.select("combo", "rarest"), "combo").select(
        "combo", "part", "key", (F.col("part") == F.col("rarest")).alias("rarest")))

    live, top = plans, None
    start, end = 0, 1
    while start < blocks:
        span = (F.col("block") >= start) & (F.col("block") < end)
        found = _round(live, parts, lists.filter(span))
        places = ranked.filter((F.col("pos") >= start * BLOCK) & (F.col("pos") < end * BLOCK)).select("pos", "id", "postedAt")
        found = found.join(places, "pos").join(live.select("combo", "floor"), "combo")
        found = found.filter(F.col("floor").isNull() | (F.col("postedAt") >= F.col("floor"))).select("combo", "pos", "score", "id")
        both = found if top is None else top.select("combo", "pos", "score", "id").unionByName(found)
        top = cut_lineage(first_n(both, ["combo"], [F.col("score").desc(), F.col("pos")], k))
        start, end = end, end + (end - start) * GROWTH
        if start >= blocks:
            break
        kth = top.filter(F.col("rn") == k).select("combo", F.col("score").alias("kth"))
        next_posted = ranked.filter(F.col("pos") == start * BLOCK).first().postedAt  # one row
        newer = F.lit(False) if next_posted is None else F.col("floor") <= F.lit(next_posted)
        live = cut_lineage(live.join(kth, "combo", "left").filter(
            (F.col("kth").isNull() | (F.col("kth") < F.col("most"))) & (F.col("floor").isNull() | newer)).drop("kth"))
        if live.isEmpty():
            break
    newest = ranked.filter(F.col("pos") < k).select("id", "postedAt", (F.col("pos") + 1).cast("int").alias("rn"))
    open_ones = combos.filter(F.size("terms") == 0).select("combo", "floor")
    after = F.col("floor").isNull() | (F.col("postedAt") >= F.col("floor"))
    hits = open_ones.join(F.broadcast(newest), after).select("combo", "rn", "id", F.lit(0.0).alias("score"))  # k rows
    if top is not None:
        hits = hits.unionByName(top.select("combo", "rn", "id", "score"))
    return spread_join(keyed.select("query_id", "combo"), hits, ["combo"]).select("query_id", F.col("rn").alias("rank"), "id", "score")

"""Clusters of postings with similar word sets: an exact set-similarity join.

Words are ordered rarest first. Two sets of n <= m words whose Jaccard similarity reaches the threshold t share at least
a = ceil(t / (1 + t) * (n + m)) words, and the i-th of them (from 0) is at place n - a + i at most in the one and m - a + i in the other.
So similar sets meet under a word among the first few of both, and under 1 + e words when e more places are looked at. A pair is formed under
the words that both have among these places; it is left if sizes or 64-bit maps (the parity of the words of each bit) differ too much or fewer words
than 1 + e were met. Only what is left fetches words.

Words of many sets are met by size too: a set is filed under its own class of sizes and looked for from there and from larger ones.
Where very many sets still meet, they are not paired out. They are compared with one of them. Words that all their sets are linked under then
are done with; where few sets are apart from the largest linked group, only these meet all others. The rest meet again under that word and a
later one, for which there is one place more.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import normalize_text
from postingflow.operators.scan import SMALL_ROWS, spread_join
from postingflow.session import cut_lineage, stored

BUCKETS = 1 << 20   # words share a frequency by hash: a table of fixed size, one byte each
PAIRED = 128        # most sets under one word that are paired out; twice as many where sizes don't count
DEEPER = 2          # how many more words hot ones are split by
SPARE = 4           # most places more, and words to be met besides the first
SPARE_WORDS = 32    # one for so many words of a set


def word_set(text: Column) -> Column:
    """Distinct folded words, sorted."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(normalize_text(text), r"\s+"), "")))


def _words(joined: str = "words") -> Column:
    return F.split(joined, " ")


def _frequencies(sets: DataFrame) -> Column:
    """How many sets hold words of each hash bucket, as a binary literal of BUCKETS bytes: four times the logarithm to base 2."""
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")
    counted = sets.select(F.explode(_words()).alias("w")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).select(
        "b", _frequency_class(F.col("n")).alias("c")).toArrow()  # BUCKETS rows at most
    held = np.zeros(BUCKETS, np.uint8)
    held[counted["b"].to_numpy()] = counted["c"].to_numpy()
    return F.lit(held.tobytes())


def _frequency_class(n: Column) -> Column:
    return F.least(F.lit(127), F.ceil(F.log2(n.cast("double")) * 4 - 1e-9)).cast("byte")


def _least_shared(n: Column, m: Column, threshold: float) -> Column:
    """Words that similar sets of n and m words share at least."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def _spare(n: Column) -> Column:
    return F.least(F.lit(SPARE), F.floor(n / SPARE_WORDS))


def _last_place(n: Column, threshold: float) -> Column:
    """The place up to which the first word shared with any similar set is."""
    return n - F.ceil(n * threshold - 1e-9)


def _described(sets: DataFrame, threshold: float) -> DataFrame:
    """set, n (words), keys (of the words at the places that may be looked at) and the map of sets with words.

    A key is the frequency class and 56 bits of the word's hash, so keys are in the order of the words.
    """
    classes = _frequencies(sets)

    def key(w: Column) -> Column:
        h = F.xxhash64(w)
        place = F.pmod(h, F.lit(BUCKETS)).cast("int") + 1
        rare = F.ascii(F.substring(classes, place, F.lit(1)).cast("string")).cast("long")
        return F.shiftleft(rare, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    def toggled(bits: Column, k: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, 20).bitwiseAND(F.lit(63)).cast("int")))

    split = sets.select("set", _words().alias("words"))
    rows = split.select("set", F.size("words").alias("n"), F.sort_array(F.transform("words", key)).alias("ordered"))
    places = (_last_place(F.col("n"), threshold) + 1 + F.greatest(_spare(F.col("n")), F.lit(DEEPER))).cast("int")
    return stored(rows.select("set", "n", F.slice("ordered", F.lit(1), places).alias("keys"), F.aggregate("ordered", F.lit(0).cast("long"), toggled).alias("map")))


def _filed(described: DataFrame, threshold: float, paired: int) -> tuple[DataFrame, DataFrame]:
    """key, set, n, at and map: a set under its first words, those of up to twice ``paired`` sets and others.

    The others are joined with a class of sizes: the set's own and those of the smaller sets that are similar in size. Where the set can only
    be the larger one of a pair, n is negative.
    """
    size = F.col("n")
    width = math.log(max(1 / threshold, 1.01))
    own = F.floor(F.log(size.cast("double")) / width + 1e-9).cast("int")
    least = F.greatest(F.lit(1), F.ceil(size * threshold - 1e-9))
    lowest = F.floor(F.log(least.cast("double")) / width + 1e-9).cast("int")
    classes = described.select("*", own.alias("own"), lowest.alias("lowest"), least.alias("least"))
    places = (_last_place(size, threshold) + 1 + _spare(size)).cast("int")
    words = classes.select("set", "n", "map", "own", "lowest", "least", F.posexplode(F.slice("keys", F.lit(1), places)).alias("at", "key"))
    frequency = F.shiftright("key", 56)  # 0: in no other set
    common = frequency > _frequency_class(F.lit(2 * paired))
    rare = words.where((frequency > 0) & ~common).select("key", "set", "n", "at", "map")
    by_size = words.where(common).select("*", F.explode(F.sequence("lowest", "own")).alias("class"))
    smallest = F.greatest("least", F.floor(F.exp(F.col("class") * width) - 1e-6))  # of the sets that this one can meet as the larger one
    near = F.col("at") <= size - _least_shared(size, smallest, threshold) + _spare(size)
    return rare, by_size.where(near).select(
        F.xxhash64("key", "class").alias("key"), "set", F.when(F.col("class") == F.col("own"), size).otherwise(-size).alias("n"), "at", "map")


def _met(rows: DataFrame, others: DataFrame | None, threshold: float, level: int) -> DataFrame:
    """Pairs (set, n, head) of a set and a larger one of ``others`` (of the same rows if None) that meet under a key and may be similar, once for each key."""
    a, b = rows.alias("a"), (rows if others is None else others).alias("b")
    n, m, shared_by = F.col("a.n"), F.abs("b.n"), F.col("a.key") == F.col("b.key")
    # A set that can only be the larger one (n below 0) fails the sizes' test. No test is of one side alone and no column renamed before the join:
    # rows that meet each other are shuffled once.
    order = (n < m) | ((n == m) & (F.col("a.set") < F.col("b.set")))
    sizes = n >= m * threshold - 1e-9
    shared = _least_shared(n, m, threshold)
    more = F.lit(level) if level else _spare(n)
    places = (F.col("a.at") <= n - shared + more) & (F.col("b.at") <= m - shared + more)
    near = sizes & order & places & _maps_alike(F.col("a.map"), F.col("b.map"), n + m, threshold)
    if "label" in rows.columns:
        near = near & (F.col("a.label") != F.col("b.label"))
    return a.join(b, shared_by).where(near).select(F.col("a.set").alias("set"), F.col("a.n").alias("n"), F.col("b.set").alias("head"))


def _maps_alike(one: Column, other: Column, words: Column, threshold: float) -> Column:
    """Each bit in which the maps differ is a word of one set only."""
    return F.bit_count(one.bitwiseXOR(other)) <= words * ((1 - threshold) / (1 + threshold)) + 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (set, head) whose sets are similar, by their words, as links (leader, head)."""
    pairs = cut_lineage(pairs.select(F.greatest("set", "head").alias("leader"), F.least("set", "head").alias("head")).distinct())
    ends = cut_lineage(pairs.select(F.col("leader").alias("set")).unionAll(pairs.select(F.col("head").alias("set"))).distinct())
    many = ends.count()
    if not many:
        return pairs
    some = stored(sets.select("set", "words").join(_sent_if_few(ends, many), "set", "left_semi"))
    # A set that meets very many others is a skewed partition, which adaptive execution splits.
    a, b = (some.select(F.col("set").alias(name), F.col("words").alias(words)) for name, words in (("leader", "wordsa"), ("head", "wordsb")))
    both = pairs.join(a, "leader").join(b, "head").select("leader", "head", _words("wordsa").alias("wordsa"), _words("wordsb").alias("wordsb"))
    common = F.size(F.array_intersect("wordsa", "wordsb"))
    return cut_lineage(both.where(common / (F.size("wordsa") + F.size("wordsb") - common) >= threshold).select("leader", "head"))


def similar_links(sets: DataFrame, threshold: float, paired: int = PAIRED) -> DataFrame:
    """Links (leader, head) between similar sets: any two similar sets are connected by them. ``sets`` has set, a number, and words, joined by
    blanks and all different.

    ``paired`` changes the work, not what is connected.
    """
    described = _described(sets, threshold)
    rare, rows = _filed(described, threshold, paired)
    links = None
    for level in range(DEEPER + 1):
        crowded = _crowded(rows, threshold, paired, level)
        left, met = None, _met(rows if crowded is None else rows.join(crowded, "key", "left_anti"), None, threshold, level)
        if crowded is not None:
            hot = stored(rows.join(crowded, "key"))
            found = _verified(_with_one(hot, threshold), sets, threshold)
            links = found if links is None else links.unionAll(found)
            labels = follow_links(links).withColumnRenamed("leader", "set")
            left, apart = _grouped(hot.drop("label").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")), paired)
            for smaller, larger in apart:
                met = met.unionAll(_met(smaller, larger, threshold, level))
        likely = met.select("set", "head") if level else _met_often(met.unionAll(_met(rare, None, threshold, level)), left, threshold)
        found = _verified(likely, sets, threshold)
        links = found if links is None else links.unionAll(found)
        if left is None or left.isEmpty():
            break
        places = (_last_place(F.abs("n"), threshold) + 2 + level).cast("int")
        later = left.join(described.select("set", "keys"), "set").select(
            "key", "set", "n", "at", "map", "label", F.posexplode(F.slice("keys", F.lit(1), places)).alias("next", "word"))
        rows = stored(later.where("next > at").select(F.xxhash64("key", "word").alias("key"), "set", "n", F.col("next").alias("at"), "map", "label"))
    return links


def _grouped(hot: DataFrame, paired: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Rows under keys of more than ``paired`` sets besides the largest linked group, and the sides of pairs (smaller, larger) under the others."""
    hot = stored(hot)
    groups = hot.groupBy("key", "label").agg(F.count(F.lit(1)).alias("held"))
    largest = groups.groupBy("key").agg(F.max(F.struct("held", "label")).alias("most"), F.sum("held").alias("held")).select(
        "key", F.col("most.label").alias("most"), (F.col("held") - F.col("most.held")).alias("others"))
    largest = stored(largest.where("others > 0"))
    few = hot.join(largest.where(F.col("others") <= paired).select("key", "most"), "key")
    others, most = few.where("label != most").drop("most"), few.where("label = most").drop("most")
    return stored(hot.join(largest.where(F.col("others") > paired).select("key"), "key")), [(others, few.drop("most")), (most, others)]


def _crowded(rows: DataFrame, threshold: float, paired: int, level: int) -> DataFrame | None:
    """Keys under which more than ``paired`` sets may be the smaller one of a pair; None if there are none, or on the last level."""
    if level == DEEPER:
        return None
    crowded = stored(rows.where(_first(threshold, level)).groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > paired).select("key"))
    many = crowded.count()
    return _sent_if_few(crowded, many) if many else None


def _sent_if_few(keys: DataFrame, many: int) -> DataFrame:
    """Keys to be joined with many rows, which aren't shuffled for a few."""
    return F.broadcast(keys) if many <= SMALL_ROWS else keys.hint("merge")


def _first(threshold: float, level: int) -> Column:
    """Whether a set may be the smaller one of a pair here."""
    n = F.col("n")
    return (n > 0) & (F.col("at") <= n - _least_shared(n, n, threshold) + (F.lit(level) if level else _spare(n)))


def _met_often(pairs: DataFrame, left: DataFrame | None, threshold: float) -> DataFrame:
    """Pairs (set, head) that met under as many words as similar sets do, less those under which the smaller one is left to later levels.

    Under other words that were not paired out, all pairs that aren't linked yet were formed.
    """
    met = pairs.groupBy("set", "head", "n").agg(F.count(F.lit(1)).alias("met"))
    if left is None:
        return met.where(F.col("met") > _spare(F.col("n"))).select("set", "head")
    unseen = left.where(_first(threshold, 0)).groupBy("set").agg(F.count(F.lit(1)).alias("unseen"))
    return met.join(unseen, "set", "left").where(F.col("met") + F.coalesce("unseen", F.lit(0)) > _spare(F.col("n"))).select("set", "head")


def _with_one(hot: DataFrame, threshold: float) -> DataFrame:
    """Pairs (set, head) of one set of each key with all the others that may be similar."""
    one = hot.groupBy("key").agg(F.min_by(F.struct("set", "n", "map"), F.struct(F.xxhash64("set"), "set")).alias("one"))
    named = one.select("key", F.col("one.set").alias("head"), F.col("one.n").alias("other_n"), F.col("one.map").alias("other_map"))
    n, m = F.abs("n"), F.abs("other_n")
    near = (F.col("set") != F.col("head")) & (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9) & _maps_alike(F.col("map"), F.col("other_map"), n + m, threshold)
    return hot.join(named, "key").where(near).select("set", "head")


def cluster_similar(postings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Clusters of postings connected by word sets with a Jaccard similarity of ``threshold`` (above 0) or more; returns id and cluster_id, the smallest id.

    Equal word sets collapse first, so copies cost one row. Postings without words are one cluster.
    """
    joined = F.array_join(word_set(F.concat_ws(" ", "title", "company_name", "description_text")), " ")
    keyed = stored(postings.select("id", joined.alias("words")).select("id", F.unhex(F.sha2("words", 256)).alias("set_key"), "words"))
    sets = stored(keyed.groupBy("set_key").agg(F.min("id").alias("leader"), F.min("words").alias("words")).withColumn(
        "set", F.monotonically_increasing_id()))
    links = similar_links(sets.where("leader IS NOT NULL AND words != ''").select("set", "words"), threshold)
    named = sets.select("set", "leader").where("leader IS NOT NULL")
    # Sets of one id are one node.
    again = named.groupBy("leader").agg(F.min("set").alias("first"), F.max("set").alias("last")).where("first < last").select("leader", "first")
    again = spread_join(named, again, ["leader"]).select(F.col("set").alias("leader"), F.col("first").alias("head")).where("leader != head")
    labels = follow_links(links.unionAll(again)).withColumnRenamed("leader", "set")
    reached = labels.join(named, "set")
    names = spread_join(reached.select("set", "label"), reached.groupBy("label").agg(F.min("leader").alias("name")), ["label"]).select("set", "name")
    clusters = sets.join(names, "set", "left").select("set_key", F.coalesce("name", "leader").alias("cluster_id"))
    return spread_join(keyed.select("id", "set_key"), clusters, ["set_key"]).select("id", "cluster_id")


def follow_links(links: DataFrame) -> DataFrame:
    """Smallest reachable id per node of an undirected link table (leader, head): min-label with pointer jumps."""
    edges = cut_lineage(links.select(F.col("leader").alias("a"), F.col("head").alias("b")).unionByName(
        links.select(F.col("head").alias("a"), F.col("leader").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("_b")).select(
        F.col("a").alias("leader"), F.least("a", "_b").alias("label")))
    while True:
        near = spread_join(edges, labels.select(F.col("leader").alias("b"), F.col("label").alias("_l")), ["b"]).groupBy(
            "a").agg(F.min("_l").alias("_near"))
        step = labels.join(near, labels.leader == near.a, "left").select(
            "leader", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("leader").alias("_new"), F.col("label").alias("_far"))
        moved = cut_lineage(spread_join(step, jump, ["_new"], "left").select(
            "leader", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("label")))
        labels = moved.select("leader", "label")
        if moved.filter(F.col("label") != F.col("_old")).isEmpty():
            return labels

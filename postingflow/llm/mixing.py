"""Mixing sources to target weights along a curriculum that changes over training.

Each source has a share of all words, capped at a multiple of its own words, and a weight schedule over training time 0 to 1. The
integral of the schedule is the source's cumulative demand; inverting it turns the words of the source that come before a document
copy into the copy's training position, and the copies of all sources are sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postingflow.llm.common import running_total, shuffle_key, slice_bits, table, word_count
from postingflow.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
# Weight over time as (time, weight) knots, linear in between, for the sources of each weight in turn. Only the shape counts.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)),
)


def source_key(source: Column) -> list[Column]:
    """The source without nulls: a flag that sorts null last, and the name."""
    return [source.isNull().alias("_no_source"), F.coalesce(source, F.lit("")).alias("_source")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source, from _no_source, _source and size rows.

    Filling all sources in proportion to weight and stopping each at ``cap`` times its words is a water level: the source with
    the lowest cap per weight stops first. The windows run over one row per source. Sources without words get 0.
    """
    totals = sizes.groupBy("_no_source", "_source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("_no_source", "_source")
    ranked = totals.withColumn("_class", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_class") + 1).cast("double"))
    by_level = Window.orderBy("_stop", "_no_source", "_source")
    every = Window.partitionBy()
    level = (ranked.withColumn("_stop", cap * F.col("source_size") / F.col("_weight"))
             .withColumn("_capped", F.coalesce(F.sum(cap * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_open", F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
             .withColumn("_all", F.sum("source_size").over(every))
             .withColumn("_try", (F.col("_all") - F.col("_capped")) / F.col("_open"))
             .withColumn("_level", F.max(F.when(F.col("_try") <= F.col("_stop"), F.col("_try"))).over(every)))
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("_weight") * F.coalesce("_level", "_stop"))
    return level.select("_no_source", "_source", "_class", "source_size", target.alias("target"))


def invert_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule has asked for ``share`` (0 to 1) of all it asks for."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, t1, w0, w1, total))
        total += (w0 + w1) / 2 * (t1 - t0)
    asked, out, above = share * total, None, None
    for t0, t1, w0, w1, before in reversed(pieces):
        slope, rest = (w1 - w0) / (t1 - t0), asked - before
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        time = F.least(F.lit(t1), F.lit(t0) + F.when(rest > 0, 2 * rest / (w0 + root)).otherwise(0.0))
        out = time if out is None else F.when(asked < above, time).otherwise(out)
        above = before
    return out


def with_position(rows: DataFrame, copy: Column, schedules: tuple, out: str) -> DataFrame:
    """Add the training position, 0 to 1, of a document's copy, from its source's class, target and words before it."""
    middle = copy * F.col("source_size") + F.col("_before") + F.col("_words") / 2
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle / F.col("target"))).otherwise(F.lit(0.0))
    position = None
    for i, knots in enumerate(schedules):
        at = invert_demand(F.col("_share"), knots)
        position = at if position is None else F.when(F.col("_class") == i, at).otherwise(position)
    # A column of its own, or the share would be written out at each of its many uses.
    return rows.withColumn("_share", share).withColumn(out, position).drop("_share")


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row for each distinct (source, doc_id, size): source_size, target, copies, and first_position of the first copy.

    A source with target f times its words takes every document floor(f) times; in a shuffled order the documents whose middle
    lies within the rest are taken once more. Rows that agree in source, id and size share one decision.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = rows.groupBy(*source_key(F.col("source")), "doc_id", "size").agg((F.col("size") * F.count(F.lit(1))).alias("_words"))
    units = cut_lineage(units.withColumn("_key", shuffle_key(F.col("doc_id"))))
    targets = source_targets(units.select("_no_source", "_source", F.col("_words").alias("size")), weights, cap)
    bits = slice_bits(units.count())
    placed = running_total(units, ["_no_source", "_source"], "_key", ["doc_id", "size"], "_words", "_before", bits)
    placed = placed.join(targets, ["_no_source", "_source"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    middle = F.col("_before") + F.col("_words") / 2
    copies = F.col("_whole") + F.when((F.col("size") > 0) & (middle <= F.col("target") - F.col("_whole") * F.col("source_size")), 1).otherwise(0)
    placed = placed.withColumn("_whole", whole).withColumn("copies", copies.cast("long"))
    return with_position(placed, F.lit(0), schedules, "first_position").withColumn("first_position", F.round("first_position", 6))


def join_decisions(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (with _no_source, _source, doc_id and size) with the decision on them."""
    names = {"_no_source": "_m0", "_source": "_m1", "doc_id": "_m2", "size": "_m3"}
    same = (F.col("_no_source") == F.col("_m0")) & (F.col("_source") == F.col("_m1")) & (F.col("size") == F.col("_m3")) & F.col("doc_id").eqNullSafe(F.col("_m2"))
    return rows.join(chosen.withColumnsRenamed(names), same).drop(*names.values())


def mix_decisions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (copies times size), copies and first_position for every row of ``docs``."""
    rows = docs.select(*source_key(F.col("source")), "doc_id", word_count(F.col("text")).alias("size"))
    return join_decisions(rows, decide(docs, **options)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "first_position")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, schedules: tuple = SCHEDULES) -> DataFrame:
    """The training set: the columns of ``docs``, a row per copy taken, range-sorted by training position.

    Null texts and texts without words have size 0 and are never needed for a target: they come through as often as the source is
    taken whole. A null source is a source of its own, last in order. An empty table gives an empty one. Columns other than
    doc_id, text and source are passed on untouched.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", *source_key(F.col("source")), word_count(F.col("text")).alias("size"))
    copies = (join_decisions(rows, decide(docs, weights, cap, schedules).where("copies > 0"))
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))))
    ordered = with_position(copies, F.col("_copy"), schedules, "_position").select("_row", "_position", "doc_id", "_copy")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (ordered.repartitionByRange(parts, "_position", "doc_id", "_copy").sortWithinPartitions("_position", "doc_id", "_copy")
            .select("_row.*"))


def op5_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the words the mix takes of each."""
    return mix_decisions(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
grouped AS (SELECT source, doc_id, size, sum(size)::BIGINT AS words FROM rows GROUP BY source, doc_id, size),
units AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k FROM grouped),
totals AS (SELECT source, sum(words)::BIGINT AS source_size FROM units GROUP BY source),
classed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS cls FROM totals),
weighted AS (SELECT *, ([5.0, 2.0, 1.0])[cls + 1]::DOUBLE AS weight FROM classed),
levels AS (
  SELECT *, 3 * source_size / weight AS stop,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try
  FROM weighted),
targets AS (
  SELECT source, cls, source_size, least(3.0::DOUBLE * source_size, weight * coalesce(max(CASE WHEN try <= stop THEN try END) OVER (), stop)) AS target FROM levels),
placed AS (
  SELECT u.*, t.cls, t.source_size, t.target,
         coalesce(sum(words) OVER (PARTITION BY u.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2 AS middle
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
chosen AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         CASE WHEN target > 0 THEN least(1.0, middle / target) ELSE 0.0 END AS share FROM placed),
copied AS (
  SELECT *, (whole + CASE WHEN size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS copies,
    CASE cls
      WHEN 0 THEN least(1.0, 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0))))
      WHEN 1 THEN share
      ELSE CASE WHEN share * 1.05 < 0.45 THEN least(0.6, 2 * share * 1.05 / (0.5 + sqrt(0.25 + 2 * (0.5 / 0.6) * share * 1.05)))
           ELSE least(1.0, 0.6 + 2 * (share * 1.05 - 0.45) / (1.0 + sqrt(1.0 + 2 * 2.5 * (share * 1.05 - 0.45)))) END
    END AS first_position
  FROM chosen)
SELECT r.doc_id, r.size, c.source_size, c.target, (c.copies * r.size)::BIGINT AS taken, c.copies, round(c.first_position, 6) AS first_position
FROM rows r JOIN copied c ON r.source IS NOT DISTINCT FROM c.source AND r.doc_id IS NOT DISTINCT FROM c.doc_id AND r.size = c.size
"""

QUERIES = {"op5_curriculum_mix": (op5_curriculum_mix, OP5_SQL)}

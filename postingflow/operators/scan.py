"""Ordered per-group helpers that stay parallel when one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of one group that one task may see in order; `seq` is a unique integer, so a chunk of
# this width holds at most this many rows of any group.
CHUNK = 1 << 16


def first_per_key(df: DataFrame, part: list[str], key: Column, order: list[str]) -> DataFrame:
    """The first row per (part, case-insensitive key) in `order`; an aggregate, so copies combine map-side."""
    order_by = F.struct(*order)
    rest = [c for c in df.columns if c not in part]
    return (
        df.withColumn("_key", F.lower(key))
        .groupBy(*part, "_key")
        .agg(F.min_by(F.struct(*rest), order_by).alias("_row"))
        .select(*part, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def first_n(df: DataFrame, group: list[str], order: list[Column], limit: int | Column, salts: int = 64) -> DataFrame:
    """The first `limit` rows per group, with their position as `rn`.

    A constant limit lets Spark cut each map task to `limit` rows before the shuffle. A limit that
    differs by row is ranked twice: inside salted slices of the group, then over the survivors.
    """
    whole = Window.partitionBy(*group).orderBy(*order)
    if isinstance(limit, int):
        return df.withColumn("rn", F.row_number().over(whole)).filter(F.col("rn") <= limit)
    spread = [c for c, kind in df.dtypes if "map" not in kind and "variant" not in kind]
    slices = Window.partitionBy(*group, "_salt").orderBy(*order)
    return (
        df.withColumn("_limit", limit)
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        .withColumn("rn", F.row_number().over(slices))
        .filter(F.col("rn") <= F.col("_limit"))
        .withColumn("rn", F.row_number().over(whole))
        .filter(F.col("rn") <= F.col("_limit"))
        .drop("_limit", "_salt")
    )


def _running(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return F.min(value) if kind == "min" else F.max(value)


def _summary(kind: str, value: Column, seq: Column, reverse: bool) -> Column:
    if kind == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(value, F.when(value.isNotNull(), seq))
    return F.min(value) if kind == "min" else F.max(value)


def prefix_scan(
    df: DataFrame, keys: list[str], seq: str, specs: dict[str, tuple[str, Column]], reverse: bool = False,
    span: int | None = None,
) -> DataFrame:
    """Add, per key, the running last/min/max of a value over the rows strictly before each row.

    Two levels: inside chunks of `seq`, then over one summary per chunk. No window sees more than
    CHUNK rows of a key, nor more than one row per chunk. `span` is a known bound of `seq`: below
    CHUNK one window is enough. `reverse` scans from the end instead.
    """
    inputs = {f"_in_{name}": value for name, (_, value) in specs.items()}
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())

    def before(part: list[str], order: str):
        return Window.partitionBy(*part).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, -1)

    if span is not None and span < CHUNK:
        base = df.withColumns(inputs)
        out = base.withColumns({n: _running(k, F.col(f"_in_{n}")).over(before(keys, seq)) for n, (k, _) in specs.items()})
        return out.select(*df.columns, *specs)

    base = df.withColumns({**inputs, "_chunk": F.floor(F.col(seq) / CHUNK)})
    inner = before([*keys, "_chunk"], seq)
    local = base.withColumns({f"_loc_{n}": _running(k, F.col(f"_in_{n}")).over(inner) for n, (k, _) in specs.items()})
    summaries = base.groupBy(*keys, "_chunk").agg(
        *[_summary(k, F.col(f"_in_{n}"), F.col(seq), reverse).alias(f"_sum_{n}") for n, (k, _) in specs.items()]
    )
    carried = summaries.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"),
        *[_running(k, F.col(f"_sum_{n}")).over(before(keys, "_chunk")).alias(f"_car_{n}") for n, (k, _) in specs.items()],
    )
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_chunk") == F.col("_k_chunk")]
    joined = local.join(carried, on, "left")

    def combine(name: str, kind: str) -> Column:
        near, far = F.col(f"_loc_{name}"), F.col(f"_car_{name}")
        if kind == "last":
            return F.coalesce(near, far)
        return F.least(near, far) if kind == "min" else F.greatest(near, far)

    out = joined.withColumns({n: combine(n, k) for n, (k, _) in specs.items()})
    return out.select(*df.columns, *specs)


HOT_ROWS = 1 << 20


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Equi-join of many rows to one row per key, with hot keys of `left` split over several tasks.

    A key is hot above HOT_ROWS rows, so there are at most rows/HOT_ROWS of them: that list is what is
    broadcast. Hot left rows get a salt from their own values (the same on a retry); only the matching
    right rows are repeated, once per salt. Null keys match nothing and are spread. With `rows`, a known
    size of `left` below HOT_ROWS, no key can be hot and a plain join is used.
    """
    if rows is not None and rows <= HOT_ROWS:
        return left.join(right, on, how)
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = F.broadcast(counted.select(*on, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_salts")))
    spread = F.xxhash64(*[c for c, kind in left.dtypes if "map" not in kind and "variant" not in kind])
    missing = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    salts = F.when(missing, F.lit(256)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = left.join(hot, on, "left").withColumn("_salt", F.pmod(spread, salts).cast("int")).drop("_salts")
    repeated = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Dense global position by `order`, without one global sort task.

    Rows are range-partitioned, numbered inside each range and shifted by the size of the ranges before;
    only one count per range is gathered.
    """
    from postingflow.session import cut_lineage

    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*order)
    return ranged.withColumn("_rn", F.row_number().over(within)).join(offsets, "_range").withColumn(
        name, (F.col("_offset") + F.col("_rn") - 1).cast("long")).drop("_range", "_rn", "_offset")


SMALL_ROWS = 100_000


def option_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a small per-source option table without shuffling them by source.

    The option table is counted first: up to SMALL_ROWS rows it is broadcast, beyond that hot sources are
    split by `spread_join`.
    """
    if right.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return left.join(F.broadcast(right), on, how)
    return spread_join(left, right, on, how)

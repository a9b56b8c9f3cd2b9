"""Small native helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
ROWS_PER_SLICE = 8192


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """While jobs run inside, Arrow batches to and from Python hold about ``size`` bytes; for rows that are long byte strings."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_finished(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: its cleaner waits until the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run: Callable) -> Callable:
    """``run`` over Arrow batches, after which the Python worker gives back the memory that it has no use for. Spark uses workers again, and
    each would keep what its largest task of any step took."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def annotated(docs: DataFrame, added: StructType, compute: Callable, needed: dict[str, Column] | None = None) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and the columns ``added``, computed by Arrow batches.

    ``compute(get, n)`` returns the arrays of a batch of n rows; ``get(name)`` is a column of ``needed``, else of ``docs``. As rows are
    packed, no column of ``docs`` clashes with another, whatever its name.
    """
    def run(batches):
        for b in batches:
            def get(name):
                held = b.column(1) if name in wanted else b.column(0)
                return pc.struct_field(held, name)
            yield pa.RecordBatch.from_arrays([b.column(0), *compute(get, b.num_rows)], ["row", *added.names])

    wanted = set(needed or ())
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    extra = F.struct(*[c.alias(n) for n, c in (needed or {"none": F.lit(None).cast("int")}).items()])
    return docs.select(whole.alias("row"), extra.alias("needed")).mapInArrow(trimmed(run), StructType([StructField("row", docs.schema, False), *added.fields]))


def without(docs: DataFrame, names) -> DataFrame:
    """``docs`` less the columns of these names; case doesn't count."""
    gone = {n.lower() for n in names}
    return docs.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns if c.lower() not in gone])


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 for a null id, so it belongs to no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def shuffle_key(*parts: Column) -> Column:
    """A 60-bit non-negative pseudo-random key of the parts: the first 15 hex digits of an MD5, so that SQL elsewhere can say it."""
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def slice_bits(rows: int, per_slice: int = ROWS_PER_SLICE) -> int:
    """Leading key bits that cut ``rows`` into slices of about ``per_slice`` rows."""
    return max(0, math.ceil(math.log2(max(rows, 1) / per_slice)))


def running_total(rows: DataFrame, groups: list[str], key: str, order: list[str], value: str, out: str, bits: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come earlier by (key, order).

    ``key`` is a ``shuffle_key``, so its leading ``bits`` cut every group, hot or not, into slices of like size: a slice is summed
    in one window, the slices of a group by a window over their totals. ``groups`` hold no nulls. The result doesn't depend on
    ``bits``. Rows equal in key and order are told apart arbitrarily.
    """
    cut = rows.withColumn("_slice", F.shiftright(F.col(key), KEY_BITS - bits))
    at = [*groups, "_slice"]
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*at).agg(F.sum(value).alias("_sum")).select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*at).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.join(offsets, at)
            .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_slice", "_offset"))

"""What finished steps leave behind, and how much Python gets at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postingflow.llm import common
from postingflow.session import cut_lineage, stored


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("step", [cut_lineage, stored])
def test_finished_steps_leave_no_shuffle_files(spark, step):
    before = _shuffle_files(spark)
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = step(rows)
    assert not _shuffle_files(spark) - before
    assert kept.agg(F.sum("count")).first()[0] == 10_000
    assert sum(r["count"] for r in rows.collect()) == 10_000


def test_batches_for_python_are_bounded_by_bytes(spark):
    @F.pandas_udf("long")
    def size(batch):
        return batch.map(lambda _: len(batch))

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000 + F.col("id").cast("int")).alias("text"))
    assert rows.select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 100


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    given = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: type("Library", (), {"malloc_trim": staticmethod(given.append)}))
    batches = [pa.RecordBatch.from_pydict({"n": [i]}) for i in range(3)]
    run = common.trimmed(lambda some: (b for b in some))(iter(batches))
    assert next(run) is batches[0] and not given
    assert list(run) == batches[1:] and given == [0]

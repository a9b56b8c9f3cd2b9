import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postingflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="postingflow-tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column built from named values on a single row."""
    def run(build, schema, *values):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([values], schema)
        return df.select(build(*[F.col(c) for c in df.columns]).alias("out")).first().out
    return run

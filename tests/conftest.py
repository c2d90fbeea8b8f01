import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    return session("4")


@pytest.fixture
def make(spark):
    """Small frames from rows and a DDL schema; times are UTC text."""
    from pyspark.sql import functions as F

    def build(rows, schema, times=("period",)):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.col(c).cast("timestamp") for c in times if c in df.columns})

    return build

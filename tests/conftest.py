import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from reviewloom.session import local_session

    session = local_session(cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Run a Column function over a list of values, results in order."""
    from pyspark.sql import functions as F

    def run(fn, values, dtype="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {dtype}")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]

    return run

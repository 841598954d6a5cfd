"""Every registered query against its SQL on the smallest test tables."""
import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_DIR
from tools.check import same
from workload.oracle import ORACLE
from workload.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert same(got, duck.sql(oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    final = entry(spark)
    assert final.count() > 0
    bad = final.where(
        "review_text = '' or not (user_id = 'anonymous' or user_id rlike '^[0-9a-f]{10}$')"
        " or not (review_time = '' or try_cast(review_time as date) is not null)"
    )
    assert bad.count() == 0


def test_results_do_not_depend_on_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, queries()["stratified_sample_events"](spark, SF_DIR).collect())))
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

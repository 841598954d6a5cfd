import os
from collections import defaultdict

import duckdb
import pytest

from reviewloom.llm import mix_sources as mix
from tests.conftest import SF_DIR


def run(df):
    return mix.mix_sources(df).select("doc_id", "size", "source_size", "target", "taken")


def check(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source_size"], r["target"]].append(r)
        assert r["taken"] <= 2 * r["size"]
    return by


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None)],
        [(1, "", "a"), (2, None, "b")],
        [(1, "a b c", None), (2, "a", "x"), (2, "a", "x"), (None, "b c", "x"), (5, "q" + " w" * 5000, "é")],
        [(i, "w " * (i % 17), "s%d" % (i % 7) if i % 3 else "hot") for i in range(900)],
        [(7, "a b c d e f g h i j", "one")] * 300 + [(i, "x y", "two") for i in range(20)],
        [(7, "w " * (i % 9), "one") for i in range(300)] + [(None, "a b", None)] * 40 + [(8, "q", "two")] * 2,
    ],
)
def test_matches_sql(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        duck.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    got = sorted(map(tuple, run(df).collect()), key=repr)
    assert got == sorted(duck.sql(mix.SQL % "t").fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")
def test_near_targets_and_rerun(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = run(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, run(df.repartition(5)).collect()))
    total = sum(r["size"] for r in got)
    by = check(got)
    assert abs(sum(k[1] for k in by) - 1.5 * total) < 1e-3 * total
    for (size, target), rows in by.items():
        assert target <= 2 * size + 1e-6
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)


@pytest.mark.parametrize("same_text", [True, False])
def test_near_target_where_one_id_repeats(spark, same_text):
    rows = [(7, "w " * (10 if same_text else 1 + i % 19), s) for s in "abc" for i in range(300)]
    by = check(run(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect())
    for (_, target), got in by.items():
        assert abs(sum(r["taken"] for r in got) - target) <= max(r["size"] for r in got) / 2


def test_mixed_keeps_all_columns(spark):
    rows = [(i % 40, "w " * (i % 7), f"s{i % 3}", i, "x", 1, 2) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, row string, h1 int, size int").repartition(3)
    got = mix.mixed(df)
    assert got.columns == [*df.columns, "copies_mixed"]
    want = run(df).groupBy().sum("taken").first()[0]
    assert sum(len(r["text"].split()) * r["copies_mixed"] for r in got.collect()) == want

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from reviewloom.llm import centroid_clusters as c
from tests.conftest import SF_DIR


def brute(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, z)), n) for n, z in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for n in range(len(at)):
            own = [v for (_, v), (_, m) in zip(kept, got) if m == n]
            if own:
                at[n] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    total = {n: sum(d for d, m in got if m == n) for n in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in at]
    return sorted(((i, n, d, total[n], sum(total.values()), digest[n]) for (i, _), (d, n) in zip(kept, got)), key=repr)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, planes int, n int").repartition(3)
    return sorted(map(tuple, c.centroid_clusters(df, **options).collect()), key=repr)


def vectors(seed, n, spread=0.2):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.3, (7, 64))
    return [(i, [float(np.float32(x)) for x in centres[r.integers(7)] + r.normal(0, spread, 64)]) for i in range(n)]


def wide(rows):
    return [(*r, "x", None, 1) for r in rows]


def test_products_are_exact():
    r = np.random.default_rng(0)
    for low, high in ((-3, 3), (-256, 255), (0, 1), (-(1 << 27), 1 << 27)):
        x, y = r.integers(low, high + 1, (50, 64)), r.integers(low, high + 1, (9, 64)) // 3
        p, q = c.planes(x), c.planes(y)
        assert (c.numbers(p) == x).all() and (c.dots(p, q) == x @ y.T).all() and (c.squares(p) == (x * x).sum(1)).all()
    assert c.planes(np.full((1, 64), -1)).shape[1] == 1 and c.planes(np.zeros((1, 64), np.int64)).shape[1] == 1


def test_matches_brute_force(spark):
    rows = vectors(1, 150)
    rows += [(500 + i, rows[3][1]) for i in range(60)] + [(7, rows[9][1]), (7, rows[10][1]), (None, rows[11][1]), (None, rows[12][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] * 64), (906, [1.0] * 65)]
    rows += [(907, [-0.0] * 64), (908, [1000.25] * 64), (909, [-1 / 512] * 64)]
    assert run(spark, wide(rows)) == brute(rows)
    assert run(spark, wide(rows), k=3, rounds=2) == brute(rows, 3, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(50)], [(i, [float(i // 2)] * 64) for i in range(9)]])
def test_small_tables_and_ties(spark, rows):
    assert run(spark, wide(rows), "double") == brute(rows)


def test_too_large_components(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, wide([(1, [1e9] * 64)]), "double")


def test_matches_sql(spark):
    rows = vectors(2, 120, 0.05) + [(200, None), (201, [float("inf")] * 64)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (vec_id BIGINT, embedding FLOAT[])")
    duck.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert run(spark, wide(rows)) == sorted(duck.sql(c.sql("t")).fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")
def test_whole_table_matches_sql(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW t AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    assert sorted(map(tuple, c.centroid_clusters(df).collect())) == sorted(duck.sql(c.sql("t")).fetchall())

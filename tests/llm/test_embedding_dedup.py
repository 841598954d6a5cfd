import os

import numpy as np
import pytest

from reviewloom.llm import embedding_dedup as e
from tests.conftest import SF_DIR


def brute(rows, cosine=0.9):
    x = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, float) for _, v in rows]
    n = len(rows)
    group, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0], k, least[g], r[0] == least[g]) for r, k, g in zip(rows, links, group)), key=repr)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return sorted(map(tuple, e.embedding_dedup(df, **options).collect()), key=repr)


def test_nearest_lattice_point():
    r = np.random.default_rng(0)
    x = r.normal(0, 2, (300, 8))
    p = e.nearest(x)
    assert ((p * 2) % 1 == 0).all() and (p.sum(1) % 2 == 0).all() and (((p % 1) == (p % 1)[:, :1]).all())
    away = ((x[:, None] - p[:, None] - e.neighbours()) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= away + 1e-9).all() and (((x - p) ** 2).sum(1) <= 1 + 1e-9).all()
    assert len({tuple(v) for v in e.neighbours()}) == 240 and ((e.neighbours() ** 2).sum(1) == 2).all()


@pytest.mark.parametrize("block", [2000, 7])
def test_matches_brute_force(spark, block):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 64))
    rows = [(i, (centres[r.integers(12)] + r.normal(0, r.choice([0.05, 0.2]), 64)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(7, rows[8][1]), (None, rows[9][1]), (None, r.normal(size=64).tolist()), (300, [2.0 * v for v in rows[3][1]])]
    rows += [(400, None), (401, [0.0] * 64), (402, [float("nan")] + [1.0] * 63), (403, [None] + [1.0] * 63), (404, []), (405, [1.0, 2.0]), (406, [1.0, 2.1]), (407, [float("inf")] * 64)]
    assert run(spark, rows, block=block) == brute([(i, None if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows])


def test_empty_table_and_doubles(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1e-200] * 9), (2, [1e200] * 9), (3, [-1.0] * 9)], "double") == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")
def test_recall_on_the_test_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T) >= 0.9).sum(1) - 1
    got = np.array([r["n_links"] for r in e.embedding_dedup(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_plan_follows_the_number_of_vectors():
    r = np.random.default_rng(1)
    unit = r.normal(size=(4000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    plans = {n: e.plan(n, unit, 0.9) for n in (50_000, 5_000_000, 100_000_000)}
    scales, tables, work = zip(*plans.values())
    assert scales[0] > scales[1] > scales[2] and tables[0] < tables[1] < tables[2]
    assert work[2] < 60 * work[0]  # for 2,000 times the vectors
    for scale, t in zip(scales, tables):
        assert 1 - (1 - e.chance(64, 0.9, 8, scale)) ** t >= e.RECALL - 1e-9


@pytest.mark.parametrize("scale,tables", [(0.3, 2), (0.16, 9), (0.12, 24)])
def test_recall_at_several_scales(spark, scale, tables):
    """Pairs at 0.9 to 0.93 among random vectors."""
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=(600, 64))
    z -= (x * z).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = r.uniform(0.9, 0.93, 600)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = e.embedding_dedup(df, scale=scale, tables=tables).groupBy().sum("n_links").first()[0]
    assert got >= 0.98 * 1200

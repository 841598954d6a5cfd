import random
import re

import pytest

from reviewloom.llm import minhash_dedup as m
from reviewloom.llm.components import connected_components


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0], len(s), least[g], r[0] == least[g]) for r, s, g in zip(rows, sets, group)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = m.minhash_dedup(df, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(map(tuple, got), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((3, 5, 40, 90, 160)))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = r.choice(vocabulary).upper()
        rows.append((i, r.choice((" ", "\n", "\t ")).join(w)))
    return rows + [(5, rows[7][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, "all alone"), (900, None), (901, ""), (902, " \n"), (903, " "), (904, "é É")]


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(m, "BLOCK_NODES", 4)
    assert run(spark, rows) == want


def test_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = ["b%d" % r.randrange(5000) for _ in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    kept = m.keep_one(df, percent=85, bands=20)
    assert kept.columns == df.columns
    want = [r[0] for r in brute(rows) if r[3]]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want) - {None})


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (50, 50), (7, 3), (3, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 98 for i in (98, 99, 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []

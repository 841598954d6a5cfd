import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.llm import fingerprints as f


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Sorted by id (null last) and digest; fingerprints by themselves are tested below."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = f.fingerprints(pa.array([t, e, after]))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), *f.likeness([a, a], [b, c]).tolist()))
    return sorted(out, key=repr)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "1 as range", "'x' as sha", "2 as salt")
    return sorted(map(tuple, f.document_fingerprints(df).collect()), key=repr)


def texts(seed, n, longest=400):
    r = random.Random(seed)
    return [" ".join(r.choice(["la", "Le", "été", "水", "x"]) + str(r.randrange(300)) for _ in range(r.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 4])
def test_matches_brute_force(spark, parts):
    t = texts(1, 80)
    rows = list(enumerate(t)) + [(5, t[5]), (5, t[6]), (200, None), (201, ""), (None, t[7]), (None, None), (300, "a b c"), (301, " A  B c\n"), (302, "😀" * 9)]
    assert run(spark, rows, parts) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "one two three four five six seven eight")], [(3, "same text here for all of us")] * 40, [(1, "a"), (2, "b " * 200_000), (3, "c d")]])
def test_odd_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_copies_of_one_row_are_split(spark):
    df = spark.range(20_000).selectExpr("7L as doc_id", "'same text' as text")
    tasks = [len(p) for p in f.with_next(df.repartition(8)).select("doc_id").rdd.glom().collect()]
    assert sum(tasks) == 20_000 and max(tasks) < 10_000


def test_every_bin_is_filled_from_its_own_order():
    values = np.full((3, f.BINS), f._EMPTY)
    values[0, 7] = 5
    values[1, [3, 9, 400]] = 1, 2, 3
    got = f.densify(values)
    assert (got[0] == 5).all() and (got[2] == f._EMPTY).all()
    for i in range(f.BINS):
        order = [int(b) for b in f.orders()[:, i] if b in (3, 9, 400)]
        assert got[1, i] == (values[1, i] if i in (3, 9, 400) else values[1, order[0]])
    assert (np.sort(f.orders(), axis=0) == np.arange(f.BINS)[:, None]).all()


@pytest.mark.parametrize("size", [12, 60, 3000])
def test_likeness_is_close_to_jaccard_and_unbiased(size):
    r = random.Random(size)
    off = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for _ in range(40):
            a = [str(r.random()) for _ in range(size)]
            b = a[: int(size * share)] + [str(r.random()) for _ in range(size - int(size * share))]
            x, y = f.fingerprints(pa.array([" ".join(a), " ".join(b)]))
            off.append(f.likeness([x], [y])[0] - jaccard(" ".join(a), " ".join(b)))
    off = np.array(off).reshape(5, 40)
    assert (np.abs(off[[0, 4]]) < 0.06).all() and (off[4] == 0).all()
    assert (np.abs(off.mean(1)) < (0.05 if size < 20 else 0.02)).all() and off.std() < (0.12 if size < 20 else 0.05)


def test_equal_words_equal_prints():
    a, b, c, d = f.fingerprints(pa.array(["A b  c d e f", "a B c\td e f\n", "", " \n"]))
    assert a == b and len(a) == f.BINS * f.BITS // 8 and c == d == b""
    assert f.likeness([c, a, a], [d, c, b]).tolist() == [1.0, 0.0, 1.0]

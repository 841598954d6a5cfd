import hashlib
import random
from collections import Counter

import pytest

from reviewloom.llm.suffix_dedup import suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, got), key=repr)


def corpus(seed, alphabet="abé \n", n=60):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randint(20, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else word(r.randint(0, 60)) for _ in range(r.randint(0, 6))]
        text = list("".join(parts))
        for _ in range(r.randint(0, 3)):
            if text:
                text[r.randrange(len(text))] = r.choice(alphabet)
        rows.append((i, "".join(text)))
    rows += [(n, rows[3][1]), (n, rows[3][1]), (n, rows[4][1]), (None, rows[5][1]), (None, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, "ab" * 300)]
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [4096, 1])
def test_matches_brute_force(spark, seed, hot):
    rows = corpus(seed)
    assert run(spark, rows, length=24, gram=8, hot=hot) == brute(rows, 24)


def test_whole_texts_at_production_length(spark):
    r = random.Random(9)
    word = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    p = word(700)
    rows = [(i, word(r.randint(0, 900)) + p[r.randint(0, 300) : r.randint(380, 700)] + word(300)) for i in range(40)]
    rows += [(100 + i, p) for i in range(5)] + [(200, word(199)), (201, p[:199])]
    assert run(spark, rows) == brute(rows, 200)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_cuts_whole_characters(spark):
    text = "é" + "xyz" * 100 + "é"
    rows = [(1, "aé" + text), (2, "bè" + text + "ê")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffix_dedup(df, whole_chars=True).collect():
        r["kept"].decode()
        assert r["n_removed"] + len(r["kept"]) == r["n_bytes"]

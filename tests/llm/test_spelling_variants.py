import random
import re
import zlib
from collections import Counter

import pytest

from reviewloom.llm import spelling_variants as s


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    close = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), k, len(close[w]), words.get(form[w])) for w, k in words.items())


def run(spark, rows, extra=False, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", "'x' as word", "1 as n", "2 as key", "3 as sig")
    return sorted(map(tuple, s.spelling_variants(df, **options).collect()))


def corpus(seed, words, texts):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcÀéÿ") for _ in range(r.randrange(5, 10))) for _ in range(words)]

    def word():
        w = stems[min(int(r.expovariate(0.08)), words - 1)]
        if r.random() < 0.4:
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", w[k] + r.choice("abc"), r.choice("abcÿ")]) + w[k + 1 :]
        return w.upper() if r.random() < 0.1 else w

    return [(i, " ".join(word() for _ in range(60)) + r.choice([".", "1", "ŉ"])) for i in range(texts)]


@pytest.mark.parametrize("bucket", [1000, 20, 3])
def test_matches_brute_force(spark, bucket):
    rows = corpus(1, 60, 500)
    want = brute(rows)
    assert len(want) > 300 and any(w[1] for w in want) and any(w[2] != w[1] and w[1] for w in want)
    assert run(spark, rows, bucket=bucket) == want


@pytest.mark.parametrize("bucket", [1000, 25])
def test_one_multiset_of_letters(spark, bucket):
    """Anagrams share every signature."""
    r = random.Random(3)
    words = ["".join(r.sample("aabbccdd", 8)) for _ in range(200)]
    words += [w[:k] + "x" * (k % 2) + w[k + 1 :] for k, w in enumerate(words[:80], 0) if k < 8] + [w[:-1] for w in words[:50]]
    rows = [(i, " ".join(w for w in words for _ in range(1 + i * (hash_of(w) % 3)))) for i in range(5)]
    assert run(spark, rows, bucket=bucket) == brute(rows)


def hash_of(w):
    return zlib.crc32(w.encode())


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (None, ""), (2, "... 12 — ")],
        [(None, "Beispiel " * 7 + "beispie beispiell ÉÉÉÉÉÉ " * 6)] * 2 + [(1, "beispiel×÷ÀÿÀÿ " * 5)] * 3,
        [(7, "straßen strasen STRASSEN Straßen " * 5)] * 4,
        [(9, "a" * 5 + " " + "b" * 3000 + " " + ("c" * 300 + " ") * 5 + ("c" * 299 + " ") * 30)],
    ],
)
def test_odd_rows(spark, rows):
    assert run(spark, rows, extra=True) == brute(rows)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 50)
    text = "abcdefgh ijklmnop, " * 40 + "q" * 200 + " rstuvwxyz"
    assert [w for piece in s.runs(text) for w in piece] == re.findall("[a-z]{6,}", text)


def test_signatures_never_miss():
    import numpy as np

    r = random.Random(5)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(6, 12))) for _ in range(400)]
    other = []
    for w in words:
        k = r.randrange(len(w))
        other.append(w[:k] + r.choice(["", w[k] + "b", "z"]) + w[k + 1 :])
    a, b = (s.signatures(s.part_sums(*s.letters_of(x))) for x in (words, other))
    assert (a == b).any(1).all()
    codes, at = s.letters_of(words + other)
    i = np.arange(400)
    assert s.one_edit(codes, at, i, i + 400).tolist() == [near(x, y) for x, y in zip(words, other)]

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.llm import toxicity as t
from reviewloom.llm.language_id import remainder
from tests.conftest import SF_DIR


def corpus(n=700):
    r = random.Random(4)
    syllables = ["ka", "lo", "mi", "ter", "un", "ple", "so", "dra", "vi", "en"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 40):
                w.insert(r.randrange(len(w)), "grobf" + r.choice(syllables) + r.choice(["", "s", "e1"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_unseen_endings_and_odd_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(9000, None), (9001, ""), (9002, "..."), (9003, "xx GROBFzz yy"), (None, "ka lo"), (9004, "ka " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (9001, None), (77777, 1)], "doc_id long, toxic int")
    got = t.toxicity(docs, labels).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(by[i]["predicted"], y) for i, _, y in rows if by[i]["held_out"]]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.95
    assert [by[i]["predicted"] for i in (9000, 9001, 9002, 9003, 9004)] == [0, 0, 0, 1, 0]


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in t.toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert t.toxicity(docs.where("false"), labels.where("false")).collect() == []


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(t.toxicity(docs, labels).collect()) == sorted(t.toxicity(docs, turned).collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")
def test_held_out_accuracy(spark):
    at = SF_DIR.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    rows = t.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert len(rows) > 500 and sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.05


def test_long_tail_of_toxic_words():
    """300 toxic words, each in under 1 % of the 1,500 toxic texts of a full sample."""
    r = random.Random(4)
    syllables = [a + b for a in "bcdfghjklmnprstvwz" for b in ("a", "e", "i", "o", "u", "an", "er", "is", "ol")]
    clean = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(6000)]
    toxic = ["".join(r.choice("bcdfghklmnprstvwxyzaeiou") for _ in range(r.randint(6, 9))) for _ in range(300)]
    rows = []
    for i in range(4000):
        w = [clean[int(len(clean) * r.random() ** 2)] for _ in range(r.randint(10, 60))]
        for x in r.sample(toxic, 2) if i % 2 else []:
            w.insert(r.randrange(len(w) + 1), x)
        rows.append((" ".join(w), i % 2))
    used = [set(x.split()) for x, y in rows[:3000] if y]
    assert len(used) == 1500 and np.mean([sum(x in u for u in used) < 15 for x in toxic]) > 0.9
    table, scale, shift = t.train([x for x, _ in rows[:3000]], [y for _, y in rows[:3000]], 0.5)
    flagged = scale * t.worst_window(table, pa.array([x for x, _ in rows[3000:]])) + shift >= 0
    truth = np.array([y for _, y in rows[3000:]]) > 0
    assert flagged[truth].mean() > 0.9 and flagged[~truth].mean() < 0.1

import itertools
import os

import numpy as np
import pytest

from reviewloom.llm.language_id import keep_identified, language_id, learn, predict, viterbi
from tests.conftest import SF_DIR


def test_viterbi_matches_all_paths():
    r = np.random.default_rng(1)
    sizes = [0, 3, 1, 5, 0, 4]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = r.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
    got = viterbi(scores, offsets, 2.0)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if a == b:
            continue
        value = lambda path: sum(scores[a + i, p] for i, p in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert abs(value(best) - value(got[a:b])) < 1e-3


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/documents.parquet")
    rows = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


EN, RU, FR = "the quick brown fox jumps over the lazy dog and then ", "съешь ещё этих мягких французских булок да выпей ", "le chat noir est sous la table avec une souris et puis "


def labelled(spark):
    return spark.createDataFrame([(t * 3, g) for t, g in ((EN, "en"), (RU, "ru"), (FR, "fr"))] * 4 + [(None, "en"), ("x", None)], "text string, lang string")


def test_spans_and_odd_texts(spark):
    model = learn(labelled(spark))
    texts = [None, "", "12 !?", EN + FR, RU + EN, "the dog", "ещё", "日本", "\U0001d400\U0001d401 the fox", "été " + FR, EN * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "score long, text string").withColumnRenamed("score", "doc_id")
    got = {r["doc_id"]: r for r in predict(docs, model, spans=True).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[0]["spans"] == []
    assert [s["lang"] for s in got[3]["spans"]] == ["en", "fr"]
    assert [s["lang"] for s in got[4]["spans"]] == ["ru", "en"] and got[4]["spans"][1]["start"] == len(RU)
    assert (got[5]["lang_pred"], got[6]["lang_pred"], got[10]["lang_pred"], got[10]["score"]) == ("en", "ru", "en", 1.0)
    assert got[9]["lang_pred"] == "fr" and got[7]["lang_pred"] in ("en", "fr", "ru")


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None), (None, None, None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id(docs).collect()] == ["und", "und"]
    assert language_id(docs.where("false")).collect() == []
    assert [r["doc_id"] for r in keep_identified(docs).collect()] == [1]  # nothing to learn from: texts with letters stay


def test_thousands_of_tags_are_refused_with_a_message(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'some text' as text", "concat('x', id) as lang")
    with pytest.raises(ValueError, match="map the tags"):
        language_id(docs)


def test_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, g, "s", len(t), 7) for i, (t, g) in enumerate(((EN, "en"), (FR, "fr"), ("42", "en")) * 5)],
                                 "doc_id long, text string, lang string, source string, lang_pred long, row int")
    got = keep_identified(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] % 3 for r in got.collect()) == [0] * 5 + [1] * 5


def plain(rows, penalty=6.0):
    """Scores by the definition, one word and one path at a time: (id, lang_pred, score)."""
    import math
    import unicodedata
    from bisect import bisect_right
    from collections import Counter, defaultdict

    from reviewloom.llm.language_id import RANGES

    def words(text):
        kinds = [unicodedata.category(c)[0] for c in text]
        out, run = [], ""
        for c, k in [*zip(text, kinds), (" ", "Z")]:
            if k in "LM":
                run += c.lower() if len(c.lower()) == 1 else c
            elif run:
                out += [run] if any(unicodedata.category(x)[0] == "L" for x in run) else []
                run = ""
        return out

    def buckets(word):
        codes = [0, *map(ord, word), 0]
        for n in (2, 3, 4):
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = (h * 0x9FB21C651E98DF25 + c) % 2**64
                yield (h * 0xD6E8FEB86659FD93 % 2**64) >> 48

    def script(c):
        return RANGES[bisect_right([a for a, _ in RANGES], ord(c)) - 1][1]

    grams, scripts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            grams[lang], scripts[lang]
            for w in words(text):
                grams[lang].update(buckets(w))
                scripts[lang].update(map(script, w))
    langs = sorted(grams)
    uses = {s: [g for g in langs if scripts[g][s] >= 0.01 * max(1, sum(scripts[g].values()))] or langs for s in {s for _, s in RANGES}}
    for i, text, _ in rows:
        state, ws = None, words(text or "")
        for w in ws:
            own = {g: sum(math.log(0.99 * grams[g][b] / max(1, sum(grams[g].values())) + 0.01 / 65536) for b in buckets(w)) - 1e6 * (g not in uses[script(w[0])]) for g in langs}
            if state is None:
                state = {g: (own[g], [g]) for g in langs}
            else:
                state = {g: max(((state[f][0] - penalty * (f != g) + own[g], [*state[f][1], g]) for f in langs), key=lambda x: x[0]) for g in langs}
        if not ws:
            yield i, "und", 0.0
            continue
        letters = Counter()
        for g, w in zip(max(state.values(), key=lambda x: x[0])[1], ws):
            letters[g] += len(w)
        best = min(letters, key=lambda g: (-letters[g], g))
        yield i, best, letters[best] / sum(letters.values())


def test_scores_by_the_definition(spark):
    import random

    r = random.Random(7)
    pools = {"en": EN.split(), "fr": FR.split(), "ru": "быстрая коричневая лиса прыгает через ленивую собаку".split(), "x": ["ŉé́", "Ǆa", "水火", "42", "—", "ab́c"]}
    rows = []
    for i in range(60):
        text = " ".join(r.choice(pools[r.choice([*pools, "en"]) if r.random() < 0.3 else ("en", "fr", "ru")[i % 3]]) for _ in range(r.randrange(25)))
        rows.append((i, text, r.choice([("en", "fr", "ru")[i % 3], None])))
    rows += [(100, None, "en"), (101, "42 — 7", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in predict(df.select("doc_id", "text"), learn(df)).collect()}
    for i, lang, score in plain(rows):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score)

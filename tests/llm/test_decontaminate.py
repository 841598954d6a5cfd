import random
import re
from collections import Counter

import pytest

from reviewloom.llm.decontaminate import decontaminate, find_contamination


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, least=0.8):
    out = {}
    for d, (_, text) in enumerate(docs):
        w = split(text)
        for item, passage in items:
            q = split(passage)
            want, best = bag(q), 0.0
            for s in range(max(1, len(w) - len(q) + 1)):
                part = w[s : s + len(q)]
                # a window has the item's shingle size
                have = bag(part) if len(q) >= 5 else Counter([tuple(part)] if len(part) == len(q) else [])
                if len(part) < 5 <= len(q):
                    continue
                both = sum((want & have).values())
                best = max(best, both / max(1, sum((want | have).values())))
            if q and best >= least:
                out[d, item] = round(best, 9)
    return out


def run(spark, docs, items, **options):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "n long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["n"], h["item_id"]): round(h["similarity"], 9) for r in find_contamination(df, b, **options).collect() for h in r["hits"]}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("part_bytes", [1 << 24, 900])
def test_matches_brute_force(spark, seed, part_bytes):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(9))
    items = [(i, " ".join(word() for _ in range(r.choice((2, 4, 5, 9, 20, 33, 33, 59))))) for i in range(24)]
    items += [(90, items[5][1]), (91, None), (92, " "), (93, "la " * 30)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(4)):
            parts += [word() for _ in range(r.randrange(40))]
            q = split(r.choice(items)[1])
            for _ in range(r.choice((0, 0, 0, 1, 1, 2, 4))):
                if q:
                    spot = r.randrange(len(q))
                    q[spot : spot + r.randrange(2)] = [word()] * r.randrange(2)
            parts += q
        docs.append((i, "\n ".join(parts).upper() if i % 2 else " ".join(parts)))
    docs += [(0, None), (0, ""), (1, " ".join(items[4][1].split()[1:])), (2, "la " * 400), (2, "la " * 400)]
    assert run(spark, docs, items, part_bytes=part_bytes) == brute(docs, items)


def test_empty_sides_and_kept_columns(spark):
    item = " ".join(map(str, range(30)))
    assert run(spark, [(0, item)], []) == {} and run(spark, [], [(1, item)]) == {}
    docs = spark.createDataFrame([(1, "x " + item, 5), (2, "clean", 6), (3, None, None)], "doc_id long, text string, hits long")
    kept = decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "clean", 6), (3, None, None)]


def test_many_copies_of_one_item_and_parts_of_bounded_size(spark):
    from reviewloom.llm.decontaminate import _parts

    item = " ".join(map(str, range(30)))
    rows = [(1, item)] * 10_000 + [(i, f"{i} {item} {i}") for i in range(2, 40)] + [(99, "long " * 900)]
    items = spark.createDataFrame(rows, "item_id long, text string").distinct()
    parts = [items.where(cut).collect() for cut in _parts(items, 1000)]
    assert sorted(r for p in parts for r in p) == sorted(set(rows)) and len(parts) < 16
    assert all(len(p) == 1 or sum(len(r["text"]) + 16 for r in p) <= 1000 for p in parts)
    docs = [(0, item), (1, "clean"), (2, f"x {item}")]
    assert run(spark, docs, rows, part_bytes=1000) == brute(docs, list(dict.fromkeys(rows)))

"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy (operator 3).

A word (run of letters and numbers) is the mean of its character n-grams' vectors, a window of ``WINDOW`` words the mean of
its words; two softmax logits are linear in that mean. Vectors and weights are trained together, so misspellings and
endings never seen share the n-grams of those seen. A text's score is that of its worst window, calibrated on the
training texts: a few words do not drown in a long text. Training starts with every window of a toxic text as toxic;
then only windows that the model finds toxic, and each toxic text's worst one, remain so. Vectors of n-grams seen n times count
n / (n + ``RARE``); only those in fewer than ``LEAST`` words, whatever the sample, have no weight.

Training uses at most ``SAMPLE`` texts of each class and half of ``SAMPLE_BYTES`` of text for each, chosen by a hash of ``doc_id``;
a text that does not fit what is left of that, such as one of over 6 MiB, is no training text. Scoring reads all of every text, without a shuffle: the model is a
vector of ``1 << BITS`` numbers. Null texts and texts without a word have score 0; with no labels of both classes every
score is 0. A document labelled twice counts as toxic if one label says so.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.language_id import remainder
from reviewloom.llm.text import grams, letter_runs

BITS, ORDERS, WINDOW, DIMENSIONS = 17, (3, 4, 5), 6, 6
SAMPLE, SAMPLE_BYTES, ROUNDS, STEPS, RATE, LEAST, RARE = 1500, 12 << 20, 3, 25, 0.1, 2, 10


def _word_grams(part) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every word, edges included."""
    place = np.zeros(len(part.codes) + 1, np.int32)
    place[part.starts - 1] = 1
    word = np.cumsum(place[:-1]) - 1
    inside = np.zeros(len(part.codes) + 1, np.int8)
    inside[part.starts - 1] += 1
    inside[part.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    words, buckets = [], []
    for n in ORDERS:
        bucket, inner = grams(part.codes, n, BITS)
        keep = np.flatnonzero(inner & inside)
        words.append(word[keep])
        buckets.append(bucket[keep])
    return np.concatenate(words), np.concatenate(buckets)


class Bags:
    """Sums over segments and their transpose, for means forward and gradients backward."""

    def __init__(self, owner: np.ndarray, member: np.ndarray, owners: int, members: int):
        order = np.argsort(owner, kind="stable")
        self.forward = member[order], *self._cuts(owner[order])
        order = np.argsort(member, kind="stable")
        self.backward = owner[order], *self._cuts(member[order])
        self.sizes = np.maximum(np.bincount(owner, minlength=owners), 1).astype(np.float32)[:, None]
        self.owners, self.members = owners, members

    @staticmethod
    def _cuts(sorted_ids):
        cuts = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1])) if len(sorted_ids) else np.zeros(0, int)
        return cuts, sorted_ids[cuts]

    @staticmethod
    def _sum(x, side, n):
        index, cuts, ids = side
        out = np.zeros((n, x.shape[1]), np.float32)
        step = 1 << 13
        for at in range(0, len(cuts), step):
            part = cuts[at : at + step]
            end = cuts[at + step] if at + step < len(cuts) else len(index)
            out[ids[at : at + step]] = np.add.reduceat(x[index[part[0] : end]], part - part[0], axis=0)
        return out

    def mean(self, x):
        return self._sum(x, self.forward, self.owners) / self.sizes

    def spread(self, gradient):
        return self._sum(gradient / self.sizes, self.backward, self.members)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, by Newton's method with a little shrinkage."""
    scale, mean = max(float(x.std()), 1e-6), float(x.mean())
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) + 1e-2 * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return w[0] / scale, w[1] - w[0] * mean / scale


def train(texts: list[str], labels: list[int], prior: float, seed: int = 5) -> tuple[np.ndarray, float, float] | None:
    """Weight per n-gram bucket, and scale and shift from a text's worst window to its logit (None without both classes).

    ``prior``: share of toxic texts among all labelled ones; the sample is weighted to it for the calibration.
    """
    y = np.asarray(labels, np.float32)
    vocabulary: dict[bytes, int] = {}
    ids, doc_of = [], []
    for part in letter_runs(pa.array(texts, pa.string()), numbers=True):
        raw = part.codes.astype(np.uint32)
        ids.append(np.array([vocabulary.setdefault(raw[a:b].tobytes(), len(vocabulary)) for a, b in zip(part.starts.tolist(), part.ends.tolist())], np.int32))
        doc_of.append((part.first + np.repeat(np.arange(part.n), np.diff(part.docs))).astype(np.int32))
    if not vocabulary or len(set(labels)) < 2:
        return None
    ids, doc_of = np.concatenate(ids), np.concatenate(doc_of)
    known = pa.array(["".join(map(chr, np.frombuffer(w, np.uint32))) for w in vocabulary], pa.string())
    del vocabulary
    word, bucket = [], []
    for part in letter_runs(known, numbers=True):
        row = np.searchsorted(part.at, part.starts, side="right") - 1
        of, found = _word_grams(part)
        word.append((part.first + row[of]).astype(np.int32))
        bucket.append(found.astype(np.int32))
    word = np.concatenate(word)
    bucket = np.concatenate(bucket)
    used = np.unique(bucket)
    bucket = np.searchsorted(used, bucket).astype(np.int32)
    subwords = Bags(word, bucket, len(known), len(used))
    nth = np.arange(len(ids)) - np.searchsorted(doc_of, doc_of)  # place of the word in its text
    fresh = (nth % WINDOW == 0)
    window = np.cumsum(fresh) - 1
    of_window = doc_of[fresh]
    bags = Bags(window, ids, int(window[-1]) + 1, len(known))
    r = np.random.default_rng(seed)
    # N-grams in fewer words of the sample than LEAST stay at zero, like those never seen; others shrink the more the rarer they are.
    times = np.bincount(bucket, weights=np.bincount(ids, minlength=len(known))[word], minlength=len(used))
    trust = np.where(times >= LEAST, times / (times + RARE), 0).astype(np.float32)[:, None]
    vectors = r.normal(0, 0.02, (len(used), DIMENSIONS)).astype(np.float32)
    heads = r.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    values = [vectors, heads, bias]
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    target = y[of_window]
    step = 0
    for turn in range(ROUNDS):
        positive = target.sum()
        weight = np.where(target > 0, 0.5 / max(positive, 1), 0.5 / max(len(target) - positive, 1)).astype(np.float32)
        for _ in range(STEPS):
            step += 1
            mean = bags.mean(subwords.mean(vectors * trust))
            logits = mean @ heads + bias
            p = _sigmoid(logits[:, 1] - logits[:, 0]).astype(np.float32)
            error = ((p - target) * weight)[:, None] * np.array([[-1, 1]], np.float32)
            gradients = [subwords.spread(bags.spread(error @ heads.T)) * trust, mean.T @ error, error.sum(0)]
            for value, gradient, (m, v) in zip(values, gradients, moments):
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient**2 - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        logit = (bags.mean(subwords.mean(vectors * trust)) @ heads + bias) @ np.array([-1, 1], np.float32)
        worst = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(worst, of_window, logit)
        # A window of a toxic text stays toxic if it stands out from those of clean texts, or is the text's worst.
        clean = logit[y[of_window] == 0]
        bar = np.quantile(clean, 0.999) if len(clean) else 0.0
        target = ((y[of_window] > 0) & ((logit > bar) | (logit == worst[of_window]))).astype(np.float32)
    table = np.zeros(1 << BITS, np.float32)
    table[used] = (vectors * trust) @ heads @ np.array([-1, 1], np.float32)
    score = worst_window(table, pa.array(texts, pa.string()))
    fine = np.isfinite(score)
    share = y[fine].mean()
    weight = np.where(y[fine] > 0, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    return table, *_fit_line(score[fine], y[fine].astype(float), weight)


def worst_window(table: np.ndarray, column: pa.Array) -> np.ndarray:
    """Per row the largest mean, over WINDOW words in a row (all words of a shorter text), of its words' weights."""
    out = np.full(len(column), -np.inf)
    for part in letter_runs(column, numbers=True):
        if not len(part.starts):
            continue
        total = np.zeros(len(part.codes))
        count = np.zeros(len(part.codes), np.float32)
        for n in ORDERS:
            bucket, inner = grams(part.codes, n, BITS)
            total += np.where(inner, table[bucket], 0)
            count += inner
        cuts = np.stack([part.starts - 1, part.ends], axis=1).ravel()
        word = np.add.reduceat(total, cuts)[::2] / np.maximum(np.add.reduceat(count, cuts)[::2], 1)
        run = np.concatenate([[0], np.cumsum(word)])
        low, high = part.docs[:-1], part.docs[1:]
        n = high - low
        size = np.minimum(n, WINDOW)
        windows = np.where(n > 0, n - size + 1, 0)
        row = np.repeat(np.arange(part.n), windows)
        at = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        mean = (run[at + size[row]] - run[at]) / size[row]
        some = np.flatnonzero(windows)
        out[part.first + some] = np.maximum.reduceat(mean, (np.cumsum(windows) - windows)[some])
    return out


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """Train on the sample of labelled rows outside the held-out fold."""
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = docs.where("text is not null").select("doc_id", F.octet_length("text").alias("size")).where(F.col("size") > 0)
    rows = sized.join(given, "doc_id").where(remainder(F.col("doc_id"), folds) != held_out)
    counts = {bool(r["toxic"]): r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    if len(counts) < 2:
        return None
    chosen: list[tuple[int, int]] = []
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    for toxic in (True, False):
        few = rows.where((F.col("toxic") > 0) == toxic).where(F.col("size") <= sample_bytes // 2).orderBy(order, "doc_id").limit(sample)
        left = sample_bytes // 2
        for r in few.select("doc_id", "size").collect():  # at most ``sample`` rows
            if r["size"] <= left:
                left -= r["size"]
                chosen.append((r["doc_id"], int(toxic)))
    if len({y for _, y in chosen}) < 2:
        return None
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int").dropDuplicates(["doc_id"])
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").collect()
    found.sort()
    return train([r["text"] for r in found], [r["toxic"] for r in found], counts[True] / sum(counts.values()))


def _score(model, columns):
    table, scale, shift = model

    def run(batches):
        for batch in batches:
            worst = worst_window(table, batch.column("text"))
            score = np.where(np.isfinite(worst), _sigmoid(scale * np.where(np.isfinite(worst), worst, 0) + shift), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(score)], [*columns, "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """The columns of ``docs`` but text, then score (0 to 1)."""
    columns = [c for c in docs.columns if c != "text"]
    names = [F.col(f"`{c}`") for c in columns]
    if model is None:
        return docs.select(*names, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        yield from _score(shared.value, columns)(batches)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*names, "text").mapInArrow(run, f"{fields}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **bounds) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, folds, held_out, **bounds)
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return score(rows, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

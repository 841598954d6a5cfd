"""Spelling variants grouped by exact PartEnum signatures over letter multisets (operator 11).

1. Words are the maximal runs of letters of at least six code points with A-Z lowered; of one run in 199, chosen by the CRC-32 of
   its document and itself, one code point is deleted. Tasks count their words, Spark adds the counts up and keeps words with
   at least ``least`` occurrences.
2. A word's letters as a set of (letter, how often it came before): a binary vector. One insertion or deletion changes one of its
   dimensions, one replacement two, so near words have Hamming distance at most two.
3. Partition and enumerate: dimensions fall into ``PARTS`` parts by a fixed hash; for each pair of parts a word's signature is the
   hash of its dimensions in all other parts. Two words at distance at most two differ in at most two parts, so they share
   the signature that leaves these out: no pair is missed.
4. Words meet by signature, in tasks. Of those, only words that agree in their first or in their last three letters can be one
   edit apart (they have six or more); these are verified letter by letter. A pair is reported at one of its common
   signatures only. No candidate pair is written.
5. A signature with more than ``bucket`` words is split further, exactly: one edit leaves the first or the second half of a word
   as it is, so its words meet by half; what is still larger is compared in blocks.

Texts that are null or empty have no words. A null ``doc_id`` counts as an empty one. Rows may repeat: each counts. Other columns
are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.scratch import stage
from reviewloom.llm.text import mix

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, EVERY, TIMES = 6, 5, 199, 5
PARTS, BUCKET = 7, 1000
PAIRS = 1 << 19  # compared at once
PIECE = 1 << 20  # characters of a text searched at once
HELD = 200_000  # words a task counts before it hands them on

_U = np.uint64
_LOWER = {c: c + 32 for c in range(65, 91)}
_RUN, _OTHER = re.compile(LETTERS + "{%d,}" % SHORTEST), re.compile(LETTERS.replace("[", "[^"))
LEFT_OUT = np.array(list(itertools.combinations(range(PARTS), 2)))


def runs(text: str) -> Iterator[list[str]]:
    """Maximal runs of at least six letters, cut between runs into pieces of about ``PIECE`` characters."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            after = _OTHER.search(text, at + PIECE)
            end = after.end() if after else end
        yield _RUN.findall(text, at, end)
        at = end


def misspell(run: str, seed: int) -> str:
    """``run`` in lower case; one of ``EVERY`` loses a code point. ``seed``: CRC-32 of the document's part of the name."""
    if not run.islower():
        run = run.translate(_LOWER)
    h = zlib.crc32(run.encode(), seed)
    return run if h % EVERY else run[: (k := h % len(run))] + run[k + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()

    def drain():
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
        words.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text")):
            seed = zlib.crc32(f"{key.as_py()}:".encode())
            for piece in runs(text.as_py()):
                for run, n in Counter(piece).items():
                    word = misspell(run, seed)
                    if len(word) >= SHORTEST:
                        words[word] += n
                if len(words) > HELD:
                    yield drain()
    if words:
        yield drain()


def count_words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): every word with at least ``least`` occurrences in ``docs`` (doc_id, text)."""
    texts = docs.where("text <> ''").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- signatures ------------------------------------------------------------------------------


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word begins (n + 1 offsets)."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), at


def part_sums(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per word and part, the sum of the hashes of its dimensions there (modulo 2 ** 64): equal multisets, equal sums."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((codes, word))
    w, c = word[order], codes[order]
    new = np.ones(len(c), bool)
    new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(new)
    before = np.arange(len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))
    dimension = (c << 20 | before).astype(np.uint64)
    out = np.zeros((len(at) - 1, PARTS), np.uint64)
    np.add.at(out, (w, (mix(dimension + _U(0x51ED27)) % _U(PARTS)).astype(np.int64)), mix(dimension + _U(0x9E3779B97F4A7C15)))
    return out


def signatures(sums: np.ndarray) -> np.ndarray:
    """Words x pairs of parts left out."""
    a, b = LEFT_OUT.T
    rest = sums.sum(1, keepdims=True) - sums[:, a] - sums[:, b]
    return mix(rest * _U(2 * len(LEFT_OUT) + 1) + np.arange(len(LEFT_OUT), dtype=np.uint64)).view(np.int64)


def _sign(with_words: bool):
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                found = signatures(part_sums(*letters_of(part.column("word").to_pylist())))
                if not with_words:
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel())], ["sig"])
                    continue
                again = pa.array(np.repeat(np.arange(len(part)), found.shape[1]))
                which = np.tile(np.arange(found.shape[1], dtype=np.int32), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(which), part.column("word").take(again), part.column("n").take(again)], ["sig", "which", "word", "n"])

    return run


def _halves(words: DataFrame) -> DataFrame:
    """Words of a large signature by half. Near words of least length t agree in their first or last t // 2 letters; ``half`` is t
    for the first, -t for the last."""
    t = F.explode(F.array(F.length("word"), F.length("word") - 1))
    two = words.withColumn("t", t).withColumn("half", F.explode(F.array("t", -F.col("t"))))
    size = F.floor(F.abs("half") / 2).cast("int")
    part = F.when(F.col("half") > 0, F.left("word", size)).otherwise(F.right("word", size))
    return two.withColumn("sig", F.xxhash64("sig", "half", part)).drop("t")


# ---- verification ----------------------------------------------------------------------------


def one_edit(codes: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] differ by exactly one inserted, deleted or replaced code point."""
    size = np.diff(at)
    swap = size[a] > size[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    m, more = size[short], size[long] - size[short]
    width = int(m.max(initial=0))
    same_front, same_back = np.ones(len(a), bool), np.ones(len(a), bool)
    front, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    last = len(codes) - 1
    for k in range(width):
        inside = k < m
        same_front &= inside & (codes[np.minimum(at[short] + k, last)] == codes[np.minimum(at[long] + k, last)])
        same_back &= inside & (codes[np.maximum(at[short + 1] - 1 - k, 0)] == codes[np.maximum(at[long + 1] - 1 - k, 0)])
        front += same_front
        back += same_back
        if not (same_front | same_back).any():
            break
    return np.where(more == 0, front + back == m - 1, (more == 1) & (front + back >= m))


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in runs of equal values, about ``PAIRS`` at once."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(group)))
    left = np.repeat(begin + sizes, sizes) - np.arange(len(group)) - 1  # partners that follow
    done = np.cumsum(left)
    start = 0
    while start < len(group):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + PAIRS, side="right")))
        n = left[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def _near(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words among rows (key, meta, word, n) of whole groups, in order of key."""
    words = rows.column("word").to_pylist()
    key, meta = rows.column("key").to_numpy(), rows.column("meta").to_numpy()
    codes, at = letters_of(words)
    front = codes[at[:-1]] << 42 | codes[at[:-1] + 1] << 21 | codes[at[:-1] + 2]
    back = codes[at[1:] - 1] << 42 | codes[at[1:] - 2] << 21 | codes[at[1:] - 3]
    size = np.diff(at)
    which, half, cross, side = meta & 255, meta >> 10, meta & 256 > 0, meta & 512 > 0
    found = []
    for end, other in ((front, None), (back, front)):
        group = mix(key.astype(np.int64).view(np.uint64) + mix(end.astype(np.uint64)))
        order = np.argsort(group, kind="stable")
        for a, b in _pairs(group[order]):
            a, b = order[a], order[b]
            ok = (np.abs(size[a] - size[b]) <= 1) & (key[a] == key[b]) & (end[a] == end[b]) & (~cross[a] | (side[a] != side[b]))
            if other is not None:
                ok &= other[a] != other[b]
            ok &= (half[a] == 0) | (np.abs(half[a]) == np.minimum(size[a], size[b]))
            a, b = a[ok], b[ok]
            ok = one_edit(codes, at, a, b) if len(a) else np.zeros(0, bool)
            found.append((a[ok], b[ok]))
    a, b = (np.concatenate(x) for x in zip(*found))
    if not len(a):
        return
    # One report a pair: at the first pair of parts that holds all parts it differs in, in the first halves if they agree.
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    sums = part_sums(*letters_of([words[i] for i in used.tolist()]))
    differs = sums[place[: len(a)]] != sums[place[len(a) :]]
    covers = np.zeros((len(a), len(LEFT_OUT)), bool)
    for k, (p, q) in enumerate(LEFT_OUT.tolist()):
        covers[:, k] = differs.sum(1) == differs[:, p].astype(int) + differs[:, q]
    first = covers.argmax(1) == which[a]
    again = [half[i] < 0 and words[i][: -half[i] // 2] == words[j][: -half[i] // 2] for i, j in zip(a.tolist(), b.tolist())]
    first &= ~np.array(again, bool)
    a, b = pa.array(np.concatenate([a[first], b[first]])), pa.array(np.concatenate([b[first], a[first]]))
    word, n = rows.column("word"), rows.column("n")
    out = pa.table([word.take(a), n.take(a), word.take(b), n.take(b)], ["word", "n", "near", "near_n"])
    yield from out.combine_chunks().to_batches()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key").to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1])
        open_key = held[-1].column("key")[-1].as_py() if held else None
        if not len(change) and (open_key is None or open_key == key[0]):
            held.append(batch)
            continue
        cut = int(change[-1]) + 1 if len(change) else 0
        whole = [*held, batch.slice(0, cut)] if cut else held
        yield from _near(pa.Table.from_batches(whole).combine_chunks())
        held = [batch.slice(cut)]
    if held:
        yield from _near(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, n, near, near_n): both directions of each pair of near words among distinct ``words`` (word, n)."""
    sizes = words.select("word").mapInArrow(_sign(False), "sig long").groupBy("sig").count()
    large = stage(sizes.where(F.col("count") > bucket).select("sig"), "large-signatures")
    signed = words.select("word", "n").mapInArrow(_sign(True), "sig long, which int, word string, n long")
    plain = signed.join(large, "sig", "left_anti").select(F.col("sig").alias("key"), F.col("which").alias("meta"), "word", "n")

    halves = stage(_halves(signed.join(large, "sig", "left_semi")), "word-halves")
    blocks = halves.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    blocks = stage(blocks.select("sig", F.ceil(F.col("size") / bucket).cast("int").alias("blocks")), "half-sizes")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = halves.join(blocks, "sig").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cross, side = F.when(F.col("own") != F.col("other"), 256).otherwise(0), F.when(F.col("own") > F.col("other"), 512).otherwise(0)
    dealt = dealt.select(
        F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("key"), (F.col("which") + cross + side + F.col("half") * 1024).cast("int").alias("meta"), "word", "n"
    )
    met = plain.unionByName(dealt).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_meet, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), each form a more frequent word: chains are followed by doubling, so few rounds do."""
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, bucket: int = BUCKET) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    ``form``: the near word of largest count, ties by code points, if it has at least ``times`` the word's count, else null.
    ``root``: the last of the forms that follow, the word itself if none.
    """
    words = stage(count_words(docs, least), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    near = near_words(words, bucket).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    wins = -F.col("best.minus") >= times * F.col("n")
    formed = stage(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.minus")).alias("form_n")),
        "word-forms",
    )
    out = formed.join(roots(formed.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

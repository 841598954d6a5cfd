"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 6).

Every window of a text that has as many words as a benchmark item (a shorter text: the whole of it) gets a 64-bit SimHash
of its five-word shingles, taken as a bag. Eight one-byte blocks index the items of each length: two fingerprints within
``RADIUS`` bits differ by at most ``RADIUS // 8`` bits in one block at least, so looking up each block with that tolerance
finds all items within the radius. Candidates are decided exactly: sum of smaller over sum of larger shingle weights
(their counts in window and item) of ``similarity`` or more. A window with no shingle of any item has similarity 0 and gets
no fingerprint. At similarity 0.8 fingerprints differ by 9.7 bits on average (deviation 2.9): the radius is 4.6 deviations off.

The benchmark is the stated query set. Repeated rows of it are dropped, the rest is cut into parts of at most ``PART_BYTES`` of
text (one longer item is a part), each collected, broadcast and held against all documents in one pass without a shuffle. With
several parts there is one at a time: documents are stored with a number, each pass writes its hits alone, and hits
are joined in the end. Words are lower-cased (A-Z). Null or blank texts and items match nothing; items of
fewer than five words are one shingle; repeated items are all reported; ties and repeated rows are decided row by row; an
empty benchmark or table gives no hits.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.scratch import stage
from reviewloom.llm.text import mix, runs_hash, slabs, word_hashes, words

SIZE, SIMILARITY, RADIUS, PART_BYTES = 5, 0.8, 23, 16 << 20
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_HITS = "array<struct<item_id:long,start:long,similarity:double>>"


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 signed sums -> 64-bit fingerprints as eight bytes."""
    return np.packbits(sums > 0, axis=1)


def _votes(found: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    return np.unpackbits(mix(found).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def weighted_similarity(x: np.ndarray, values: np.ndarray, counts: np.ndarray) -> float:
    """Of two bags: sum of smaller over sum of larger counts; the second bag as sorted values and counts."""
    own, n = np.unique(x, return_counts=True)
    at = np.searchsorted(values, own)
    at[at == len(values)] = 0
    both = int(np.minimum(n, counts[at])[values[at] == own].sum())
    return both / (len(x) + int(counts.sum()) - both)


class Index:
    """Items of one part of the benchmark by their number of words, at most 64 to a table."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.tables: dict[int, list] = {}
        texts = pa.array([t for _, t in rows], pa.string())
        by_size: dict[int, list] = {}
        for slab in slabs(texts):
            w = words(slab)
            hashes = word_hashes(slab, w)
            for i, (a, b) in enumerate(zip(w.docs[:-1].tolist(), w.docs[1:].tolist())):
                if b > a:
                    by_size.setdefault(b - a, []).append((rows[slab.first + i][0], runs_hash(hashes[a:b], min(SIZE, b - a))))
        near = [np.flatnonzero(_BITS[np.arange(256) ^ v] <= RADIUS // 8) for v in range(256)]
        known = []
        for size, items in by_size.items():
            for at in range(0, len(items), 64):
                part = items[at : at + 64]
                table = np.zeros((8, 256), np.uint64)
                prints = np.stack([fingerprint(_votes(s).sum(0, dtype=np.int32)[None])[0] for _, s in part])
                for k, p in enumerate(prints):
                    for block in range(8):
                        table[block, near[p[block]]] |= np.uint64(1 << k)
                bags = [(item, *np.unique(s, return_counts=True)) for item, s in part]
                self.tables.setdefault(size, []).append((table, prints, bags))
                known.extend(v for _, v, _ in bags)
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def has(self, found: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        maybe = np.flatnonzero(self.filter[(found & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.searchsorted(self.known, found[maybe])
        at[at == len(self.known)] = 0
        return maybe[self.known[at] == found[maybe]]


def _windows(hits: np.ndarray, docs: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths in words of the windows of ``size`` words (or of shorter whole texts) that hold a hit."""
    row = np.searchsorted(docs, hits, side="right") - 1
    low, high = docs[row], docs[row + 1]
    first = np.maximum(low, hits + k - size)
    last = np.maximum(np.minimum(hits, high - size), low)
    first = np.minimum(first, last)
    n = last - first + 1
    starts = np.unique(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    row = np.searchsorted(docs, starts, side="right") - 1
    return starts, np.minimum(size, docs[row + 1] - starts)


def _search(index: Index, hashes: np.ndarray, docs: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, word at which the window starts, similarity) of all windows similar enough."""
    made: dict[int, tuple] = {}
    for size, tables in index.tables.items():
        k = min(SIZE, size)
        if k not in made:
            found = runs_hash(hashes, k)
            row = np.searchsorted(docs, np.arange(len(found)), side="right") - 1
            hits = index.has(found)
            hits = hits[hits + k <= docs[row[hits] + 1]]
            reach = np.zeros(len(found) + 1, bool)
            made[k] = found, hits, reach
        found, hits, _ = made[k]
        if not len(hits):
            continue
        starts, lengths = _windows(hits, docs, size, k)
        n = lengths - k + 1
        starts, n = starts[n > 0], n[n > 0]
        for at in range(0, len(starts), 1 << 13):
            s, m = starts[at : at + (1 << 13)], n[at : at + (1 << 13)]
            low = int(s[0])
            if int(s[-1] + m[-1]) - low <= 4 * len(s) + size:
                sums = np.zeros((int((s + m).max()) - low + 1, 64), np.int32)
                np.cumsum(_votes(found[low : low + len(sums) - 1]), axis=0, out=sums[1:])
                sums = sums[s + m - low] - sums[s - low]
            else:  # far apart: each stretch of neighbouring windows for itself
                cut = np.flatnonzero(np.diff(s) > size) + 1
                parts = []
                for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(s)).tolist()):
                    low, top = int(s[a]), int((s[a:b] + m[a:b]).max())
                    part = np.zeros((top - low + 1, 64), np.int32)
                    np.cumsum(_votes(found[low:top]), axis=0, out=part[1:])
                    parts.append(part[s[a:b] + m[a:b] - low] - part[s[a:b] - low])
                sums = np.concatenate(parts)
            prints = fingerprint(sums)
            for table, items, bags in tables:
                mask = table[0][prints[:, 0]]
                for block in range(1, 8):
                    mask = mask | table[block][prints[:, block]]
                for j, (item, values, counts) in enumerate(bags):
                    near = np.flatnonzero((mask >> np.uint64(j)) & np.uint64(1))
                    near = near[_BITS[prints[near] ^ items[j]].sum(1) <= RADIUS]
                    for i in near.tolist():
                        value = weighted_similarity(found[s[i] : s[i] + m[i]], values, counts)
                        if value >= similarity:
                            row = int(np.searchsorted(docs, s[i], side="right")) - 1
                            yield row, item, int(s[i] - docs[row]), value


def _find(index: Index, similarity: float, columns: list[str]):
    hit = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for slab in slabs(batch.column("text")):
                w = words(slab)
                for row, item, start, value in _search(index, word_hashes(slab, w), w.docs, similarity):
                    key = (slab.first + row, item)
                    if key not in best or (value, -start) > (best[key][0], -best[key][1]):
                        best[key] = value, start
            lists = batch.column("hits").to_pylist()
            for (row, item), (value, start) in sorted(best.items()):
                lists[row].append({"item_id": item, "start": start, "similarity": value})
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(lists, pa.list_(hit))], [*columns, "hits"])

    return run


def _parts(items: DataFrame, part_bytes: int) -> list:
    """Conditions that cut distinct ``items`` (item_id, text) into parts of at most ``part_bytes``, by sums over hash ranges."""
    key = F.shiftrightunsigned(F.xxhash64("item_id", "text"), 1)  # 63 bits, not negative
    sized = items.select(key.alias("key"), (F.octet_length("text") + F.lit(16)).cast("long").alias("bytes"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    bits = max(0, int(4 * total // part_bytes).bit_length())
    while True:
        sums = sized.groupBy(F.shiftright("key", 63 - bits).alias("range")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        ranges = sums.orderBy("range").collect()  # some 4 to 8 a part
        if bits >= 40 or all(r["bytes"] <= part_bytes or r["n"] == 1 for r in ranges):
            break
        bits += 4
    starts, size = [], part_bytes
    for r in ranges:
        if size + r["bytes"] > part_bytes:
            starts.append(r["range"] << (63 - bits))
            size = 0
        size += r["bytes"]
    stops = [*starts[1:], (1 << 63) - 1]
    return [(key >= a) & ((key < b) if b != stops[-1] else F.lit(True)) for a, b in zip(starts, stops)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (a column text) with hits: per matching item its id, the word at which the best window starts, and the
    similarity. A column ``hits`` of ``docs`` is left out."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    docs = docs.drop("hits")
    cuts = _parts(items, part_bytes)
    if len(cuts) > 1:
        items = stage(items, "benchmark")

    def search(rows: DataFrame, cut) -> tuple[DataFrame, object]:
        found = sorted((r["item_id"], r["text"]) for r in items.where(cut).collect())
        index, columns = spark.sparkContext.broadcast(Index(found)), rows.columns

        def run(batches):
            yield from _find(index.value, similarity, columns)(batches)

        with_hits = rows.withColumn("hits", F.array().cast(_HITS))
        return with_hits.mapInArrow(run, with_hits.schema), index

    if not cuts:
        return docs.withColumn("hits", F.array().cast(_HITS))
    if len(cuts) == 1:
        return search(docs, cuts[0])[0]
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others"), "text")
    stored = stage(packed if len(docs.columns) > 1 else packed.drop("others"), "numbered")
    hits = None
    for cut in cuts:
        found, index = search(stored.select("row", "text"), cut)
        part = stage(found.select("row", F.explode("hits").alias("hit")), "hits")
        index.destroy()
        hits = part if hits is None else hits.union(part)
    best = F.max(F.struct(F.col("hit.similarity").alias("similarity"), (-F.col("hit.start")).alias("minus"))).alias("best")
    one = hits.groupBy("row", F.col("hit.item_id").alias("item_id")).agg(best)
    hit = F.struct("item_id", (-F.col("best.minus")).alias("start"), F.col("best.similarity").alias("similarity"))
    lists = stage(one.groupBy("row").agg(F.sort_array(F.collect_list(hit)).cast(_HITS).alias("hits")), "hits")
    out = stored.join(lists, "row", "left")
    return out.select(*(F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns), F.coalesce("hits", F.array().cast(_HITS)).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; same columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    kept = find_contamination(packed, benchmark, similarity).where(F.size("hits") == 0)
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))

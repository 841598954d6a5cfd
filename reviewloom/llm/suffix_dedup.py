"""Exact removal of long repeated strings by hashed identifiers in the buckets of a sparse suffix array (operator 1).

The dealt method, bucket-pointer refinement, sorts buckets on the identifiers of later offsets. Over all suffixes it shuffles some 130
times the text (measured, see the README), so identifiers are hashes here, made once, and suffixes are sparse.

A byte goes if it is covered by a ``length``-byte string that also starts anywhere else, in the same text or another.

1. Sparse suffixes. Of the q-grams inside a ``length``-byte string, the one with the smallest hash (leftmost if tied) is
   the string's anchor. Equal strings have equal anchors, so only suffixes at anchors (about 1.2 % of positions) are
   bucketed, and every string belongs to exactly one of them.
2. Initial buckets: the anchor's q-gram. A bucket of one holds no repeat and is dropped.
3. Refinement: within a bucket, suffixes are split by the identifier of the whole stretch that the anchor's strings
   cover. Two or more with one identifier are repeats throughout, however many copies there are: only counts move.
4. What is left (stretches that agree in part, at the ends of shared passages) is refined string by string: identifiers
   of each ``length``-byte string at its offset from the anchor, built from the prefix identifiers of the stretch that
   were made once for all offsets. Buckets of over ``hot`` different stretches are refined by Spark, with counts combined
   before the shuffle; smaller ones inside tasks.

No step collects a bucket of copies into one task. Identifiers are 64-bit hashes of bytes.
Null texts count as empty. Rows that share a ``doc_id`` are told apart by their text. Empty tables give empty results.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.scratch import stage
from reviewloom.llm.text import mix, powers, prefix_hash, slabs, substring_hash
from reviewloom.llm.text import _INV as INVERSE

LENGTH, GRAM, HOT = 200, 32, 4096
_POS = np.uint64((1 << 28) - 1)

KEY = ["k1", "k2"]
_ANCHORS = "k1 long, k2 long, start int, n int, bucket long, whole long"


def _keyed(docs: DataFrame, carry=None) -> DataFrame:
    """(carry, text, k1, k2): rows by doc_id and, where that is repeated or null, by text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select((F.col("doc_id") if carry is None else carry).alias("carry"), F.col("doc_id").alias("id"), text.alias("text")).select(
        "carry", "text", F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("id", "text").alias("k2")
    )


def anchor_runs(data: np.ndarray, h: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(start, count, bucket): strings start .. start + count - 1 have one anchor, whose q-gram hash is the bucket."""
    size, width = len(data), length - gram + 1
    if size < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    grams = (h[gram:] - h[:-gram]) * powers(size, INVERSE)[: size - gram + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    m = len(grams)
    blocks = -(-m // width)
    order = np.full(blocks * width, ~np.uint64(0))
    np.bitwise_and(grams, ~_POS, out=order[:m])
    order[:m] |= np.arange(m, dtype=np.uint64)
    order = order.reshape(blocks, width)
    ahead = np.minimum.accumulate(order, axis=1).ravel()
    back = np.minimum.accumulate(order[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - width + 1], ahead[width - 1 : m])
    inside = np.zeros(len(least), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            inside[a : b - length + 1] = True
    starts = np.flatnonzero(inside)
    anchors = (least[starts] & _POS).astype(np.int64)
    if not len(starts):
        return starts, starts, grams[:0]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    return starts[first], np.diff(np.append(first, len(starts))), mix(grams[anchors[first]])


def _blocks(slab, length: int, block: int = 1 << 24):
    """A slab, or overlapping blocks of it if it is one very long text, so that positions fit and memory stays bounded."""
    size = len(slab.data)
    if size <= block:
        yield 0, slab.data, slab.offsets
        return
    for at in range(0, size - length + 1, block):
        part = slab.data[at : at + block + length - 1]
        yield at, part, np.array([0, len(part)])


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in KEY)
            for slab in slabs(batch.column("text")):
                for at, data, offsets in _blocks(slab, length):
                    h = prefix_hash(data)
                    start, n, bucket = anchor_runs(data, h, offsets, length, gram)
                    if not len(start):
                        continue
                    whole = substring_hash(h, start, start + n + length - 1)
                    row = np.searchsorted(offsets, start, side="right") - 1
                    row, local = (row, start - offsets[row]) if len(offsets) > 2 or not at else (row * 0, start + at)
                    row = row + slab.first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (k1[row], k2[row], local.astype(np.int32), n.astype(np.int32), bucket.view(np.int64), whole.view(np.int64))],
                        ["k1", "k2", "start", "n", "bucket", "whole"],
                    )

    return run


def _windows(batch: pa.RecordBatch, length: int):
    """Per stretch of the batch, the identifiers of its strings: (row of each, start of each, identifier)."""
    for slab in slabs(batch.column("bytes"), 1 << 18):
        h = prefix_hash(slab.data)
        size = np.diff(slab.offsets)
        n = size - length + 1
        row = np.repeat(np.arange(slab.n), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = slab.offsets[row] + inner
        yield row + slab.first, inner, substring_hash(h, at, at + length)


def _stretches(length: int):
    """Rows of documents with their open stretches -> one row per stretch with its bytes."""

    def run(batches):
        for batch in batches:
            lists = batch.column("open")
            offsets, flat = lists.offsets.to_numpy(), lists.values
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            texts = batch.column("text")
            out, rows, size = [], [], 0
            for i in range(len(batch)):
                data = texts[i].as_py().encode("utf-8", "surrogatepass")
                for j in range(offsets[i], offsets[i + 1]):
                    out.append(data[start[j] : start[j] + n[j] + length - 1])
                    rows.append((i, j))
                    size += len(out[-1])
                if out and (size > 1 << 23 or i + 1 == len(batch)):
                    doc, item = (np.array(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(pa.array(doc)), batch.column("k2").take(pa.array(doc)), flat.field("start").take(pa.array(item)),
                         flat.field("bucket").take(pa.array(item)), flat.field("copies").take(pa.array(item)), pa.array(out, pa.binary())],
                        ["k1", "k2", "start", "bucket", "copies", "bytes"],
                    )
                    out, rows, size = [], [], 0

    return run


def _refine(length: int):
    """Stretches in bucket order -> covered (start, end) of those whose strings occur again in their bucket."""

    def flush(parts):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        k1, k2, start = (batch.column(c).to_numpy() for c in ("k1", "k2", "start"))
        single = batch.column("copies").to_numpy() == 1
        bucket = batch.column("bucket").to_numpy()
        rows, inner, ids = (np.concatenate(x) for x in zip(*_windows(batch, length)))
        order = np.lexsort((ids, bucket[rows]))
        same = (ids[order][1:] == ids[order][:-1]) & (bucket[rows[order]][1:] == bucket[rows[order]][:-1])
        again = np.zeros(len(ids), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again &= single[rows]
        rows, inner = rows[again], inner[again]
        if not len(rows):
            return None
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (inner[1:] != inner[:-1] + 1)
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(rows)) - 1
        r = rows[first]
        at, end = start[r] + inner[first], start[r] + inner[last] + length
        return pa.RecordBatch.from_arrays([pa.array(k1[r]), pa.array(k2[r]), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32))], ["k1", "k2", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                bucket = batch.column("bucket").to_numpy()
                turn = int(np.flatnonzero(bucket == bucket[-1])[0])  # the last bucket may go on
                if held and (turn or held[-1].column("bucket")[len(held[-1]) - 1].as_py() != bucket[0]) and size > 4096:
                    if turn:
                        held.append(batch.slice(0, turn))
                        batch = batch.slice(turn)
                    if (found := flush(held)) is not None:
                        yield found
                    held, size = [], 0
                held.append(batch)
                size += len(batch)
        if held and (found := flush(held)) is not None:
            yield found

    return run


def _hot_windows(length: int):
    def run(batches):
        for batch in batches:
            k1, k2, start = (batch.column(c).to_numpy() for c in ("k1", "k2", "start"))
            single = batch.column("copies").to_numpy() == 1
            for rows, inner, ids in _windows(batch, length):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[rows]), pa.array(k2[rows]), pa.array((start[rows] + inner).astype(np.int32)), pa.array(single[rows]), pa.array(ids.view(np.int64))],
                    ["k1", "k2", "start", "single", "id"],
                )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k1, k2, start, end): stretches of bytes covered by repeated strings; they may overlap."""
    keyed = _keyed(docs)
    long_enough = keyed.where(F.octet_length("text") >= length)
    anchors = stage(long_enough.select(*KEY, "text").mapInArrow(_anchors(length, gram), _ANCHORS), "anchors")
    # Each sum is written before it is joined: a join over its own two exchanges is one whose hot keys Spark can split.
    buckets = anchors.groupBy("bucket").agg(F.count("*").alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("c > 1")
    buckets = stage(buckets.select("bucket", (F.col("lo") == F.col("hi")).alias("same")), "buckets")
    repeated = stage(anchors.join(buckets, "bucket"), "repeated")
    apart = repeated.where("not same")
    kinds = stage(
        apart.groupBy("bucket", "whole").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "start", "n")).alias("at")), "kinds"
    )
    whole_again = apart.join(kinds.where("copies > 1").select("bucket", "whole"), ["bucket", "whole"], "left_semi")
    covered = [
        part.select(*KEY, "start", (F.col("start") + F.col("n") + (length - 1)).cast("int").alias("end"))
        for part in (repeated.where("same"), whole_again)
    ]
    per_bucket = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum((F.col("copies") == 1).cast("int")).alias("open"))
    per_bucket = stage(per_bucket.where("open > 0").select("bucket", (F.col("kinds") > hot).alias("hot")), "per-bucket")
    todo = stage(kinds.join(per_bucket, "bucket").select("bucket", "copies", "at.*", "hot"), "open")

    def bytes_of(part: DataFrame) -> DataFrame:
        lists = part.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "bucket", "copies")).alias("open"))
        texts = long_enough.select(*KEY, "text").dropDuplicates(KEY).join(lists, KEY)  # one exchange of texts serves both
        return texts.mapInArrow(_stretches(length), "k1 long, k2 long, start int, bucket long, copies long, bytes binary")

    small = bytes_of(todo.where("not hot")).repartition("bucket").sortWithinPartitions("bucket")
    found = [stage(small.mapInArrow(_refine(length), "k1 long, k2 long, start int, end int"), "refined")]
    if not todo.where("hot").isEmpty():
        rows = stage(bytes_of(todo.where("hot")).mapInArrow(_hot_windows(length), "k1 long, k2 long, start int, single boolean, id long"), "hot")
        again = stage(rows.groupBy("id").count().where("count > 1").select("id"), "hot-again")
        found.append(
            rows.where("single").join(again, "id", "left_semi").select(*KEY, "start", (F.col("start") + length).cast("int").alias("end"))
        )
    for part in found:
        covered.append(part)
    out = covered[0]
    for part in covered[1:]:
        out = out.union(part)
    return out


def _merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of sorted (start, end) pairs."""
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(fresh)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _cut(whole_chars: bool):
    def run(batches):
        for batch in batches:
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
            out: dict[str, list] = {x: [] for x in names}
            lists = batch.column("spans")
            size, first = 0, 0
            for i in range(len(batch)):
                data = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                runs = np.zeros((0, 2), np.int64)
                if lists[i].is_valid and len(lists[i].values):
                    flat = lists[i].values
                    spans = np.stack([flat.field("start").to_numpy(), flat.field("end").to_numpy()], axis=1).astype(np.int64)
                    runs = _merge(spans[np.lexsort((spans[:, 1], spans[:, 0]))])
                if whole_chars and len(runs):
                    raw = np.frombuffer(data, np.uint8)
                    lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    runs = np.stack([lead[np.searchsorted(lead, runs[:, 0])], lead[np.searchsorted(lead, runs[:, 1], side="right") - 1]], axis=1)
                    runs = runs[runs[:, 0] < runs[:, 1]]
                kept, at = [], 0
                for a, b in runs.tolist():
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                row = (len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in runs.tolist()], rest)
                for name, value in zip(names, row):
                    out[name].append(value)
                size += len(rest)
                if size > 1 << 23 or i + 1 == len(batch):
                    carried = batch.column("carry").slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([carried] + [pa.array(out[f.name], f.type) for f in _CUT_SCHEMA], ["carry", *names])
                    out, size, first = {x: [] for x in names}, 0, i + 1

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CUT_SCHEMA = pa.schema(
    [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPAN), ("kept", pa.binary())]
)


def _cut_rows(docs: DataFrame, carry, length: int, gram: int, hot: int, whole_chars: bool) -> DataFrame:
    if not 0 < gram <= length:
        raise ValueError("gram must lie in 1 .. length")
    spans = repeated_spans(docs, length, gram, hot)
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = _keyed(docs, carry).join(lists, KEY, "left").select("carry", "text", "spans")
    kind = rows.schema["carry"].dataType.simpleString()
    return rows.mapInArrow(
        _cut(whole_chars),
        f"carry {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary",
    )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, whole_chars: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs, byte
    offsets) and kept (the remaining bytes).

    ``whole_chars`` shrinks each run to whole characters, so that ``kept`` is valid UTF-8; all figures then follow it.
    """
    return _cut_rows(docs, F.col("doc_id"), length, gram, hot, whole_chars).withColumnRenamed("carry", "doc_id")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with what repeats cut out of text (whole characters) and n_chars, if there, following it; null stays null."""
    others = [c for c in docs.columns if c != "text"]
    carry = F.struct(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").isNull().alias("none"))
    out = _cut_rows(docs, carry, length, GRAM, HOT, True)
    out = out.select("carry.row", F.when(~F.col("carry.none"), F.col("kept").cast("string")).alias("text"))
    held = {c: F.col(f"row.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in held:
        held["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(held[c].alias(c) for c in docs.columns))

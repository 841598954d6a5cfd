"""Document fingerprints by one-permutation MinHash with optimal densification, packed to low-order bits (operator 12).

1. A text's set is that of its five-word shingles, A-Z lowered (fewer words: the whole sequence). Each shingle is hashed once: the
   high bits name one of ``BINS`` bins, the rest is its value there, and a bin keeps its least value.
2. Empty bins are filled by optimal densification: bin i looks at other bins in a fixed random order of its own and takes the
   value of the first that is not empty. Orders are the same for all texts, so equal sets agree in every bin.
3. Of every bin the lowest ``BITS`` bits are stored, after value and bin are mixed: else a short text's few values, which fill many
   bins, would agree by chance in many at once. Unequal values agree with chance c = 2 ** -BITS, so the likeness of two
   fingerprints is (m - c) / (1 - c) for a share m of equal bins, brought to 0..1: an unbiased estimate of the sets' Jaccard
   similarity but for that cut, with a standard deviation of at most 0.024.

A fingerprint is that of the set: texts equal in their words are equal in it. No words: an empty fingerprint, like 1 to another such
and 0 to all others.

`with_next` compares each text with an edited one and with its successor. Texts are sorted by (doc_id, SHA-256 of the text), null ids
last, in ranges that Spark samples; a salt splits the copies of one row over ranges. Each task reads its range in order and
keeps one text in hand. What needs the text after a range is finished from the first row of the next one: two rows a range.
Rows may repeat; a null text is empty; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.scratch import partitions, stage
from reviewloom.llm.text import SLAB, mix, shingles, slabs, word_hashes, words

BINS, BITS, SHINGLE = 512, 4, 5
SALTS = 1024
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_SHIFT = _U(64 - (BINS - 1).bit_length())


@cache
def orders() -> np.ndarray:
    """Row t, column i: the bin that bin i looks at t-th. Each column is a random order of all bins."""
    r = np.random.default_rng(12)
    return np.argsort(r.random((BINS, BINS)), axis=0).astype(np.int32)


def bins(column: pa.Array) -> np.ndarray:
    """Least value per text and bin; a bin without any holds the largest 64-bit number."""
    out = np.full((len(column), BINS), _EMPTY)
    flat = out.ravel()
    for slab in slabs(column):
        w = words(slab)
        each = list(shingles(word_hashes(slab, w), w.docs, SHINGLE))
        if not each:
            continue
        h = mix(np.concatenate(each))
        row = np.repeat(np.arange(slab.first, slab.first + len(each)), [len(x) for x in each])
        np.minimum.at(flat, row * BINS + (h >> _SHIFT).astype(np.int64), h & (_EMPTY >> _U(8)))
    return out


def densify(values: np.ndarray) -> np.ndarray:
    """Fill empty bins, in rows that have any value, from the first filled bin in their order."""
    filled = values != _EMPTY
    out = values.copy()
    row, bin_ = np.nonzero(~filled & filled.any(1)[:, None])
    for look in orders():
        if not len(row):
            break
        at = look[bin_]
        hit = filled[row, at]
        out[row[hit], bin_[hit]] = values[row[hit], at[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def fingerprints(column: pa.Array) -> list[bytes]:
    """Packed low-order bits of all bins per text, empty for a text without words."""
    values = bins(column)
    some = (values != _EMPTY).any(1)
    low = (mix(densify(values) ^ mix(np.arange(1, BINS + 1, dtype=np.uint64))) & _U((1 << BITS) - 1)).astype(np.uint8)
    bits = (low[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1
    packed = np.packbits(bits.reshape(len(low), BINS * BITS), axis=1)
    return [p.tobytes() if s else b"" for p, s in zip(packed, some)]


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Estimated Jaccard similarity of the sets behind pairs of fingerprints."""
    out = np.array([float(not x and not y) for x, y in zip(a, b)])
    both = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
    if both:
        x, y = (np.unpackbits(np.frombuffer(b"".join(z[i] for i in both), np.uint8)).reshape(len(both), BINS, BITS) for z in (a, b))
        chance = 2.0**-BITS
        out[both] = np.clip(((x == y).all(2).mean(1) - chance) / (1 - chance), 0, 1)
    return out


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter (whole code points, rounded down) replaced by as many from the start of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def compare(ids: pa.Array, texts: list[str], after: list[str], prints: list[bytes]) -> pa.RecordBatch:
    """Result rows for texts and the texts after them; ``prints`` are the fingerprints of both in a row: one more than texts, or
    those of ``texts`` and then those of ``after``."""
    n = len(texts)
    changed = [edited(*pair) for pair in zip(texts, after)]
    own, follow = prints[:n], prints[1:] if len(prints) == n + 1 else prints[n:]
    new = fingerprints(pa.array(changed, pa.large_string()))
    columns = {
        "doc_id": ids,
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(own, pa.binary()),
        "edited_fingerprint": pa.array(new, pa.binary()),
        "near_edited": pa.array(likeness(own, new)),
        "near_next": pa.array(likeness(own, follow)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _with_text(batch: pa.RecordBatch, rng: int, end: str | None = None, text: str | None = None) -> pa.RecordBatch:
    n = len(batch)
    extra = [pa.array([rng] * n, pa.int32()), pa.array([end] * n, pa.string()), pa.array([text] * n, pa.large_string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "range", "end", "text"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about a slab of text."""
    for batch in batches:
        size = pc.binary_length(batch.column("text").fill_null("")).to_numpy()
        at = np.cumsum(size)
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + SLAB, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range in order: all rows but the last, then the texts of its first and last row, marked by ``end``."""
    first = last = None
    for batch in _parts(batches):
        rng = batch.column("range")[0].as_py()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids, prints = batch.column("doc_id"), fingerprints(pa.array(texts, pa.large_string()))
        if first is None:
            first = texts[0]
        else:
            ids = pa.concat_arrays([last[0], ids])
            texts, prints = [last[1], *texts], [last[2], *prints]
        if len(texts) > 1:
            yield _with_text(compare(ids[:-1], texts[:-1], texts[1:], prints), rng)
        last = ids[-1:], texts[-1], prints[-1]
    if first is not None:
        for end, text in (("first", first), ("last", last[1])):
            row = compare(last[0], [""], [""], [b"", b""])
            yield _with_text(row, rng, end, text)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            text, after = (batch.column(c)[i].as_py() for c in ("text", "after"))
            yield compare(batch.column("doc_id")[i : i + 1], [text], [after], fingerprints(pa.array([text, after], pa.large_string())))


def with_next(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited,
    near_next. The text after the last row's is the first row's."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    keyed = docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    order = [F.col("doc_id").asc_nulls_last(), "sha", "salt"]
    ranges = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranges = ranges.select("doc_id", "text", F.spark_partition_id().alias("range"))
    rows = stage(ranges.mapInArrow(_walk, f"{columns}, range int, end string, text string"), "fingerprints")

    # Two rows a range: the last text of each, and the first text of the range that follows, around in a circle.
    first = rows.where("end = 'first'").select(F.col("range").alias("follows"), F.col("text").alias("after"))
    last = rows.where("end = 'last'").select("doc_id", "range", "text")
    ends = last.select("range")
    turn = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = last.join(ends.select("range", turn.alias("follows")), "range").join(first, "follows").select("doc_id", "text", "after")
    return rows.where("end is null").drop("range", "end", "text").unionByName(pairs.mapInArrow(_finish, columns))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """`with_next` with fingerprints as lowercase hexadecimal text."""
    return with_next(docs).withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})

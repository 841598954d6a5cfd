"""Language of texts by script ranges and Viterbi over per-word scores (operator 5).

Learning: per language, counts of hashed character n-grams over all labelled documents, summed inside tasks and then over
tasks; the model has languages x ``1 << BITS`` counts, whatever the size of the corpus.
Predicting: a word's script leaves as candidates the languages that use this script (all, if none does). A word's score
per language is the sum of its n-grams' log-probabilities; Viterbi with a switching penalty labels the words, so that
spans of mixed text keep their own language. A document's language is the one with most letters, its score their share.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language first in order of name. An empty
training set makes every text ``und``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.scratch import stage
from reviewloom.llm.text import grams, letter_runs

BITS, ORDERS, PENALTY, CHUNK = 16, (2, 3, 4), 6.0, 1 << 13
UNDETERMINED = "und"

#: First code point of each range and its script.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFEFF, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
_SIZE = -(-((1 << BITS) + len(SCRIPTS)) // CHUNK) * CHUNK


def _scripts(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_STARTS, codes, side="right") - 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for part in letter_runs(batch.column("text")):
            names = sorted(set(langs[part.first : part.first + part.n]))
            of_row = np.array([names.index(x) for x in langs[part.first : part.first + part.n]])
            begins = np.append(part.at[:-1] - 1, len(part.codes))
            of_char = np.repeat(of_row, np.diff(begins))
            of_char = np.concatenate([of_char, np.zeros(len(part.codes) - len(of_char), np.int64)])
            sums = np.zeros(len(names) * _SIZE, np.int64)
            for n in ORDERS:
                bucket, inner = grams(part.codes, n, BITS)
                inner &= _spanned(part)
                sums += np.bincount(of_char[inner] * _SIZE + bucket[inner], minlength=len(sums))
            letter = part.codes > 0
            sums += np.bincount(of_char[letter] * _SIZE + (1 << BITS) + _scripts(part.codes[letter]), minlength=len(sums))
            for name, row in zip(names, sums.reshape(len(names), _SIZE)):
                totals[name] = totals[name] + row if name in totals else row
    for name, row in totals.items():
        chunks = row.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(chunks)), pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())],
            ["lang", "chunk", "counts"],
        )


def _spanned(part) -> np.ndarray:
    """Places from just before a word up to its last letter: where its n-grams begin."""
    edge = np.zeros(len(part.codes) + 1, np.int8)
    edge[part.starts - 1] += 1
    edge[part.ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (lang, chunk): one row with the sum of each."""
    at, total = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lang", "chunk", "counts"])

    for batch in batches:
        for lang, chunk, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if at != (lang, chunk):
                if at is not None:
                    yield row()
                at, total = (lang, chunk), np.zeros(CHUNK, np.int64)
            total = total + np.frombuffer(counts, np.int64)
    if at is not None:
        yield row()


#: Distinct values of ``lang`` that a model is made for.
MOST_LANGS = 500


class Model:
    """Log-probabilities by bucket and language, and the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        of_grams = counts[:, : 1 << BITS].astype(float)
        share = of_grams / np.maximum(of_grams.sum(1, keepdims=True), 1)
        self.scores = np.ascontiguousarray(np.log(0.99 * share + 0.01 / (1 << BITS)).T.astype(np.float32))
        by_script = counts[:, 1 << BITS : (1 << BITS) + len(SCRIPTS)].astype(float)
        uses = by_script / np.maximum(by_script.sum(1, keepdims=True), 1) >= 0.01
        uses[:, ~uses.any(0)] = True
        self.uses = uses.T  # script x language


def learn(labelled: DataFrame) -> Model:
    """``labelled`` (text, lang) -> model; only sums of fixed size for each of at most ``MOST_LANGS`` languages reach the driver.

    A model takes 0.3 MB a language on every executor, counting 0.6 MB in every task. More distinct values of ``lang`` than
    ``MOST_LANGS`` are an error: such a column holds something else than languages, or needs its tags mapped first.
    """
    n = labelled.where("lang is not null").select("lang").distinct().limit(MOST_LANGS + 1).count()
    if n > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} distinct values of lang: map the tags to languages first")
    sums = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, chunk int, counts binary")
    summed = stage(sums, "lang-counts").repartition("lang", "chunk").sortWithinPartitions("lang", "chunk").mapInArrow(_add, "lang string, chunk int, counts binary")
    rows = summed.collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), _SIZE), np.int64)
    for r in rows:
        counts[langs.index(r["lang"]), r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return Model(langs, counts)


def word_scores(model: Model, part) -> np.ndarray:
    """words x languages: sums of log-probabilities; languages that do not use the word's script are out."""
    n = len(model.langs)
    total = np.zeros((len(part.codes), n), np.float32)
    for order in ORDERS:
        bucket, inner = grams(part.codes, order, BITS)
        bucket[~inner] = 1 << BITS
        total += model.padded[bucket]
    if not len(part.starts):
        return total[:0]
    cuts = np.stack([part.starts - 1, part.ends], axis=1).ravel()
    scores = np.add.reduceat(total, cuts, axis=0)[::2]
    allowed = model.uses[_scripts(part.codes[part.starts])]
    return np.where(allowed, scores, scores - 1e6).astype(np.float32)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: the sum of scores less ``penalty`` for each change, per row; all rows step by step."""
    sizes = np.diff(offsets)
    rows = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[rows], offsets[:-1][rows]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")  # rows with more than t words
    labels = np.zeros(len(scores), np.uint8 if scores.shape[1] < 256 else np.int32)
    came = np.zeros(scores.shape, labels.dtype)
    own = np.arange(scores.shape[1], dtype=labels.dtype)
    state = scores[begin[: active[0]]] if longest else scores[:0]
    last = np.zeros(len(sizes), labels.dtype)
    for t in range(1, longest):
        k = active[t]
        if k < len(state):
            last[k : len(state)] = state[k:].argmax(1)
            state = state[:k]
        best = state.argmax(1)
        change = (state[np.arange(k), best] - penalty)[:, None]
        here = begin[:k] + t
        came[here] = np.where(change > state, best[:, None], own)
        state = np.maximum(state, change) + scores[here]
        state -= state.max(1, keepdims=True)
    if longest:
        last[: len(state)] = state.argmax(1)
    now = last.copy()
    for t in range(longest - 1, -1, -1):
        k = active[t]
        here = begin[:k] + t
        labels[here] = now[:k]
        now[:k] = came[here, now[:k]] if t else now[:k]
    return labels


def _predict(model: Model, penalty: float, spans: bool, columns: list[str]):
    words_at_once = max(1, (1 << 21) // max(1, len(model.langs)))

    def flush(batch, held):
        n = len(model.langs)
        docs = [d for _, p in held for d in np.diff(p.docs).tolist()]
        offsets = np.concatenate([[0], np.cumsum(docs)]).astype(np.int64)
        labels = viterbi(np.concatenate([s for s, _ in held]), offsets, penalty).astype(np.int64)
        size = np.concatenate([p.ends - p.starts for _, p in held])
        row = np.repeat(np.arange(len(docs)), np.diff(offsets))
        by = np.bincount(row * n + labels, weights=size, minlength=len(docs) * n).reshape(-1, n)
        best, total = by.argmax(1), by.sum(1)
        names = [model.langs[b] if t else UNDETERMINED for b, t in zip(best.tolist(), total.tolist())]
        score = by[np.arange(len(docs)), best] / np.maximum(total, 1)
        first = held[0][1].first
        out = [batch.column(c).slice(first, len(docs)) for c in columns] + [pa.array(names, pa.string()), pa.array(score)]
        if spans:
            begin = np.concatenate([p.starts - np.repeat(p.at[:-1], np.diff(p.docs)) for _, p in held])
            end = begin + size
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(row)) - 1 if len(head) else head
            runs = pa.StructArray.from_arrays(
                [pa.array([model.langs[x] for x in labels[head].tolist()], pa.string()), pa.array(begin[head]), pa.array(end[tail])], ["lang", "start", "end"]
            )
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[head], np.arange(len(docs) + 1)), pa.int32()), runs))
        return pa.RecordBatch.from_arrays(out, [*columns, "lang_pred", "score"] + ["spans"] * spans)

    def run(batches):
        model.padded = np.vstack([model.scores, np.zeros((1, len(model.langs)), np.float32)])
        for batch in batches:
            held, size = [], 0
            for part in letter_runs(batch.column("text")):
                held.append((word_scores(model, part), part))
                part.codes = None
                size += len(part.starts)
                if size > words_at_once:
                    yield flush(batch, held)
                    held, size = [], 0
            if held:
                yield flush(batch, held)

    return run


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs`` its columns (text only if ``keep_text``), then lang_pred, score and, if asked for, spans (lang, start and end in
    characters)."""
    columns = [c for c in docs.columns if keep_text or c != "text"]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    schema = ", ".join([*fields, "lang_pred string", "score double"] + ["spans array<struct<lang:string,start:long,end:long>>"] * spans)
    if not model.langs:
        empty = F.lit(None).cast("array<struct<lang:string,start:long,end:long>>")
        return docs.select(*(F.col(f"`{c}`") for c in columns), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), *([empty.alias("spans")] if spans else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        yield from _predict(shared.value, penalty, spans, columns)(batches)

    return docs.select(*(F.col(f"`{c}`") for c in columns), *([] if keep_text else ["text"])).mapInArrow(run, schema)


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """Learn from labelled rows outside the held-out fold and predict every row: doc_id, held_out, lang_pred, score."""
    fold = remainder(F.col("doc_id"), folds)
    model = learn(docs.where(fold != held_out).select("text", "lang"))
    return predict(docs.select("doc_id", "text", (fold == held_out).alias("held_out")), model, penalty, spans)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is determined with at least the share ``least`` of their letters; same columns.

    Where no row is labelled nothing can be determined, and all rows with a letter stay.
    """
    model = learn(docs.where(remainder(F.col("doc_id"), 4) != 2).select("text", "lang"))
    if not model.langs:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    found = predict(docs.select(others, "text"), model, keep_text=True)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))

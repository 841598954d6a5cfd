"""Token counts as delta-maintained rollups (operator 10).

A change of documents is signed rows: what was counted before with -1, what is counted now with +1; an insert has no
before, a delete no after, a revised count both. Sums of signed rows by source, language and tokenizer version are
additive, so totals follow from any batches in any order without touching documents again.

``Rollup`` keeps one small table of sums per batch and a marker written after it. A batch that was committed is skipped,
one that broke off is written again from the start (its place is its id), and only marked batches count: delivering a batch
any number of times changes nothing. ``compact`` folds all marked batches into one.

Null texts have no tokens; null sources and languages are groups of their own; groups whose documents all went are left
out of the totals. Empty tables and batches are fine.
"""
from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.scratch import stage
from reviewloom.llm.text import WORD

GROUP = ["source", "lang", "tokenizer"]
#: The split into pieces that goes with this vocabulary (fixed value).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass(frozen=True)
class Tokenizer:
    """A version name and, per batch of texts, their numbers of tokens."""

    version: str
    make: Callable[[], Callable[[list[str]], list[int]]]


def bpe_tokenizer(path: str, version: str = "byte_bpe_50k/1", pieces: str = PIECES) -> Tokenizer:
    """Byte-level BPE from a file of ranks; the driver reads it once and tasks get its content (about 1 MB)."""
    with open(path, "rb") as f:
        content = f.read()

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        encoding = tiktoken.Encoding(version, pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]

    return Tokenizer(version, make)


def count_tokens(docs: DataFrame, tokenizers: list[Tokenizer], words_version: str = "words/1") -> DataFrame:
    """One row per row of ``docs`` and tokenizer: doc_id, source, lang, tokenizer, n_tokens.

    The words version (runs of other than white space) is counted by Spark itself.
    """
    kept = ["doc_id", "source", "lang"]
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*kept, "text", words.alias("n_words"))
    def run(batches):
        made = [(t.version, t.make()) for t in tokenizers]
        for batch in batches:
            texts = batch.column("text")
            sizes: list[list[int]] = [[] for _ in made]
            for at in range(0, len(batch), 256):
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for out, (_, count) in zip(sizes, made):
                    out.extend(count(part))
            for (version, _), out in [((words_version, None), batch.column("n_words")), *zip(made, sizes)]:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [pa.array([version] * len(batch), pa.string()), pa.array(out, pa.int64()) if isinstance(out, list) else out],
                    [*kept, "tokenizer", "n_tokens"],
                )

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{fields}, tokenizer string, n_tokens long")


def signed(before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Counts before and after a change -> (source, lang, tokenizer, n_docs, n_tokens) to add to the totals."""
    rows = [
        part.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))
        for part, sign in ((before, -1), (after, 1))
        if part is not None
    ]
    union = rows[0] if len(rows) == 1 else rows[0].union(rows[1])
    return union.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder all executors reach; one writer at a time."""

    _SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch string")

    def committed(self) -> DataFrame:
        """(batch, folded): a row per batch that counts, and one per batch that was folded into it."""
        return self._read("marks", "folded string").select("batch", "folded")

    def commit(self, batch: str, change: DataFrame) -> bool:
        """Adds the sums of a batch; False if it was committed before."""
        seen = self.committed()
        if not seen.where((F.col("batch") == batch) | (F.col("folded") == batch)).isEmpty():
            return False
        self._write(batch, change)
        return True

    def _write(self, batch: str, change: DataFrame, folded: DataFrame | None = None) -> None:
        change.select(*GROUP, "n_docs", "n_tokens").write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch}")
        mark = self.spark.createDataFrame([(None,)], "folded string")
        mark = mark if folded is None else mark.union(folded)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")  # one file: there or not; a row a batch

    def _live(self) -> DataFrame:
        marks = self.committed()
        gone = marks.where("folded is not null").select(F.col("folded").alias("batch"))
        alive = marks.select("batch").distinct().join(gone, "batch", "left_anti")
        return self._read("sums", self._SUMS).join(alive, "batch", "left_semi")

    def totals(self) -> DataFrame:
        sums = self._live().groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, batch: str) -> None:
        """Folds all that counts into one batch with a new id; the ids folded stay known."""
        marks = self.committed()
        if not marks.where((F.col("batch") == batch) | (F.col("folded") == batch)).isEmpty():
            return
        known = marks.select("batch").union(marks.where("folded is not null").select("folded")).distinct()
        self._write(batch, stage(self.totals(), "compact"), stage(known, "folded"))

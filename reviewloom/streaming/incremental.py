"""Curate documents as they arrive: accepted rows and rejects from one pass, each batch of files once.

A document is curated within its row, so the batch plan serves a stream unchanged and without
state. The checkpoint remembers which files, or which batches of a `DocumentStore`, are done. Each batch of the stream is
parsed once and staged; then its rows replace ``final_path/batch=N`` and its rejects ``rejects_path/batch=N``, so a batch that
is run again after a failure adds nothing.
"""
from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewloom.plans.curate import SAMPLE_CAP
from reviewloom.plans.jobs import curated
from reviewloom.sources.documents import document_rows
from reviewloom.sources.store import MANIFEST, DocumentStore

Sink = Callable[[DataFrame, int], None]


def batch_writer(
    final_path: str,
    rejects_path: str | None = None,
    *,
    as_of: Column | datetime | date | str | None = None,
    cap: int = SAMPLE_CAP,
    seed: int | str = 42,
    on_counts: Callable[[int, dict[str, int]], None] | None = None,
) -> Sink:
    """What is done with each batch of documents (file, modified, value); ``on_counts`` is told what was in it."""

    def write(raw: DataFrame, batch: int) -> None:
        final, rejects, counts = curated(raw, as_of=as_of, cap=cap, seed=seed)
        if rejects_path:
            rejects.write.mode("overwrite").parquet(f"{rejects_path.rstrip('/')}/batch={batch}")
        final.write.mode("overwrite").parquet(f"{final_path.rstrip('/')}/batch={batch}")
        if on_counts:
            on_counts(batch, counts)

    return write


def curate_new_documents(
    spark: SparkSession,
    documents_path: str,
    final_path: str,
    checkpoint_path: str,
    *,
    rejects_path: str | None = None,
    layout: str = "file",
    pattern: str = "*.json",
    max_files_per_batch: int = 10_000,
    **options,
) -> StreamingQuery:
    """Process all files not seen before, add the rows to the Parquet table ``final_path``, and stop.

    ``layout="line"`` takes lines as `sinks.write_documents` writes them, ``"store"`` the committed batches of a
    `DocumentStore`. Without ``rejects_path`` rejected documents are only counted. Further options: those of `batch_writer`.
    """
    if layout not in ("file", "line", "store"):
        raise ValueError(f"a stream reads files, lines or a store, not: {layout}")
    write = batch_writer(final_path, rejects_path, **options)
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_batch)
    if layout == "store":
        store = DocumentStore(spark, documents_path)
        rows = reader.schema(MANIFEST).parquet(store.manifest_path)

        def run(manifest: DataFrame, batch: int) -> None:
            paths = [f"{store.path}/batch={r['batch']}" for r in manifest.select("batch").distinct().collect()]
            if paths:
                write(document_rows(manifest.sparkSession.read, paths, "line", pattern), batch)
    else:
        rows, run = document_rows(reader, documents_path, layout, pattern), write
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()

"""A folder of collected documents that grows by whole batches.

``PATH/batch=ID/`` holds the documents of a batch, ``PATH.batches/keys/batch=ID/`` their keys, and
``PATH.batches/manifest/`` one row for each committed batch. The row is written last, as a single file, and readers
take committed batches only: documents and keys of a batch become visible together, or not at all. A run that is
stopped anywhere leaves at most a batch that nobody reads; the next run writes its own. One writer at a time.

Files that lie in the folder itself, from elsewhere or from before, are read as well; keys of Spark's part files
among them come from the documents.
"""
from __future__ import annotations

import uuid
from fnmatch import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources import sinks

MANIFEST = "batch string, n_documents long, n_reviews long"
KEYS = "doc_key string, batch string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


class DocumentStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest_path, self.keys_path = f"{self.path}.batches/manifest", f"{self.path}.batches/keys"

    def committed(self) -> DataFrame:
        """(batch, n_documents, n_reviews) of the batches that count."""
        table = _table(self.spark, self.manifest_path, MANIFEST)
        return (self.spark.createDataFrame([], MANIFEST) if table is None else table).distinct()

    def batches(self) -> list[str]:
        """Their ids; one for each run that wrote something."""
        return sorted(r["batch"] for r in self.committed().collect())

    def visible_paths(self, pattern: str = "*.json") -> list[str]:
        """What a reader of the documents may read: committed batches, and files in the folder itself."""
        batches = self.batches()
        if not batches and _table(self.spark, self.keys_path, KEYS) is None and not _exists(self.spark, f"{self.path}/batch=*"):
            return [self.path]
        if fnmatch("batch=", pattern):
            raise ValueError(f"a pattern that batch folders match hides which of them count: {pattern}")
        loose = f"{self.path}/{pattern}"
        return [f"{self.path}/batch={b}" for b in batches] + ([loose] if _exists(self.spark, loose) else [])

    def keys(self, *, rebuild: bool = False) -> DataFrame:
        """(doc_key) of all visible documents: of committed batches from their tables of keys, or, with ``rebuild``,
        from the documents."""
        empty = self.spark.createDataFrame([], "doc_key string")
        paths = self.visible_paths() if _exists(self.spark, self.path) else []
        stored = _table(self.spark, self.keys_path, KEYS)
        if stored is not None and not rebuild:
            paths = [p for p in paths if not p.startswith(f"{self.path}/batch=")]
            empty = stored.join(self.committed().select("batch"), "batch", "left_semi").select("doc_key")
        if not paths:
            return empty
        return empty.union(self.spark.read.schema("doc_key string").json(paths).where("doc_key is not null"))

    def commit(self, documents: DataFrame, *, batch: str | None = None, counts: dict[str, int] | None = None) -> bool:
        """Add (doc_key, place_info, reviews) as one batch; False if there are none, or if ``batch`` is committed already.

        ``documents`` are read twice: `sinks.stage` them. A batch with the id of one that was not committed replaces it.
        """
        batch = batch or uuid.uuid4().hex
        if self.committed().where(F.col("batch") == batch).take(1):
            return False
        if counts is None:
            row = documents.agg(F.count("*"), F.coalesce(F.sum(F.size("reviews")), F.lit(0))).first()
            counts = {"documents": row[0], "reviews": row[1]}
        if not counts["documents"]:
            return False
        sinks.write_documents(documents, f"{self.path}/batch={batch}", mode="overwrite", n_rows=counts["documents"])
        documents.select("doc_key").write.mode("overwrite").parquet(f"{self.keys_path}/batch={batch}")
        row = self.spark.createDataFrame([(batch, counts["documents"], counts["reviews"])], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(self.manifest_path)
        return True

    def leftovers(self) -> list[str]:
        """Folders of batches that were never committed, for the folder's owner to clear while nobody writes."""
        known, found = set(self.batches()), set()
        for root in (self.path, self.keys_path):
            if _exists(self.spark, f"{root}/batch=*"):
                files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/batch=*")
                found |= {r[0] for r in files.select(F.regexp_extract("path", "^(.*/batch=[^/]*)/", 1)).distinct().collect()}
        return sorted(p for p in found if p.rsplit("=", 1)[1] not in known)

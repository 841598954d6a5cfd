"""Written intermediates: each cuts the lineage and outlives a lost executor."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.session import shared_path

#: Lets Spark drop a job's shuffle files when the job has ended; what later jobs read is in the written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts that Spark hands to a Python worker at once; buffers on both sides grow with it.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WHILE_WRITING = {CLEANUP: "true", BATCH: "8m"}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder (``spark.checkpoint.dir``) and read it back."""
    spark: SparkSession = df.sparkSession
    path = shared_path(spark, f"llm-{name}")
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

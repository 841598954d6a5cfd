"""Stored pages: any Parquet table with url and html, or a store bucketed by URL.

A store lets pages meet the places that want them without moving HTML: the join reads it bucket by bucket and only the
URLs of the places are shuffled. It is made once for each crawl; several versions of a page may lie in it.
"""
from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _table_name(path: str) -> str:
    return f"pages_{hashlib.md5(path.encode()).hexdigest()}"


def write_page_store(pages: DataFrame, path: str, buckets: int) -> None:
    """Write ``pages`` in ``buckets`` files' worth of URLs; choose as many as make a bucket fit a task's memory a few times.

    Pages are shuffled here, once. The description of the store is written last: without it there is no store.
    """
    spark, path = pages.sparkSession, path.rstrip("/")
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = pages.repartition(buckets, "url")  # one file a bucket, not one a bucket and task
    dealt.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").option("path", path).saveAsTable(name)
    about = spark.createDataFrame([(buckets, pages.schema.json())], "buckets int, schema string")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}.store")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages at ``path``, bucketed if `write_page_store` wrote them, in any session."""
    path = path.rstrip("/")
    try:
        about = spark.read.parquet(f"{path}.store").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.parquet(path)
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(about["schema"])))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)

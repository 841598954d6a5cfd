"""The places list: CSV with place_name, gmaps_url, and a columnar copy of it that many tasks can read."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES_SCHEMA = "place_name string, gmaps_url string"
COMPLETE = "coalesce(place_name, '') <> '' and coalesce(gmaps_url, '') <> ''"


def scan_places(spark: SparkSession, path: str) -> DataFrame:
    """Places with ``pos``, which orders them by file name and by place in the file. A missing
    path is an error."""
    row = F.monotonically_increasing_id().alias("row")
    return (
        spark.read.schema(PLACES_SCHEMA)
        .csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
        .withColumn("pos", F.struct(F.col("_metadata.file_name").alias("file_name"), row))
    )


def complete_places(places: DataFrame) -> DataFrame:
    return places.where(COMPLETE)


def incomplete_places(places: DataFrame) -> DataFrame:
    """Side table of rows lacking a name or a URL; they stop nothing."""
    return places.where(f"not ({COMPLETE})")


def _origin(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times of the CSV's files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")


def write_places_copy(places: DataFrame, path: str, order: Sequence[str]) -> None:
    """Beside the CSV just written to ``path``, its rows as Parquet with positions by ``order``, and which files it is a copy of."""
    copy = places.select("place_name", "gmaps_url", F.struct(*order).alias("pos"))
    copy.write.mode("overwrite").parquet(f"{path.rstrip('/')}.table/rows")
    _origin(places.sparkSession, path).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}.table/origin")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Places with ``pos`` from the copy of `write_places_copy`, or, where there is none or the CSV's files are no longer
    those it was made of, from the CSV."""
    root = f"{path.rstrip('/')}.table"
    try:
        then, copy = spark.read.parquet(f"{root}/origin"), spark.read.parquet(f"{root}/rows")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return scan_places(spark, path)
    now = _origin(spark, path)
    same = now.exceptAll(then).union(then.exceptAll(now)).take(1) == []
    return copy if same else scan_places(spark, path)

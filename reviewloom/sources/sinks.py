"""Writers, and staging of results that several steps use.

Every writer looks whether there is anything to write before it touches the target. That look
runs the plan up to its first row, so `stage` costly results first, or give their ``n_rows``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.tables import FINAL_COLUMNS, project_order
from reviewloom.session import shared_path

_BOM = "\ufeff"
_CSV = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    What follows (is it empty, write it, count it) then does not run the plan again, and a lost
    executor costs no more than its own tasks. The folder's owner clears it, as for checkpoints.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def stage_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`stage`, and aggregates of the rows that are seen while they are written: no pass of its own counts them."""
    seen = Observation()
    staged = stage(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]), name)
    return staged, seen.get


def _nothing(df: DataFrame, n_rows: int | None) -> bool:
    return df.isEmpty() if n_rows is None else n_rows == 0


def write_places(
    places: DataFrame, path: str, *, mode: str = "overwrite", order: Sequence[str] = (), n_rows: int | None = None
) -> bool:
    """places list as CSV; False, and nothing touched, if there are none. With ``order`` the part
    files and their rows follow it, and `scan_places` gives positions in that order."""
    if _nothing(places, n_rows):
        return False
    if order:
        places = places.repartitionByRange(*order).sortWithinPartitions(*order)
    places.select("place_name", "gmaps_url").write.options(**_CSV).mode(mode).csv(path)
    return True


def write_documents(documents: DataFrame, path: str, *, mode: str = "append", n_rows: int | None = None) -> bool:
    """(doc_key, place_info, reviews) as JSON, one object per line, characters kept as they are."""
    if _nothing(documents, n_rows):
        return False
    documents.select("doc_key", "place_info", "reviews").write.mode(mode).json(path, ignoreNullFields=False)
    return True


def write_final(final: DataFrame, path: str, *, mode: str = "overwrite", n_rows: int | None = None) -> bool:
    """Final table as CSV with a byte order mark, so that spreadsheets read it as UTF-8. Every
    part file has its header and its mark. ``user_rating_raw`` comes last if it is there."""
    if _nothing(final, n_rows):
        return False
    ordered = project_order(final, [*FINAL_COLUMNS, "user_rating_raw"])
    first = ordered.columns[0]
    ordered.withColumnRenamed(first, _BOM + first).write.options(**_CSV).mode(mode).csv(path)
    return True


def read_final(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read `write_final` output back; blank text cells are ``""``."""
    # By position: the mark belongs to the first header cell only.
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return df.select(
        *[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )

"""Small relational steps: non-empty filter, flatten, union, projection, reports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import has_text

# Columns of the final table in their order.
FINAL_COLUMNS = [
    "user_id",
    "user_rating",
    "review_text",
    "review_time",
    "place_name",
    "place_description",
    "place_category",
    "place_attributes",
    "place_address",
    "place_total_reviews_gmaps",
    "place_avg_rating",
]


def filter_nonempty(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has something left after cleaning."""
    return df.where(has_text(F.col(text)))


def flatten(documents: DataFrame, reviews: str = "reviews", keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of the review array with its position; ``keep`` columns are repeated."""
    # The outer form spares the size check that Spark would otherwise push below the projection
    # making the array, which would then be made twice.
    tall = documents.select(*keep, F.posexplode_outer(reviews).alias("pos", "review")).where("pos is not null")
    return tall.withColumn("pos", F.col("pos").cast("bigint"))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all inputs by column name, duplicates kept."""
    for other in others:
        first = first.unionByName(other)
    return first


def project_order(df: DataFrame, order: Sequence[str] = FINAL_COLUMNS) -> DataFrame:
    """The listed columns in the listed order, those that are absent left out."""
    return df.select(*[c for c in order if c in df.columns])


def value_distribution(df: DataFrame, value: str) -> DataFrame:
    """Rows per value, nulls left out, ascending by value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(value)


def run_counts(df: DataFrame, **distinct: str | Column) -> DataFrame:
    """Row count and, for each ``name=column``, the number of distinct values, in one pass."""
    counts = [F.count_distinct(c).alias(name) for name, c in distinct.items()]
    return df.agg(F.count("*").alias("n_rows"), *counts)


def preview(df: DataFrame, *order: str | Column, n: int = 5) -> DataFrame:
    """First ``n`` rows in the given order (runs as a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)

"""Keep-first dedup and balanced sampling inside a document's review array.

A stored document is one row, so its reviews need no shuffle to meet. The results are those of
`dedup` and `sample` on the exploded rows; those are for reviews kept as a table, where the rows
of one place may be many and spread over all partitions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.numbers import STARS
from reviewloom.functions.text import clean_text
from reviewloom.functions.variants import field, field_as_text, variant_rating, variant_rating_bucket, variant_raw
from reviewloom.operators.sample import hash_key


def clean_reviews(documents: DataFrame) -> DataFrame:
    """Add ``reviews``: typed and cleaned elements with text, sorted by (user, text, pos)."""

    def typed(r, i):
        return F.struct(
            clean_text(field_as_text(r, "user_name")).alias("user"),
            clean_text(field_as_text(r, "text")).alias("text"),
            i.cast("bigint").alias("pos"),
            variant_rating_bucket(field(r, "rating")).alias("star"),
            variant_rating(field(r, "rating")).alias("rating"),
            variant_raw(field(r, "rating")).alias("rating_raw"),
            clean_text(field_as_text(r, "time")).alias("time"),
        )

    elements = F.try_variant_get("doc", "$.reviews", "array<variant>")
    reviews = F.filter(F.transform(elements, typed), lambda r: r["text"] != "")
    return documents.withColumn("reviews", F.sort_array(reviews))


def keep_first_in_array(documents: DataFrame) -> DataFrame:
    """Drop elements whose (user, text) equals their predecessor's in the sorted array."""
    reviews = F.col("reviews")

    def is_first(r, i):
        before = F.get(reviews, i - 1)
        return before.isNull() | (before["user"] != r["user"]) | (before["text"] != r["text"])

    return documents.withColumn("reviews", F.filter(reviews, is_first))


def sample_in_array(documents: DataFrame, cap: int, *, seed: int | str = 42) -> DataFrame:
    """Cut ``reviews`` to the balanced sample of at most ``cap``."""
    core_cap = cap // len(STARS)

    def ranked(purpose, by_star):
        def entry(r):
            lead = [r["star"].alias("star")] if by_star else []
            h = hash_key(seed, purpose, F.col("file"), r["pos"]).alias("h")
            return F.struct(*lead, h, r["pos"].alias("pos"), r.alias("review"))

        return entry

    over = F.size("reviews") > cap
    starred = F.filter("reviews", lambda r: r["star"].isin(*STARS))
    df = documents.withColumn("_starred", F.when(over, F.sort_array(F.transform(starred, ranked("core", True)))))

    # Sorted by star, an entry is beyond its star's share if the one `core_cap` before has its star.
    def in_core(e, i):
        ahead = F.get(F.col("_starred"), i - core_cap)
        return ahead.isNull() | (ahead["star"] != e["star"])

    core = F.filter("_starred", in_core) if core_cap else F.slice("_starred", 1, 0)
    df = df.withColumn("_core", F.transform(core, lambda e: e["review"]))
    df = df.withColumn("_core_pos", F.transform("_core", lambda r: r["pos"]))
    rest = F.filter("reviews", lambda r: ~F.array_contains("_core_pos", r["pos"]))
    df = df.withColumn("_rest", F.sort_array(F.transform(rest, ranked("fill", False))))
    free = F.slice("_rest", F.lit(1), F.lit(cap) - F.size("_core_pos"))
    picked = F.concat("_core", F.transform(free, lambda e: e["review"]))
    sample = F.when(over, picked).otherwise(F.col("reviews"))
    return df.withColumn("reviews", sample).drop("_starred", "_core", "_core_pos", "_rest")

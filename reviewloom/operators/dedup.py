"""Keep-first duplicate removal."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key: the first in ``order``, which must be unique within a key.

    Filtering ``row_number() = 1`` makes Spark drop later copies before the shuffle
    (WindowGroupLimit), so a key with very many copies sends one row per map task.
    """
    # The leading 64-bit hash settles nearly all comparisons of the sort; the keys
    # themselves stay in the partitioning, so a hash collision merges nothing.
    w = Window.partitionBy("_key_hash", *keys).orderBy(*order)
    return (
        df.withColumn("_key_hash", F.xxhash64(*keys))
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_rn", "_key_hash")
    )


def signature(*texts: Column) -> Column:
    """256-bit digest of several non-null texts; lengths go in so that texts cannot run together."""
    parts: list[Column] = []
    for t in texts[:-1]:
        parts += [F.length(t).cast("string"), F.lit(":"), t]
    return F.unhex(F.sha2(F.concat(*parts, texts[-1]), 256))


def first_positions(
    df: DataFrame, keys: Sequence[str], position: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Smallest ``position`` per key, with the ``carry`` columns of that row.

    Meant for narrow fixed-width columns: the aggregation then runs as a hash aggregate that
    combines copies on the map side, and no text is shuffled or sorted.
    """
    carried = [F.min_by(c, position).alias(c) for c in carry]
    return df.groupBy(*keys).agg(F.min(position).alias(position), *carried)


def number_copies(df: DataFrame, key: str, *, splits: int = 256) -> DataFrame:
    """Make the text column ``key`` unique: of rows that share one, the second on get ``#2``, ``#3`` and so on.

    Keys are counted first, with combined counts; only rows of repeated keys move, and those of one key in ``splits``
    parts. ``df`` is read twice and must give the same rows in the same order: a stored table.
    """
    part = F.pmod(F.monotonically_increasing_id(), F.lit(splits)).cast("int")
    # Counted and numbered by the same parts, so the parts of a key follow each other without a gap.
    parted = df.withColumn("_part", part)
    sizes = parted.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_part")  # at most ``splits`` rows a key
    before = F.sum("_n").over(w) - F.col("_n")
    sizes = sizes.withColumns({"_before": before, "_all": F.sum("_n").over(Window.partitionBy(key))}).where("_all > 1")
    starts = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_key_part"), "_before")
    joined = parted.join(starts, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_key_part")), "left")
    alone = joined.where("_key is null")
    rank = F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.lit(0))) + F.col("_before")
    again = joined.where("_key is not null").withColumn("_rank", rank)
    again = again.withColumn(key, F.when(F.col("_rank") > 1, F.concat_ws("#", key, F.col("_rank").cast("string"))).otherwise(F.col(key)))
    return alone.select(*df.columns).union(again.select(*df.columns))

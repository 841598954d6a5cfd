"""Rating-balanced sampling with a cap per group.

Of a group's ``n`` rows, ``min(n, cap)`` are taken: up to ``cap // 5`` at random from every star,
then the free places from all other rows at random. "At random" is the order of a seeded hash
of the row's id, so a run can be repeated under any partitioning.

The choice is made on (group, star, id) alone; wide rows are fetched afterwards by id. It is one aggregation whose
state is a few short lists: the ``cap // 5`` least hashes of each star and the ``cap`` least of the group by the other
hash. Map tasks cut their rows to these lists, the lists are merged behind a single exchange, and a group of any size costs
at most two times ``cap`` entries a map task. The lists hold all that is needed: the row at place ``k`` among the
left-overs has fewer than ``k`` left-overs before it, and the other rows before it are all among those taken from the stars,
so the free places are within the first ``cap`` of the group. A group of at most ``cap`` rows is within its first
``cap`` too and comes out whole without a special case.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction  # Spark's own aggregate of the k least values has no public name

from reviewloom.functions.numbers import STARS

_BUCKET_BITS, _BITS_PER_ENTRY, _HASHES = 1 << 15, 32, 4


def hash_key(seed: int | str, purpose: str, *ids: str | Column) -> Column:
    """Sort key that puts rows in a reproducible random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[_text(c) for c in ids]))


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def choose_sample(df: DataFrame, group: str, star: str, row_id: str, cap: int, *, seed: int | str = 42) -> DataFrame:
    """The chosen rows as (group, id). ``id`` must be unique in its group; a null group is a group,
    a null id an id."""
    core_cap = cap // len(STARS)
    if not cap:
        return df.select(group, row_id).where(F.lit(False))

    def entry(purpose: str) -> Column:
        # As bytes: half as long as the hex text, and in the same order.
        return F.struct(F.unhex(hash_key(seed, purpose, group, row_id)).alias("h"), F.col(row_id).alias("id"))

    def least(e: Column, n: int) -> Column:
        return InternalFunction.collect_top_k(e, n, True)

    entries = df.select(group, F.col(star).alias("_star"), entry("core").alias("_core"), entry("fill").alias("_fill"))
    stars = [least(F.when(F.col("_star") == s, F.col("_core")), core_cap).alias(f"_star{s}") for s in STARS] if core_cap else []
    lists = entries.groupBy(group).agg(least(F.col("_fill"), cap).alias("_fill"), *stars)
    ids = [F.transform(f"_star{s}", lambda e: e["id"]) for s in STARS] if core_cap else [F.array_compact(F.array(F.lit(None).cast(df.schema[row_id].dataType)))]
    core = lists.select(group, F.concat(*ids).alias("_core"), F.transform(F.sort_array("_fill"), lambda e: e["id"]).alias("_fill"))
    free = F.slice(F.array_except("_fill", "_core"), F.lit(1), F.greatest(F.lit(cap) - F.size("_core"), F.lit(0)))
    return core.select(group, F.explode(F.concat("_core", free)).alias(row_id))


def fetch(df: DataFrame, chosen: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``keys``, null included, occur in ``chosen``.

    ``chosen`` is narrow and small beside ``df``: Spark broadcasts it where its size allows, and
    then no wide row is shuffled.
    """
    other = chosen.select(*(F.col(k).alias(f"_chosen_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_chosen_{k}")) for k in keys]
    return df.join(other, reduce(lambda a, b: a & b, same), how).drop(*other.columns)


def _bits(keys: Sequence[str], n_buckets: int) -> tuple[Column, Column]:
    """Bucket of a row's keys, and the positions of its bits there, from one 64-bit hash."""
    h = F.xxhash64(*keys)
    places = [F.shiftrightunsigned(h, 15 * i).bitwiseAND(_BUCKET_BITS - 1) for i in range(_HASHES)]
    return F.pmod(F.xxhash64(h), F.lit(n_buckets)), F.array(*places)


def may_hold(df: DataFrame, chosen: DataFrame, keys: Sequence[str], n_chosen: int) -> DataFrame:
    """Rows of ``df`` whose ``keys`` may occur among the ``n_chosen`` of ``chosen``: all that do, and few others.

    A Bloom filter in buckets of 32,768 bits, four bits an entry, built by an aggregate and broadcast: 32 bits for each entry.
    """
    n_buckets = max(1, -(-n_chosen * _BITS_PER_ENTRY // _BUCKET_BITS))
    bucket, places = _bits(keys, n_buckets)
    bits = chosen.select(bucket.alias("_bucket"), F.explode(places).alias("_place"))
    filters = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bitmap"))
    joined = df.withColumns({"_bucket": bucket, "_places": places}).join(F.broadcast(filters), "_bucket")

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (place % 8 + 1).cast("int"))) != 0

    every = reduce(lambda a, b: a & b, [is_set(F.get("_places", F.lit(i))) for i in range(_HASHES)])
    return joined.where(every).select(*df.columns)


def fetch_stored(df: DataFrame, chosen: DataFrame, keys: Sequence[str], n_chosen: int, *, filter_bytes: int = 128 << 20) -> DataFrame:
    """`fetch` for a stored ``chosen`` of ``n_chosen`` distinct rows: what cannot be among them is dropped before it is
    shuffled, as long as the filter for that takes at most ``filter_bytes``."""
    if n_chosen * _BITS_PER_ENTRY // 8 <= filter_bytes:
        df = may_hold(df, chosen, keys, n_chosen)
    return fetch(df, chosen, keys, "inner")  # a semi join would be moved below the filter


def stratified_sample(df: DataFrame, group: str, star: str, row_id: str, cap: int, *, seed: int | str = 42) -> DataFrame:
    """Whole rows of the balanced sample; see the module text."""
    return fetch(df, choose_sample(df, group, star, row_id, cap, seed=seed), [group, row_id])


def with_shuffle_rank(df: DataFrame, *ids: str, seed: int | str = 42) -> DataFrame:
    """Add ``shuffle_rank``, the sort key of a random row order. Sorting by it is left to the reader."""
    return df.withColumn("shuffle_rank", hash_key(seed, "order", *ids))


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, *, splits: int = 256) -> DataFrame:
    """First ``n`` rows of every group. Up to Spark's limit for it (1000 rows) map tasks cut what
    they send; beyond, a group is first cut in ``splits`` parts, so that no task gets it whole."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        # By the order's own columns: the same for any partitioning, and ties do not matter.
        part = df.withColumn("_split", F.pmod(F.xxhash64(*order), F.lit(splits)))
        w = Window.partitionBy(*group, "_split").orderBy(*order)
        df = part.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_split")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")

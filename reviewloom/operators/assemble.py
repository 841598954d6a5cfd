"""Places and pages to place documents, leaving out what is done."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import sanitize_key
from reviewloom.operators.dedup import keep_first


def with_doc_key(places: DataFrame) -> DataFrame:
    """Add ``doc_key``, the name a place's document goes by."""
    return places.withColumn("doc_key", sanitize_key(F.col("place_name")))


def skip_done(places: DataFrame, done: DataFrame) -> DataFrame:
    """Places whose ``doc_key`` is not in ``done``. Both sides are narrow; Spark broadcasts
    ``done`` if it turns out small enough and shuffles otherwise."""
    return places.join(done.select("doc_key"), "doc_key", "left_anti")


def usable_places(places: DataFrame) -> DataFrame:
    """Places whose name gives a key; the others would all go by the same empty one."""
    return places.where("doc_key <> ''")


def one_page_per_url(extracted: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Of several stored versions of a page the first in ``order``."""
    return keep_first(extracted, ["url"], order)


def assemble(places: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_key, place_info, reviews) for places (doc_key, pos, place_name, gmaps_url) that have
    an extracted page (url, place_info, reviews; one per url).

    The listing's name replaces the page's. Of places with one key the first that has a page wins.
    That is decided on keys alone; review arrays are joined once, for the winners. ``extracted`` is
    read twice, so stage it.
    """
    # Places alike in key and URL share the page, so only their first can win; this also thins out
    # a URL that a listing repeats over and over before it becomes a join key.
    places = keep_first(places, ["doc_key", "gmaps_url"], ["pos"])
    have = extracted.select(F.col("url").alias("gmaps_url"))
    winners = keep_first(places.join(have, "gmaps_url", "left_semi"), ["doc_key"], ["pos"])
    joined = winners.select("doc_key", "place_name", "gmaps_url").join(extracted, F.col("gmaps_url") == F.col("url"))
    return joined.select("doc_key", F.col("place_info").withField("name", F.col("place_name")).alias("place_info"), "reviews")

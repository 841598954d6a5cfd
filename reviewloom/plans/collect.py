"""Stored pages to places lists and place documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.assemble import assemble, one_page_per_url, skip_done, usable_places, with_doc_key
from reviewloom.operators.extract import CARD_CAP, picked_links, place_pages
from reviewloom.sources.places import complete_places
from reviewloom.sources.sinks import stage


def list_places(pages: DataFrame) -> DataFrame:
    """Every labelled link of the listing pages (url, html)."""
    return picked_links(pages)


def places_to_do(places: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Usable places with their keys, without those whose key is in ``done``."""
    todo = usable_places(with_doc_key(complete_places(places)))
    return todo if done is None else skip_done(todo, done)


def wanted_pages(todo: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that some place left to do refers to. Spark broadcasts the URLs where their size
    allows; where they are many, pages of a store (`sources.pages`) are read by bucket, and no HTML is shuffled."""
    return pages.join(todo.select(F.col("gmaps_url").alias("url")), "url", "left_semi")


def collect_documents(
    places: DataFrame, pages: DataFrame, done: DataFrame | None = None, *, card_cap: int = CARD_CAP, newest: str | None = None
) -> DataFrame:
    """Documents of the places (pos, place_name, gmaps_url) that are not ``done`` yet.

    Only pages still wanted are read, and they are reduced to their fields before they are joined.
    Of several versions of a page the one with the greatest ``newest`` (a column of ``pages``, such
    as the time of fetching) that qualifies counts, by digest where that ties or is not given. The
    extracted fields are staged, as two steps use them.
    """
    return collect_pages(places_to_do(places, done), pages, card_cap=card_cap, newest=newest)


def collect_pages(todo: DataFrame, pages: DataFrame, *, card_cap: int = CARD_CAP, newest: str | None = None) -> DataFrame:
    """`collect_documents` for places (doc_key, pos, place_name, gmaps_url) that are all to be done."""
    rank = F.col(newest) if newest else F.lit(0)
    kept = wanted_pages(todo, pages.select("url", rank.alias("_rank"), F.sha2("html", 256).alias("_digest"), "html"))
    extracted = one_page_per_url(place_pages(kept, card_cap=card_cap), [F.col("_rank").desc_nulls_last(), F.col("_digest")])
    return assemble(todo, stage(extracted.drop("_rank", "_digest"), "pages"))

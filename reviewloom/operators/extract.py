"""Places, metadata and review cards out of stored pages."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.numbers import decimal_comma
from reviewloom.functions.text import first_line, is_nonblank, list_to_text
from reviewloom.operators.html_pick import All, Count, Css, Each, Exists, First, Pick, pick_elements

CARD_CAP = 400  # fixed value: reviews kept per page

# Where a listing page and a place page keep their fields.
LISTING_PICKS: Mapping[str, Pick] = {
    "links": Each(
        (Css("a", ("hfpxzc",)),),
        {"place_name": First(attr="aria-label"), "gmaps_url": First(attr="href")},
    ),
}
_NAME = (Css(classes=("DUwDvf", "lfPIob")),)
_SUMMARY = (Css(classes=("fontBodyMedium", "dmRWX")),)
_TAB = (Css("div", ("Gpq6kf", "NlVald")),)
PLACE_PICKS: Mapping[str, Pick] = {
    "has_name": Exists(_NAME),
    "has_h1": Exists((Css("h1"),)),
    "name": First(_NAME),
    "avg_rating": First((Css("span", attr="aria-hidden", equals="true"),), within=_SUMMARY),
    "total_reviews_text": First(
        (Css("span", attr="aria-label", contains=("ulasan", "reviews")),), attr="aria-label", within=_SUMMARY
    ),
    "category": First((Css("button", ("DkEaL",)),)),
    "address": First((Css(classes=("Io6YTe", "fontBodyMedium", "kR99db", "fdkmkc")),)),
    "about_tab": Exists(_TAB, ("Tentang", "About")),
    "description": First((Css("span", ("HlvSq",)),)),
    "attribute_items": All((Css("ul", ("ZQ6we",)), Css("li", ("hpLkke",)))),
    "review_tab": Exists(_TAB, ("Ulasan", "Reviews")),
    "cards": Each(
        (Css("div", attr="data-review-id"),),
        {
            "text": First((Css(classes=("wiI7pd",)),)),
            "user": First((Css(classes=("d4r55", "fontTitleMedium")),)),
            "stars": Count((Css("span", ("hCCjke",)),), within=(Css(classes=("DU9Pgb",)),)),
            "time": First((Css(classes=("rsqaWe",)),)),
        },
    ),
}


# ---- patterns, for markup regular enough for them: stays in the JVM --------------------------


def all_matches(html: Column, pattern: str, group: int = 1) -> Column:
    """Array of a group of every match, in page order."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def first_match(html: Column, pattern: str, default: str = "") -> Column:
    """Group 1 of the first match; ``default`` only if nothing matches, an empty match stays empty."""
    return F.coalesce(F.get(all_matches(html, pattern), F.lit(0)), F.lit(default))


def matched_links(pages: DataFrame, pattern: str, *, html: str = "html") -> DataFrame:
    """(…keys, pos, place_name, gmaps_url) of every link, those without a label or a target left out.
    ``pattern`` has the target as group 1 and the label as group 2."""
    keys = [c for c in pages.columns if c != html]
    pairs = F.arrays_zip(
        all_matches(F.col(html), pattern, 1).alias("url"), all_matches(F.col(html), pattern, 2).alias("name")
    )
    links = pages.select(*keys, F.posexplode(pairs).alias("pos", "link"))
    return links.select(
        *keys, F.col("pos").cast("bigint"), F.col("link.name").alias("place_name"), F.col("link.url").alias("gmaps_url")
    ).where("place_name <> '' and gmaps_url <> ''")


def first_blocks(pages: DataFrame, blocks: Column, n: int, *, keys: Sequence[str]) -> DataFrame:
    """(…keys, pos, text) of the first ``n`` non-blank blocks of a page, without a shuffle."""
    kept = F.slice(F.filter(blocks, is_nonblank), 1, n)
    return pages.select(*keys, F.posexplode(kept).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))


# ---- class-token selectors -------------------------------------------------------------------


def picked_links(pages: DataFrame, picks: Mapping[str, Pick] = LISTING_PICKS, *, html: str = "html") -> DataFrame:
    """Like `matched_links`, by selector."""
    keys = [c for c in pages.columns if c != html]
    links = pick_elements(pages, picks, html=html).select(*keys, F.posexplode("links").alias("pos", "link"))
    return links.select(*keys, F.col("pos").cast("bigint"), "link.place_name", "link.gmaps_url").where(
        "place_name <> '' and gmaps_url <> ''"
    )


def _may_match(html: Column, pick: Pick) -> Column:
    """Cheap test, done in the JVM, that is true for every page on which ``pick`` finds something:
    most pages that cannot qualify are never handed to Python."""
    last = pick.path[-1]
    if last.classes:
        return html.contains(last.classes[0])
    return F.lower(html).contains(f"<{last.tag}") if last.tag else html.isNotNull()


def place_pages(
    pages: DataFrame, picks: Mapping[str, Pick] = PLACE_PICKS, *, html: str = "html", card_cap: int = CARD_CAP
) -> DataFrame:
    """Qualifying pages as (…keys, place_info, reviews).

    A page qualifies if it shows a place name or any ``h1``. Description and attributes count
    only with an about tab, reviews only with a review tab. Reviews without text are dropped
    before the first ``card_cap`` are taken.
    """
    keys = [c for c in pages.columns if c != html]
    possible = pages.where(_may_match(F.col(html), picks["has_name"]) | _may_match(F.col(html), picks["has_h1"]))
    page = pick_elements(possible, picks, html=html).where("has_name or has_h1")

    def text(c: str, default: str = "") -> Column:
        return F.coalesce(F.col(c), F.lit(default)).alias(c)

    about = F.coalesce(F.col("about_tab"), F.lit(False))
    info = F.struct(
        text("name"),
        text("category"),
        F.coalesce(decimal_comma(F.col("avg_rating")), F.lit("0")).alias("avg_rating"),
        text("total_reviews_text"),
        text("address"),
        F.coalesce(F.when(about, F.col("description")), F.lit("")).alias("description"),
        F.coalesce(F.when(about, list_to_text(F.col("attribute_items"))), F.lit("")).alias("attributes"),
    )

    def review(card: Column) -> Column:
        return F.struct(
            F.coalesce(first_line(card["user"]), F.lit("Anonymous")).alias("user_name"),
            F.coalesce(card["stars"], F.lit(0)).alias("rating"),
            card["text"].alias("text"),
            F.coalesce(card["time"], F.lit("")).alias("time"),
        )

    cards = F.slice(F.filter("cards", lambda c: is_nonblank(c["text"])), 1, card_cap)
    reviews = F.when(F.col("review_tab"), F.transform(cards, review)).otherwise(F.array())
    return page.select(*keys, info.alias("place_info"), reviews.alias("reviews"))

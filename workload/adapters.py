"""Test tables in the shape the operators expect. Nothing is invented beyond a few columns
computed from the given ones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30 01:00:00"

TIME_PHRASES = [
    "2 jam yang lalu",
    "3 hari yang lalu",
    "1 minggu yang lalu",
    "2 bulan lalu",
    "setahun lalu",
    "Diedit 5 bulan lalu",
    "baru saja",
    "2 jam 30 menit",
    "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrase(row_id: Column) -> Column:
    """A time phrase picked by row id; some of the numbers vary with it."""
    pick = F.element_at(F.array(*[F.lit(p) for p in TIME_PHRASES]), (row_id % 9 + 1).cast("int"))
    return F.when(row_id % 9 == 1, F.concat((row_id % 400).cast("string"), F.lit(" hari lalu"))).otherwise(pick)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as reviews; a language is a place. One language holds most of the rows."""
    d = table(spark, sf_dir, "documents")
    rating = ((F.col("doc_id") * 7) % 11 % 8).cast("int")
    return d.select(
        F.col("lang").alias("file"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("User "), (F.col("n_chars") % 37).cast("string")).alias("user_name"),
        "text",
        phrase(F.col("doc_id")).alias("time"),
        rating.alias("rating"),
        F.when(rating.between(1, 5), rating).otherwise(0).alias("rating_bucket"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of place columns per language."""
    from reviewloom.functions import clean_attributes, parse_int, parse_rating

    per_lang = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    n = F.col("n").cast("string")
    return per_lang.select(
        F.col("lang").alias("file"),
        F.concat(F.lit("Place "), "lang").alias("place_name"),
        F.concat(F.lit("Reviews in "), "lang").alias("place_description"),
        F.lit("language").alias("place_category"),
        clean_attributes(F.concat(F.lit("- "), "lang", F.lit(" |  | * "), n, F.lit(" texts"))).alias(
            "place_attributes"
        ),
        F.concat(F.lit("Shelf "), "lang").alias("place_address"),
        parse_int(F.concat(n, F.lit(" ulasan"))).alias("place_total_reviews_gmaps"),
        parse_rating(F.concat((F.col("n") % 5).cast("string"), F.lit(","), (F.col("n") % 10).cast("string"))).alias(
            "place_avg_rating"
        ),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("file"),
        F.col("turn").alias("pos"),
        F.col("role").alias("user_name"),
        "text",
    )


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ratings: a user is a place."""
    e = table(spark, sf_dir, "events")
    star = F.floor("value").cast("bigint") % 7
    return e.select(
        F.col("user_id").alias("file"),
        F.col("event_id").alias("pos"),
        F.when(star.between(1, 5), star).otherwise(0).cast("int").alias("rating_bucket"),
        "event_type",
    )


LINK = r'<li><a href="([^"]*)">([^<]*)</a></li>'
BLOCK_SIZE = 40  # consecutive documents that make up one place document


def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A places list naming every page, two pages to a name."""
    name = F.concat(F.lit("Page #"), F.floor(F.col("page_id") / 2).cast("string"), F.lit("!"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"), name.alias("place_name"), F.col("url").alias("gmaps_url")
    )


def done_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys an earlier run is taken to have collected: those of the German pages."""
    key = F.concat(F.lit("Page "), F.floor(F.col("page_id") / 2).cast("string"))
    return table(spark, sf_dir, "pages").where(F.col("url").contains("/de/")).select(key.alias("doc_key")).distinct()


def place_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in blocks of consecutive ids as JSON place documents (file, value), some of them
    broken in various ways. A block is bounded, so is its array."""
    d = table(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / BLOCK_SIZE)
    review = F.struct(
        F.concat(F.lit("User "), (F.col("n_chars") % 3).cast("string")).alias("user_name"),
        ((F.col("doc_id") * 7) % 11 % 8).alias("rating"),
        "text",
        phrase(F.col("doc_id")).alias("time"),
    )
    blocks = d.groupBy(block.alias("b")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("doc_id", review.alias("r")))), lambda x: x["r"]).alias("reviews")
    )
    b = F.col("b").cast("string")
    info = F.struct(
        F.concat(F.lit(" Block  "), b).alias("name"),
        F.concat(F.lit("4,"), (F.col("b") % 10).cast("string")).alias("avg_rating"),
        F.concat(b, F.lit(".000 ulasan")).alias("total_reviews_text"),
        F.lit("Parking: Free |  | - WC").alias("attributes"),
    )
    file = F.concat(F.lit("block"), b)
    text = F.to_json(F.struct(file.alias("doc_key"), info.alias("place_info"), "reviews"))
    value = (
        F.when(F.col("b") % 10 == 3, F.substring(text, F.lit(1), F.length(text) - 5))
        .when(F.col("b") % 10 == 5, F.concat(text, F.lit(" x}")))
        .when(F.col("b") % 10 == 7, F.replace(text, F.lit('"reviews":['), F.lit('"reviews":[3,')))
        .when(F.col("b") % 10 == 8, F.concat(F.lit('{"doc_key":"'), file, F.lit('","place_info":null}')))
        .otherwise(text)
    )
    return blocks.select(file.alias("file"), value.alias("value"))


def order_ratings() -> Column:
    """Orders as JSON objects with a rating of each JSON type, or none."""
    k = F.col("o_orderkey")
    value = (
        F.when(k % 9 == 0, F.lit("null"))
        .when(k % 9 == 1, (k % 6).cast("string"))
        .when(k % 9 == 2, F.concat((k % 6).cast("string"), F.lit(".5")))
        .when(k % 9 == 3, F.concat(F.lit('"'), (k % 6).cast("string"), F.lit('"')))
        .when(k % 9 == 4, F.lit('"good"'))
        .when(k % 9 == 5, F.lit("true"))
        .when(k % 9 == 6, F.lit("9999999999"))
        .when(k % 9 == 7, F.lit("[5]"))
    )
    return F.coalesce(F.concat(F.lit('{"rating":'), value, F.lit("}")), F.lit("{}"))


def place_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' titles and paragraph counts in the markup of place pages: page_id, url, html. Every
    third page has no heading, every second of the others no about tab, every fifth no review tab."""
    i = F.col("page_id")
    n = F.regexp_count("html", F.lit("<p>"))
    text = i.cast("string")

    def card(k: Column) -> Column:
        at = k.cast("string")
        return F.concat(
            F.lit('<div class="jftiEf" data-review-id="'), at, F.lit('"><div class="d4r55 fontTitleMedium">User '), at, F.lit("<br>Guide</div>"),
            F.lit('<div class="DU9Pgb">'), F.repeat(F.lit('<span class="hCCjke"></span>'), (k % 6).cast("int")), F.lit('</div><span class="rsqaWe">'), at,
            F.lit(' weeks ago</span><span class="wiI7pd">'), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Text "), at)), F.lit("</span></div>"),
        )

    parts = [
        F.when(i % 3 != 0, F.concat(F.lit('<h1 class="DUwDvf lfPIob">Place '), text, F.lit("</h1>"))),
        F.concat(F.lit('<div class="fontBodyMedium dmRWX"><span aria-hidden="true">'), (i % 5).cast("string"), F.lit(","), (i % 10).cast("string"),
                 F.lit('</span><span aria-label="'), text, F.lit(' reviews"></span></div><button class="DkEaL">Kind '), (i % 7).cast("string"),
                 F.lit('</button><div class="Io6YTe fontBodyMedium kR99db fdkmkc">Street '), text, F.lit("</div>")),
        F.when(i % 2 == 0, F.lit('<div class="Gpq6kf NlVald">About</div>')),
        F.concat(F.lit('<span class="HlvSq">About it</span><ul class="ZQ6we"><li class="hpLkke">a</li><li class="hpLkke">b'), text, F.lit("</li></ul>")),
        F.when(i % 5 != 0, F.lit('<div class="Gpq6kf NlVald">Reviews</div>')),
        F.array_join(F.transform(F.sequence(F.lit(1), n + 1), card), ""),
    ]
    html = F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))

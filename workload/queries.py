"""One callable per operator: (spark, sf_dir) -> DataFrame, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom import functions as fn
from reviewloom.operators.assemble import assemble, one_page_per_url, skip_done, with_doc_key
from reviewloom.operators.dedup import keep_first
from reviewloom.operators.extract import all_matches, first_blocks, first_match, matched_links, picked_links, place_pages
from reviewloom.operators.html_pick import All, Count, Css, Each, Exists, First, pick_elements
from reviewloom.operators.sample import first_n, stratified_sample, with_shuffle_rank
from reviewloom.operators.tables import (
    filter_nonempty,
    preview,
    project_order,
    run_counts,
    union_all,
    value_distribution,
)
from reviewloom.plans.collect import collect_documents, wanted_pages
from reviewloom.plans.curate import curate_documents, curate_large_documents, curate_reviews
from reviewloom.session import shared_path
from reviewloom.sources import sinks
from reviewloom.sources.pages import read_pages, write_page_store
from reviewloom.sources.places import scan_places
from reviewloom.sources.store import DocumentStore
from reviewloom.sources.documents import accepted, blank_rejected, document_reviews, parse_documents, place_fields, scan_documents
from workload import adapters as a
from workload.adapters import AS_OF, LINK, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- scalar functions ------------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.clean_text(F.col("text")).alias("clean"))


@query
def clean_attributes(spark, sf_dir):
    piped = F.replace(F.col("text"), F.lit(". "), F.lit(" | "))
    return table(spark, sf_dir, "documents").select("doc_id", fn.clean_attributes(piped).alias("attributes"))


@query
def anonymize_user(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.when(key % 50 == 0, "").when(key % 50 == 1, " ").when(key % 50 == 2, None).otherwise(
        F.concat(F.lit("  "), "c_name", F.lit("\t"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", fn.anonymize_user(name).alias("user_id"))


@query
def relative_time(spark, sf_dir):
    return a.reviews(spark, sf_dir).select(
        "pos", "time", fn.relative_time(F.col("time"), AS_OF).alias("review_time")
    )


@query
def relative_time_orders(spark, sf_dir):
    """Counted back from a column, not from one instant."""
    unit = F.element_at(
        F.array(*[F.lit(u) for u in ("menit", "jam", "hari", "minggu", "bulan", "tahun")]),
        (F.col("o_orderkey") % 6 + 1).cast("int"),
    )
    text = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(" "), unit, F.lit(" yang lalu"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fn.relative_time(text, F.col("o_orderdate")).alias("back_then")
    )


@query
def parse_int(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 20 == 0, "ulasan").when(key % 20 == 1, None).otherwise(
        F.concat(F.format_string("%d.%03d", (key / 1000).cast("bigint"), key % 1000), F.lit(" ulasan"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.parse_int(text).alias("n_reviews"))


@query
def parse_rating(spark, sf_dir):
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    text = (
        F.when(key % 10 == 0, F.replace(price, F.lit("."), F.lit(",")))
        .when(key % 10 == 1, F.concat(price, F.lit("f")))
        .when(key % 10 == 2, F.concat(F.lit("1."), price))
        .when(key % 10 == 3, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(key % 10 == 4, None)
        .otherwise(price)
    )
    return table(spark, sf_dir, "part").select("p_partkey", fn.parse_rating(text).alias("rating"))


@query
def rating_bucket(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        fn.rating_bucket(F.col("l_quantity") / 8 - 0.5).cast("bigint").alias("bucket"),
    )


@query
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.slugify(F.col("text")).alias("slug"))


@query
def sanitize_key(spark, sf_dir):
    name = F.concat("c_name", F.lit(" / Ñ-"), "c_mktsegment", F.lit(": "))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.sanitize_key(name).alias("safe_name"))


@query
def first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.first_line(F.col("text")).alias("line"))


@query
def nonblank_filter(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 0, "\n \ufeff").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where(fn.is_nonblank(text)).select("doc_id")


@query
def variant_default(spark, sf_dir):
    """Absent key, null and value kept apart."""
    k = F.col("event_id") % 3
    props = F.when(k == 0, F.lit("{}")).when(k == 1, F.lit('{"k": null}')).otherwise(F.col("props"))
    v = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(props).alias("v"))
    x = fn.field(F.col("v"), "k")
    state = F.when(x.isNull(), "default").when(F.is_variant_null(x), "null").otherwise("value")
    return v.select(
        "event_id",
        state.alias("state"),
        F.coalesce(F.try_variant_get(x, "$", "bigint"), F.lit(0).cast("bigint")).alias("k"),
    )


# ---- relational operators --------------------------------------------------------------------


@query
def filter_nonempty_reviews(spark, sf_dir):
    text = F.when(F.col("doc_id") % 7 == 0, " \n　").otherwise(F.col("text")).alias("text")
    return filter_nonempty(table(spark, sf_dir, "documents").select("doc_id", text), "text").select("doc_id")


@query
def dedup_keep_first(spark, sf_dir):
    cleaned = a.reviews(spark, sf_dir).where(fn.has_text(F.col("text"))).select(
        "file",
        "pos",
        fn.clean_text(F.col("user_name")).alias("user"),
        fn.clean_text(F.col("text")).alias("text"),
        F.col("rating").cast("bigint").alias("rating"),
    )
    return keep_first(cleaned, ["file", "user", "text"], ["pos"])


@query
def dedup_turns(spark, sf_dir):
    cleaned = filter_nonempty(a.turns(spark, sf_dir), "text").select(
        "file", "pos", "user_name", fn.clean_text(F.col("text")).alias("text")
    )
    return keep_first(cleaned, ["file", "user_name", "text"], ["pos"])


@query
def stratified_sample_reviews(spark, sf_dir):
    picked = stratified_sample(a.reviews(spark, sf_dir), "file", "rating_bucket", "pos", 150)
    return picked.select("file", "pos", F.col("rating").cast("bigint").alias("rating"), "text")


@query
def stratified_sample_events(spark, sf_dir):
    picked = stratified_sample(a.event_ratings(spark, sf_dir), "file", "rating_bucket", "pos", 50)
    return picked.select("file", "pos", F.col("rating_bucket").cast("bigint").alias("bucket"), "event_type")


@query
def shuffle_rank(spark, sf_dir):
    return with_shuffle_rank(a.event_ratings(spark, sf_dir).select("file", "pos"), "file", "pos")


@query
def union_files(spark, sf_dir):
    """Rows of several sources appended, duplicates across them kept."""
    r = a.reviews(spark, sf_dir).select("pos", "text")
    t = a.turns(spark, sf_dir).select("text", "pos")
    return union_all(r, t, r.select("text", "pos"))


@query
def project_order_orders(spark, sf_dir):
    order = ["o_orderpriority", "not_there", "o_orderkey", "o_totalprice"]
    return project_order(table(spark, sf_dir, "orders"), order)


@query
def rating_distribution(spark, sf_dir):
    r = a.reviews(spark, sf_dir).select(
        F.when(F.col("pos") % 13 != 0, F.col("rating").cast("bigint")).alias("user_rating")
    )
    return value_distribution(r, "user_rating")


@query
def run_counts_reviews(spark, sf_dir):
    return run_counts(a.reviews(spark, sf_dir), n_places="file", n_users="user_name")


@query
def preview_orders(spark, sf_dir):
    return preview(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey"
    )


@query
def curated_reviews(spark, sf_dir):
    """The flagship: the final table from raw reviews."""
    final = curate_reviews(a.reviews(spark, sf_dir), a.places(spark, sf_dir), as_of=AS_OF)
    return final.withColumn("user_rating", F.col("user_rating").cast("bigint"))


# ---- pages -----------------------------------------------------------------------------------


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html")


@query
def extract_links(spark, sf_dir):
    return matched_links(_pages(spark, sf_dir), LINK)


@query
def picked_page_links(spark, sf_dir):
    """The same links by selector instead of by pattern, entities decoded."""
    picks = {"links": Each((Css("li"), Css("a")), {"place_name": First(), "gmaps_url": First(attr="href")})}
    return picked_links(_pages(spark, sf_dir), picks)


@query
def pages_qualified(spark, sf_dir):
    html = F.col("html")
    primary = F.regexp_like(html, F.lit(r'class="[^"]*lfPIob'))
    return _pages(spark, sf_dir).where(primary | F.regexp_like(html, F.lit(r"<h1[\s>]"))).select("page_id")


@query
def page_metadata(spark, sf_dir):
    html = F.col("html")
    return _pages(spark, sf_dir).select(
        "page_id",
        first_match(html, r"(?s)<h1>(.*?)</h1>").alias("name"),
        first_match(html, r'<html lang="([^"]*)"').alias("category"),
        fn.decimal_comma(first_match(html, r'<span aria-hidden="true">([^<]*)</span>', "0")).alias("avg_rating"),
        first_match(html, r'aria-label="([^"]*(?:ulasan|reviews)[^"]*)"').alias("total_reviews_text"),
        first_match(html, r"(?s)<footer>(.*?)</footer>").alias("address"),
    )


@query
def page_attributes(spark, sf_dir):
    html = F.col("html")
    return _pages(spark, sf_dir).select(
        "page_id",
        first_match(html, r'<div class="ad">([^<]*)</div>').alias("description"),
        fn.list_to_text(all_matches(html, r"<p>([^<]*)")).alias("attributes"),
    )


@query
def page_blocks(spark, sf_dir):
    return first_blocks(_pages(spark, sf_dir), all_matches(F.col("html"), r"<p>([^<]*)"), 400, keys=["page_id"])


@query
def first_n_per_page(spark, sf_dir):
    """First rows of a group kept as a table."""
    return first_n(matched_links(_pages(spark, sf_dir), LINK), ["page_id"], ["pos"], 3)


@query
def picked_page_blocks(spark, sf_dir):
    """Paragraphs of messy markup, unclosed ones included."""
    blocks = pick_elements(_pages(spark, sf_dir), {"p": All((Css("p"),)), "name": First((Css("h1"),))})
    return blocks.select("page_id", "name", F.posexplode("p").alias("pos", "text")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


# Where the test pages keep what a place page has: links stand for attributes, paragraphs for cards.
PAGE_PICKS = {
    "has_name": Exists((Css(classes=("DUwDvf", "lfPIob")),)),
    "has_h1": Exists((Css("h1"),)),
    "name": First((Css("h1"),)),
    "avg_rating": First((Css("span", attr="aria-hidden", equals="true"),)),
    "total_reviews_text": First((Css(attr="aria-label", contains=("ulasan", "reviews")),), attr="aria-label"),
    "category": First((Css("html"),), attr="lang"),
    "address": First((Css("footer"),)),
    "about_tab": Exists((Css("nav"),)),
    "description": First((Css("div", ("ad",)),)),
    "attribute_items": All((Css("nav"), Css("li"))),
    "review_tab": Exists((Css("article"),)),
    "cards": Each(
        (Css("p"),),
        {"text": First(), "user": First((Css("b"),)), "stars": Count((Css("br"),), within=(Css("b"),)), "time": First((Css("i"),))},
    ),
}


@query
def place_page_info(spark, sf_dir):
    extracted = place_pages(_pages(spark, sf_dir), PAGE_PICKS)
    return extracted.select("page_id", "place_info.*", F.size("reviews").cast("bigint").alias("n_reviews"))


def _assembled(spark, sf_dir):
    todo = skip_done(with_doc_key(a.page_places(spark, sf_dir)), a.done_keys(spark, sf_dir))
    pages = table(spark, sf_dir, "pages").select("url", F.sha2("html", 256).alias("digest"), "html")
    extracted = one_page_per_url(place_pages(wanted_pages(todo, pages), PAGE_PICKS), ["digest"])
    return assemble(todo, sinks.stage(extracted.drop("digest"), "extracted"))


@query
def assemble_documents(spark, sf_dir):
    return _assembled(spark, sf_dir).select(
        "doc_key", F.col("place_info.name").alias("name"), F.posexplode("reviews").alias("pos", "r")
    ).select("doc_key", "name", F.col("pos").cast("bigint").alias("pos"), F.col("r.text").alias("text"))


@query
def collect_place_documents(spark, sf_dir):
    """The whole collecting plan with the place-page selectors; these pages hold headings only."""
    pages = table(spark, sf_dir, "pages")
    docs = collect_documents(a.page_places(spark, sf_dir), pages, a.done_keys(spark, sf_dir))
    return docs.select(
        "doc_key",
        "place_info.name",
        "place_info.avg_rating",
        F.size("reviews").cast("bigint").alias("n_reviews"),
    )


@query
def incremental_skip(spark, sf_dir):
    todo = skip_done(with_doc_key(a.page_places(spark, sf_dir)), a.done_keys(spark, sf_dir))
    return keep_first(todo, ["doc_key"], ["pos"]).select("doc_key", "pos", "place_name", "gmaps_url")


# ---- documents, files ------------------------------------------------------------------------


@query
def quarantine(spark, sf_dir):
    parsed = parse_documents(a.place_documents(spark, sf_dir))
    return parsed.select("file", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


@query
def flatten_documents(spark, sf_dir):
    docs = blank_rejected(parse_documents(a.place_documents(spark, sf_dir)))
    tall = document_reviews(docs)
    return tall.select("file", "pos", "user_name", "text", "time", F.col("rating").cast("bigint").alias("rating"))


@query
def place_fields_of_documents(spark, sf_dir):
    docs = place_fields(accepted(parse_documents(a.place_documents(spark, sf_dir))))
    return docs.drop("doc")


@query
def scan_written_documents(spark, sf_dir):
    """Documents written as lines, scanned again, counted by what became of them."""
    path = shared_path(spark, "lines")
    a.place_documents(spark, sf_dir).select("value").write.text(path)
    parsed = parse_documents(scan_documents(spark, path, layout="line", pattern="*.txt"))
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("")).alias("reject_reason")).agg(
        F.count("*").alias("n_docs"), F.count_distinct("file").alias("n_files")
    )


@query
def scan_document_files(spark, sf_dir):
    """The same with one document per file."""
    path = shared_path(spark, "files")
    a.place_documents(spark, sf_dir).select("value").write.option("maxRecordsPerFile", 1).text(path)
    parsed = parse_documents(scan_documents(spark, path, layout="file", pattern="*.txt"))
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("")).alias("reject_reason")).agg(
        F.count("*").alias("n_docs"), F.count_distinct("file").alias("n_files")
    )


@query
def ratings_as_given(spark, sf_dir):
    """Ratings of all JSON types: number for the table, bucket, and the text they were given as."""
    v = F.parse_json(a.order_ratings())
    rating = fn.field(v, "rating")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.coalesce(fn.variant_rating(rating).cast("bigint"), F.lit(-1)).alias("rating"),
        fn.variant_rating_bucket(rating).cast("bigint").alias("bucket"),
        F.coalesce(fn.variant_raw(rating), F.lit("none")).alias("raw"),
    )


@query
def place_page_picks(spark, sf_dir):
    """Place pages in their own markup, some without a name: every field other than its default."""
    extracted = place_pages(a.place_markup(spark, sf_dir))
    last = F.try_element_at("reviews", F.lit(-1))
    return extracted.select(
        "page_id", "place_info.*", F.size("reviews").cast("bigint").alias("n_reviews"),
        *(F.coalesce(last[c], F.lit("")).alias(f"last_{c}") for c in ("user_name", "text", "time")),
        F.coalesce(last["rating"].cast("bigint"), F.lit(-1)).alias("last_rating"),
    )


@query
def newest_page_wins(spark, sf_dir):
    """Two stored versions of every page; places are collected from the later one."""
    old = a.place_markup(spark, sf_dir)
    pages = old.withColumn("fetched", F.lit(1)).union(old.withColumn("html", F.replace("html", F.lit("Place "), F.lit("New place "))).withColumn("fetched", F.lit(2)))
    places = old.select(F.col("page_id").alias("pos"), F.concat(F.lit("p"), "page_id").alias("place_name"), F.col("url").alias("gmaps_url"))
    docs = collect_documents(places, pages, newest="fetched")
    return docs.select("doc_key", "place_info.name", "place_info.description", F.size("reviews").cast("bigint").alias("n_reviews"))


@query
def documents_json_roundtrip(spark, sf_dir):
    path = shared_path(spark, "documents")
    sinks.write_documents(_assembled(spark, sf_dir), path)
    docs = blank_rejected(parse_documents(scan_documents(spark, path, layout="line")))
    return document_reviews(docs).select("file", "pos", "user_name", F.col("rating").cast("bigint").alias("rating"), "text")


@query
def places_csv_roundtrip(spark, sf_dir):
    """Listing order written, then places scanned with the positions they get from it."""
    path = shared_path(spark, "places")
    sinks.write_places(matched_links(_pages(spark, sf_dir), LINK), path, order=["page_id", "pos"])
    places = scan_places(spark, path)
    files = places.groupBy("pos.file_name").agg(F.count("*").alias("n"))
    before = files.withColumn("before", F.sum("n").over(Window.orderBy("file_name")) - F.col("n"))  # a row per part file
    within = F.row_number().over(Window.partitionBy("file_name").orderBy("row"))
    numbered = places.select("pos.*", "place_name", "gmaps_url").withColumn("nth", within).join(before, "file_name")
    return numbered.select((F.col("before") + F.col("nth")).cast("bigint").alias("place"), "place_name", "gmaps_url")


@query
def curated_documents(spark, sf_dir):
    """The final table from JSON documents, all within their rows."""
    final = curate_documents(a.place_documents(spark, sf_dir), as_of=AS_OF, cap=20)
    return final.withColumn("user_rating", F.col("user_rating").cast("bigint"))


@query
def curated_large_documents(spark, sf_dir):
    """The same table by the way of documents that are too large for one value."""
    final, _ = curate_large_documents(a.place_documents(spark, sf_dir), as_of=AS_OF, cap=20)
    return final.withColumn("user_rating", F.col("user_rating").cast("bigint"))


@query
def committed_documents(spark, sf_dir):
    """Documents added in two batches, beside one that was never committed and one that came twice."""
    store = DocumentStore(spark, shared_path(spark, "store"))
    docs = sinks.stage(_assembled(spark, sf_dir), "assembled")
    odd = F.pmod(F.xxhash64("doc_key"), F.lit(2)) == 1
    store.commit(docs.where(odd), batch="1")
    sinks.write_documents(docs, f"{store.path}/batch=lost")
    store.commit(docs.join(store.keys(), "doc_key", "left_anti"), batch="2")
    store.commit(docs, batch="2")
    read = blank_rejected(parse_documents(scan_documents(spark, store.path)))
    return document_reviews(read).select("file", "pos", "user_name", F.col("rating").cast("bigint").alias("rating"), "text")


@query
def page_store_documents(spark, sf_dir):
    """Documents collected from pages that are bucketed by URL."""
    path = shared_path(spark, "page-store")
    write_page_store(table(spark, sf_dir, "pages").select("url", "html"), path, 8)
    docs = collect_documents(a.page_places(spark, sf_dir), read_pages(spark, path), a.done_keys(spark, sf_dir))
    return docs.select(
        "doc_key", "place_info.name", "place_info.avg_rating", F.size("reviews").cast("bigint").alias("n_reviews")
    )


@query
def final_csv_roundtrip(spark, sf_dir):
    path = shared_path(spark, "final")
    final = sinks.stage(curated_reviews(spark, sf_dir), "final-staged")
    sinks.write_final(final, path)
    return sinks.read_final(spark, path, final.schema)

"""Place documents: JSON objects ``{place_info: {...}, reviews: [...]}`` with fields of any type."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.numbers import parse_int, parse_rating
from reviewloom.functions.text import clean_attributes, clean_text
from reviewloom.functions.variants import (
    field,
    field_as_text,
    variant_kind,
    variant_rating,
    variant_rating_bucket,
    variant_raw,
    variant_to_double,
    variant_to_text,
)
from reviewloom.operators.tables import flatten
from reviewloom.sources.store import DocumentStore

#: Names that Spark gives to the files it writes.
_PART_FILE = r"^part-\d{5}-"
#: Longest text value that `try_parse_json` takes; VARIANT's own limit is higher.
LONGEST_TEXT = 20_000_000
#: Leads the name of a document that is a line of a file, until it is parsed.
_LINE = "line:"
_DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"
REASONS = [
    "invalid_utf8", "malformed_json", "too_large", "not_an_object", "place_info_not_object", "reviews_not_array", "review_not_object",
]


def scan_documents(
    spark: SparkSession, path: str, *, layout: str = "auto", pattern: str = "*.json"
) -> DataFrame:
    """Read documents as (file, modified, value).

    ``layout="file"``: one document per file, the file being its group. ``layout="line"``: one
    document per line as `sinks.write_documents` leaves them; `parse_documents` names them by their
    ``doc_key``, and those without one by the digest of the line, whatever files the lines are dealt
    over. The default
    takes Spark's part files by line and all others by file, so both kinds may lie in one folder.
    Of a `DocumentStore` committed batches are read only.
    Spark hides files whose names start with ``_`` or ``.``.
    """
    if layout not in ("auto", "file", "line"):
        raise ValueError(f"unknown layout: {layout}")
    return document_rows(spark.read, DocumentStore(spark, path).visible_paths(pattern), layout, pattern)


def document_rows(reader, path: str | list[str], layout: str, pattern: str) -> DataFrame:
    """`scan_documents` with the reader of a batch or of a stream."""
    modified = F.col("_metadata.file_modification_time").alias("modified")
    name, full = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    part = F.regexp_like(name, F.lit(_PART_FILE))
    files = reader.option("pathGlobFilter", pattern).text(path, wholetext=True)
    lines = reader.option("pathGlobFilter", pattern).text(path)
    by_line = F.concat(F.lit(_LINE), F.sha2("value", 256))
    if layout == "file":
        return files.select(full.alias("file"), modified, "value")
    if layout == "line":
        return lines.where("trim(value) <> ''").select(by_line.alias("file"), modified, "value")
    return (
        files.where(~part)
        .select(full.alias("file"), modified, "value")
        .union(lines.where(part & (F.trim("value") != "")).select(by_line.alias("file"), modified, "value"))
    )


@contextmanager
def duplicate_keys_allowed(spark: SparkSession) -> Iterator[None]:
    """A key given twice is no error: its last value counts."""
    before = spark.conf.get(_DUPLICATE_KEYS)
    spark.conf.set(_DUPLICATE_KEYS, "true")
    try:
        yield
    finally:
        spark.conf.set(_DUPLICATE_KEYS, before)


def _named(key: Column) -> Column:
    """The name of a document: its file, or of a line its ``doc_key`` if it has one."""
    return F.when(F.startswith("file", F.lit(_LINE)), F.coalesce(variant_raw(key), "file")).otherwise(F.col("file"))


def _is_json() -> Column:
    """Whether ``value`` is one JSON value and nothing else, read without building it."""
    return F.json_object_keys(F.concat(F.lit('{"doc":'), "value", F.lit("}"))).eqNullSafe(F.array(F.lit("doc")))


def parse_documents(raw: DataFrame) -> DataFrame:
    """Add ``doc`` (VARIANT) and ``reject_reason`` (null for a usable document).

    A document with any malformed part is rejected whole. One that is valid but does not fit a VARIANT (128 MiB) is
    ``too_large``: `explode_large_documents` reads those.
    """
    # The parser stops after the first value. In an array that goes on with the text's own digest,
    # which no text can hold, the document is all there was if the digest comes second and last.
    digest = F.sha2("value", 256)
    text = F.concat(F.lit("["), F.col("value"), F.lit(',"'), digest, F.lit('"]'))
    # The same with longer texts; only where needed, since it parses once more.
    long_texts = F.from_json(text, "variant", {"maxStringLen": str(2**31 - 1)})
    wrapped = F.coalesce(F.try_parse_json(text), F.when(F.octet_length("value") > LONGEST_TEXT, long_texts))
    parsed = raw.withColumn("_wrapped", F.when(F.is_valid_utf8("value"), wrapped))
    parsed = parsed.withColumn("doc", F.try_variant_get("_wrapped", "$[0]", "variant"))
    whole = F.try_variant_get("_wrapped", "$[1]", "string").eqNullSafe(digest)
    beyond = F.try_variant_get("_wrapped", "$[2]", "variant").isNotNull()

    kind = variant_kind(F.col("doc"))
    info, reviews = field(F.col("doc"), "place_info"), field(F.col("doc"), "reviews")
    reviews_kind = variant_kind(reviews)
    # Nothing to iterate over is no error, whatever kind of empty it is.
    empty = (reviews_kind == "OBJECT<>") | (variant_to_text(reviews) == "")
    elements = F.try_variant_get(reviews, "$", "array<variant>")
    all_objects = F.forall(elements, lambda r: F.startswith(variant_kind(r), F.lit("OBJECT")))

    is_object = F.startswith(kind, F.lit("OBJECT"))
    reason = (
        F.when(~F.is_valid_utf8("value"), "invalid_utf8")
        .when(F.col("doc").isNull() & (F.octet_length("value") > LONGEST_TEXT) & _is_json(), "too_large")
        .when(F.col("doc").isNull() | ~whole | beyond, "malformed_json")
        .when(~is_object, "not_an_object")
        .when(info.isNotNull() & ~F.startswith(variant_kind(info), F.lit("OBJECT")), "place_info_not_object")
        .when(reviews.isNull() | empty, None)
        .when(~F.startswith(reviews_kind, F.lit("ARRAY")), "reviews_not_array")
        .when(~all_objects, "review_not_object")
    )
    return parsed.withColumns({"reject_reason": reason, "file": _named(field(F.col("doc"), "doc_key"))}).drop("_wrapped")


def explode_large_documents(raw: DataFrame, *keep: str) -> DataFrame:
    """Documents of any size that a row can hold, read by type: ``place_info`` and each review is a VARIANT of its own, so only
    these are limited to 128 MiB. A key given twice counts with its last value.

    One row per review, one without ``pos`` for a document without any: ``row`` (the document), ``raw_file``, ``file``, the ``keep``
    columns, what `large_reason` looks at, place columns, and the columns of `document_reviews`. The parser's reviews
    go into rows one by one; no array of them is built. Read them from a stored table: numbers of rows may change.
    """
    options = {"maxStringLen": str(2**31 - 1)}
    value = F.when(F.is_valid_utf8("value"), F.col("value"))
    head = raw.select(
        F.monotonically_increasing_id().alias("row"), "file", *keep, value.alias("value"), value.isNotNull().alias("is_utf8"), _is_json().alias("is_json"),
        F.json_object_keys(value).alias("keys"), F.from_json(value, "place_info variant, doc_key variant", options).alias("head"),
    ).withColumn("place_info", F.col("head.place_info"))
    head = place_fields(head).withColumns({"name": _named(F.col("head.doc_key")), "info_kind": variant_kind(F.col("place_info"))})
    places = [c for c in head.columns if c.startswith("place_") and c != "place_info"]
    state = ["is_utf8", "is_json", "keys", "info_kind"]
    reviews = F.from_json("value", "reviews array<variant>", options)["reviews"]
    tall = head.select("row", F.col("file").alias("raw_file"), F.col("name").alias("file"), *keep, *state, *places, F.posexplode_outer(reviews).alias("pos", "review"))
    is_object = F.startswith(variant_kind(F.col("review")), F.lit("OBJECT"))
    return tall.select("row", "raw_file", "file", *keep, *state, *places, F.col("pos").cast("bigint"), *_review_columns(F.col("review")), is_object.alias("is_object"))


def reviews_kind(raw: DataFrame) -> DataFrame:
    """(file, reviews_kind): SQL type of what documents without elements in ``reviews`` hold there; null if it is too large."""
    reviews = F.from_json("value", "reviews variant", {"maxStringLen": str(2**31 - 1)})["reviews"]
    kind = F.when(variant_to_text(reviews) == "", "EMPTY").otherwise(variant_kind(reviews))
    return raw.select("file", kind.alias("reviews_kind"))


def large_reason(n_reviews: Column, all_objects: Column, kind: Column) -> Column:
    """Why a document of `explode_large_documents` is rejected; as `parse_documents` says where that holds it."""
    keys = F.col("keys")
    return (
        F.when(~F.col("is_utf8"), "invalid_utf8")
        .when(~F.col("is_json"), "malformed_json")
        .when(keys.isNull(), "not_an_object")
        .when(~F.startswith("info_kind", F.lit("OBJECT")), "place_info_not_object")
        .when(F.array_contains(keys, "place_info") & F.col("info_kind").isNull(), "too_large")
        .when(n_reviews > 0, F.when(~all_objects, "review_not_object"))
        .when(~F.array_contains(keys, "reviews") | kind.isin("EMPTY", "OBJECT<>"), None)
        .when(kind.isNull(), "too_large")
        .when(~F.startswith(kind, F.lit("ARRAY")), "reviews_not_array")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """Usable documents only. Spark evaluates this filter below the parsing and so parses twice;
    where blank documents do no harm, `blank_rejected` is the cheaper choice."""
    return parsed.where("reject_reason is null").drop("reject_reason", "value")


def blank_rejected(parsed: DataFrame, *, keep_reason: bool = False) -> DataFrame:
    """All documents, with ``doc`` null for the rejected ones."""
    usable = F.when(F.col("reject_reason").isNull(), F.col("doc"))
    return parsed.withColumn("doc", usable).drop("value", *([] if keep_reason else ["reject_reason"]))


def rejected(parsed: DataFrame) -> DataFrame:
    """Side table of documents left out, with the reason."""
    return parsed.where("reject_reason is not null").select("file", "reject_reason")


def place_fields(documents: DataFrame) -> DataFrame:
    """Cleaned place columns of accepted documents (``doc``, or ``place_info``); sentinels where a
    field is absent or no text."""
    info = F.col("place_info") if "place_info" in documents.columns else field(F.col("doc"), "place_info")

    def text(key: str):
        return clean_text(field_as_text(info, key))

    rating = field(info, "avg_rating")
    return documents.withColumns(
        {
            "place_name": text("name"),
            "place_description": text("description"),
            "place_category": text("category"),
            "place_attributes": clean_attributes(field_as_text(info, "attributes")),
            "place_address": text("address"),
            "place_total_reviews_gmaps": parse_int(field_as_text(info, "total_reviews_text")),
            "place_avg_rating": F.coalesce(
                variant_to_double(rating), parse_rating(variant_to_text(rating))
            ),
        }
    )


def _review_columns(r: Column) -> list[Column]:
    return [
        field_as_text(r, "user_name").alias("user_name"),
        field_as_text(r, "text").alias("text"),
        field_as_text(r, "time").alias("time"),
        variant_rating(field(r, "rating")).alias("rating"),
        variant_raw(field(r, "rating")).alias("rating_raw"),
        variant_rating_bucket(field(r, "rating")).alias("rating_bucket"),
    ]


def document_reviews(documents: DataFrame, *keep: str) -> DataFrame:
    """Reviews of documents, one row each: file, pos, user_name, text, time, rating, rating_raw,
    rating_bucket, and the ``keep`` columns. Blank documents have none."""
    reviews = F.try_variant_get("doc", "$.reviews", "array<variant>")
    tall = flatten(documents.withColumn("reviews", reviews), keep=["file", *keep])
    return tall.select("file", "pos", *_review_columns(F.col("review")), *keep)

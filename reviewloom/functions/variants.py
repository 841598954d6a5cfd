"""Fields of JSON values whose type is not known beforehand (Spark VARIANT)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.numbers import rating_bucket, text_to_int

_NUMBER_KINDS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _path(key: str) -> str:
    return f"$['{key}']"


def variant_kind(v: Column) -> Column:
    """SQL type name of the value: STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID for JSON null."""
    return F.schema_of_variant(v)


def field(v: Column, key: str) -> Column:
    """Field of an object: SQL NULL when the key is absent, variant null when it holds null."""
    return F.try_variant_get(v, _path(key), "variant")


def has_field(v: Column, key: str) -> Column:
    return field(v, key).isNotNull()


def variant_to_text(v: Column) -> Column:
    """The string if the value is a string; null for every other type, numbers included."""
    return F.when(variant_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def variant_to_double(v: Column) -> Column:
    """The number if the value is a number; null for every other type, numeric strings included."""
    return F.when(
        F.regexp_like(variant_kind(v), F.lit(_NUMBER_KINDS)), F.try_variant_get(v, "$", "double")
    )


def field_as_text(v: Column, key: str, default: str | None = None) -> Column:
    """Text field, null for any other type; ``default`` stands in only where the key is absent."""
    x = field(v, key)
    text = variant_to_text(x)
    return text if default is None else F.when(x.isNull(), F.lit(default)).otherwise(text)


def _variant_number(v: Column) -> Column:
    """Value as whole-number conversion sees it: numbers, integer literals, booleans."""
    return F.coalesce(
        variant_to_double(v),
        text_to_int(variant_to_text(v)),
        F.when(variant_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")),
    )


def variant_rating_bucket(v: Column) -> Column:
    """Star 1..5 of a rating of any JSON type; 0 when it has none."""
    return rating_bucket(_variant_number(v))


def variant_rating(v: Column) -> Column:
    """Rating as INT for the final table: absent key gives 0; null, fractions and whatever else is
    no whole number of that size stay null. `variant_raw` has them as they are."""
    number = _variant_number(v)
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    return F.when(v.isNull(), 0).when(~F.is_variant_null(v), whole)


def variant_raw(v: Column) -> Column:
    """The value as text: a string as it is, anything else as JSON; null for null or an absent key."""
    return F.when(~F.is_variant_null(v), F.coalesce(variant_to_text(v), F.to_json(v)))

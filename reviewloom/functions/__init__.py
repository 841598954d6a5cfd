"""Column functions: Column in, Column out, all JVM-side."""
from reviewloom.functions.numbers import (
    ascii_digits,
    decimal_comma,
    parse_int,
    parse_rating,
    rating_bucket,
)
from reviewloom.functions.reltime import relative_date, relative_time
from reviewloom.functions.text import (
    anonymize_user,
    clean_attributes,
    clean_text,
    first_line,
    has_text,
    is_nonblank,
    list_to_text,
    sanitize_key,
    slugify,
)
from reviewloom.functions.variants import (
    field,
    field_as_text,
    has_field,
    variant_kind,
    variant_rating,
    variant_rating_bucket,
    variant_raw,
    variant_to_double,
    variant_to_text,
)

__all__ = [
    "anonymize_user",
    "ascii_digits",
    "clean_attributes",
    "clean_text",
    "decimal_comma",
    "field",
    "field_as_text",
    "first_line",
    "has_field",
    "has_text",
    "is_nonblank",
    "list_to_text",
    "parse_int",
    "parse_rating",
    "rating_bucket",
    "relative_date",
    "relative_time",
    "sanitize_key",
    "slugify",
    "variant_kind",
    "variant_rating",
    "variant_rating_bucket",
    "variant_raw",
    "variant_to_double",
    "variant_to_text",
]

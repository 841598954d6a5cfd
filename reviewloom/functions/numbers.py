"""Numbers written as text."""
from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import strip_spaces

# A run of digits in which single underscores may stand between digits.
_DIGITS = r"[0-9](?:_?[0-9])*"
_FLOAT = rf"[+-]?(?:{_DIGITS}[.]?(?:{_DIGITS})?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_NOT_FINITE = r"(?i:[+-]?(?:nan|inf|infinity))"
_INT = rf"[+-]?{_DIGITS}"

STARS = (1, 2, 3, 4, 5)


@cache
def _digit_map() -> tuple[str, str]:
    pairs = [
        (chr(cp), str(unicodedata.decimal(chr(cp))))
        for cp in range(0x80, sys.maxunicode + 1)
        if unicodedata.decimal(chr(cp), None) is not None
    ]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def ascii_digits(c: Column) -> Column:
    """Decimal digits of every script as 0-9. Looks at each character, so meant for short text."""
    return F.translate(c, *_digit_map())


def parse_int(c: Column) -> Column:
    """All digits of the text put together as BIGINT; 0 for none or null, null for more than BIGINT holds."""
    digits = F.coalesce(ascii_digits(F.regexp_replace(c, r"\P{Nd}+", "")), F.lit(""))
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))


def decimal_comma(c: Column) -> Column:
    """``,`` as decimal mark becomes ``.``"""
    return F.replace(c, F.lit(","), F.lit("."))


def parse_rating(c: Column) -> Column:
    """``"4,5"`` -> 4.5; anything that is not a whole number or float literal gives 0.0."""
    t = strip_spaces(ascii_digits(decimal_comma(c)))
    number = F.replace(t, F.lit("_"), F.lit("")).try_cast("double")
    shape = F.regexp_like(t, F.lit(rf"^(?:{_FLOAT}|{_NOT_FINITE})$"))
    return F.coalesce(F.when(shape, number), F.lit(0.0))


def text_to_int(c: Column) -> Column:
    """Integer literal to DOUBLE (wide enough to tell 1..5 from the rest), else null."""
    t = strip_spaces(ascii_digits(c))
    return F.when(
        F.regexp_like(t, F.lit(f"^{_INT}$")), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")
    )


def rating_bucket(c: Column) -> Column:
    """Numeric rating to its star 1..5, fractions cut; everything else is bucket 0."""
    star = F.when((c >= 1) & (c < 6), F.floor(c).cast("int"))
    return F.coalesce(star, F.lit(0))

"""Indonesian relative times ("2 bulan lalu") to dates."""
from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.numbers import ascii_digits

# Words of the interface language, tested in this order as substrings.
EDITED = "diedit"
JUST_NOW = ["menit", "detik", "baru saja"]
HOUR = "jam"
DAYS_PER_UNIT = {"hari": 1, "minggu": 7, "bulan": 30, "tahun": 365}


def _as_column(as_of: Column | datetime | date | str | None) -> Column:
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def relative_date(c: Column, as_of: Column | datetime | date | str | None = None) -> Column:
    """The DATE a relative time points at, counted back from ``as_of`` (default: the run's time).

    Text naming no known unit means ``as_of`` itself. Null for null or empty text and for
    dates before year 1.
    """
    as_of = _as_column(as_of)
    today = F.to_date(as_of)
    t = F.replace(F.lower(c), F.lit(EDITED), F.lit(""))

    run = ascii_digits(F.regexp_extract(t, r"(\p{Nd}+)", 1))
    # DOUBLE is exact for every number of days in the calendar and takes runs of any length.
    n = F.coalesce(run.try_cast("double"), F.lit(1.0))
    size = F.lit(None).cast("int")
    for unit, length in reversed(DAYS_PER_UNIT.items()):
        size = F.when(t.contains(unit), length).otherwise(size)

    # Only whole days matter: n hours before hh:mm crosses ceil((n - hh) / 24) midnights.
    hours_as_days = F.floor((n - F.hour(as_of) + 23) / 24)
    just_now = reduce(or_, [t.contains(word) for word in JUST_NOW])
    days = (
        F.when(just_now, 0.0).when(t.contains(HOUR), hours_as_days).when(size.isNotNull(), n * size).otherwise(0.0)
    )
    calendar_start = F.lit("0001-01-01").cast("date")
    in_range = days <= F.datediff(today, calendar_start)
    return F.when((c != "") & in_range, F.date_sub(today, days.try_cast("int")))


def relative_time(c: Column, as_of: Column | datetime | date | str | None = None) -> Column:
    """`relative_date` as ``yyyy-MM-dd`` text, ``""`` where there is no date."""
    return F.coalesce(relative_date(c, as_of).cast("string"), F.lit(""))

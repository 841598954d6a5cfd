"""Text clean-up, user hashing and key building."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mis-decoded glyph runs that listing pages leave in exported text.
ARTIFACTS = ["Óóä", "¬†"]

# Members of a Java character class equal to Python's Unicode `\s`.
# Java's own `\s` is ASCII only and lacks FS..US, NEL and the separators.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# Members of a Java character class equal to Python's str.isalnum().
ALNUM = r"\p{L}\p{N}"

# What a browser's String.trim() removes: it adds U+FEFF to, and lacks FS..US and NEL of, the above.
_BROWSER_SPACE = r"\t\n\x0b\f\r\p{Zs}\u2028\u2029\ufeff"

def strip_spaces(c: Column) -> Column:
    """Drop Unicode whitespace at both ends."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _without_artifacts(c: Column) -> Column:
    for artifact in ARTIFACTS:
        c = F.replace(c, F.lit(artifact), F.lit(""))
    return c


def clean_text(c: Column) -> Column:
    """Remove artifacts, squeeze whitespace to single spaces, trim; null gives ``""``."""
    return F.coalesce(F.trim(F.regexp_replace(_without_artifacts(c), f"[{SPACE}]+", " ")), F.lit(""))


def has_text(c: Column) -> Column:
    """Same as ``clean_text(c) <> ''``, mostly told from the first character alone: one that is
    no space and starts no artifact is there to stay."""
    starts = "".join(a[0] for a in ARTIFACTS)
    plain_start = F.regexp_like(F.substring(c, 1, 1), F.lit(f"[^{SPACE}{starts}]"))
    any_kept = F.regexp_like(_without_artifacts(c), F.lit(f"[^{SPACE}]"))
    return F.coalesce(plain_start | any_kept, F.lit(False))


def clean_attributes(c: Column) -> Column:
    """``"a | -b |  | !"`` -> ``"a, b"``: each pipe-separated item loses its leading
    characters outside ASCII letters and digits; empty items go."""
    items = F.transform(
        F.split(clean_text(c), r"\|"), lambda x: F.trim(F.regexp_replace(x, "^[^a-zA-Z0-9]+", ""))
    )
    return F.array_join(F.filter(items, lambda x: x != ""), ", ")


def anonymize_user(c: Column) -> Column:
    """First ten hex digits of the MD5 of the stripped, lower-cased name; ``anonymous`` if empty.

    This hides names from casual reading only: 40 unsalted bits can be looked up and do collide.
    """
    digest = F.substring(F.md5(F.lower(strip_spaces(c))), 1, 10)
    return F.when(F.coalesce(c, F.lit("")) == "", "anonymous").otherwise(digest)


def slugify(c: Column) -> Column:
    """Lower case, word characters only, runs of spaces and hyphens turned into ``_``."""
    kept = F.regexp_replace(F.lower(c), rf"[^{ALNUM}_{SPACE}-]", "")
    return F.regexp_replace(kept, rf"[{SPACE}-]+", "_")


def sanitize_key(c: Column) -> Column:
    """Letters, digits, space, hyphen and underscore only, trimmed; the key of a place's document."""
    return F.trim(F.regexp_replace(c, rf"[^{ALNUM} _-]", ""))


def first_line(c: Column) -> Column:
    """Text before the first newline."""
    return F.substring_index(c, "\n", 1)


def is_nonblank(c: Column) -> Column:
    """True when something is left after a browser's ``trim()``; null counts as blank."""
    return F.coalesce(F.length(F.regexp_replace(c, f"[{_BROWSER_SPACE}]+", "")) > 0, F.lit(False))


def list_to_text(items: Column) -> Column:
    """Array of strings to one string: newline becomes ``": "`` in an item, items joined by ``" | "``."""
    return F.array_join(F.transform(items, lambda x: F.replace(x, F.lit("\n"), F.lit(": "))), " | ")

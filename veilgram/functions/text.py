"""Column expressions that turn raw attributes into q-gram sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.strip() knows it.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normal_id(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def normal_attr(c: Column) -> Column:
    """Stripped, lower case, without U+0020; null counts as empty."""
    return F.replace(F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))), F.lit(" "), F.lit(""))


def is_active(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)) == "a", F.lit(False))


def is_complete(attrs: list[Column], min_len: int = 2) -> Column:
    out = F.lit(True)
    for a in attrs:
        out = out & (F.length(a) >= min_len)
    return out


def qgrams(value: Column, q: int = 2) -> Column:
    """All substrings of length q in order, repeats included; none if value is shorter."""
    some = F.transform(F.sequence(F.lit(1), F.length(value) - (q - 1)), lambda i: F.substring(value, i, F.lit(q)))
    return F.when(F.length(value) >= q, some).otherwise(F.array().cast("array<string>"))


def qgram_set(attrs: list[Column], q: int = 2) -> Column:
    """Sorted union of the attributes' q-grams; no gram spans two attributes."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[qgrams(a, q) for a in attrs]))))

"""Names, labels and search phrases of listings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vouch.functions.text import SPACE_RUN, or_null, strip

# What may follow the proper name of a listing, in this order.
NAME_SEPARATORS = ("·", " • ", " | ", " - ")
STARS_SUFFIX = r"(?iU)\s*\d+(\.\d+)?\s*stars?.*$"


def clean_name(name: Column) -> Column:
    """Listing name without a trailing star rating."""
    return strip(F.regexp_replace(strip(name), STARS_SUFFIX, ""))


def compact_query(name: Column, location: Column) -> Column:
    """At most three words of the proper name, then the location."""
    short = strip(F.coalesce(name, F.lit("")))
    for separator in NAME_SEPARATORS:
        short = strip(F.substring_index(short, separator, 1))
    words = F.split(short, SPACE_RUN)
    short = F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 3), " ")).otherwise(short)
    return F.concat_ws(" ", or_null(short), strip(or_null(location)))


def match_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def label_key(label: Column) -> Column:
    return match_key(F.substring_index(label, ",", 1))


def base_url(href: Column) -> Column:
    """Link without query string and trailing slashes."""
    return F.rtrim(F.substring_index(href, "?", 1), F.lit("/"))


def stars(label: Column) -> Column:
    """First run of digits in a rating label."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")

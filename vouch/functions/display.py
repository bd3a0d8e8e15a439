"""Fields as they are shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vouch.functions.text import or_null

NONE = "—"


def _shown(value: Column, pattern: str) -> Column:
    """Formatted value; a zero is shown like a missing one."""
    return F.when(value != 0, F.format_string(pattern, value)).otherwise(NONE)


def review_rating(rating: Column) -> Column:
    return _shown(rating, "%d/5")


def place_rating(rating: Column) -> Column:
    return _shown(rating, "%.1f")


def count(value: Column) -> Column:
    return _shown(value, "%d")


def score(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", value)


def review_meta(rating: Column, date: Column, reviewer: Column) -> Column:
    rated = F.when(rating != 0, F.format_string("%d/5", rating))
    return F.concat_ws(" · ", rated, or_null(date), or_null(reviewer))


def evidence_meta(rating: Column, date: Column, reviewer: Column, bm25: Column) -> Column:
    rated = F.when(rating.isNotNull(), F.format_string("%d/5", rating))
    scored = F.when(bm25 != 0, F.format_string("bm25 %.2f", bm25))
    return F.concat_ws(" · ", rated, or_null(date), or_null(reviewer), scored)


def mentions(hits: Column) -> Column:
    """``variant×count`` by falling count, then by variant."""
    ordered = F.array_sort(
        F.transform(
            F.map_entries(hits), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("v"))
        )
    )
    parts = F.transform(ordered, lambda e: F.concat(e["v"], F.lit("×"), (-e["n"]).cast("string")))
    return F.array_join(parts, ", ")

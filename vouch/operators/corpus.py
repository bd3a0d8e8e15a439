"""The text that is indexed for a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from vouch.functions.text import is_blank, or_null, strip


def corpus(reviews: DataFrame) -> DataFrame:
    """``id, contents`` of every review with text."""
    contents = F.concat_ws(
        " | ",
        or_null(F.col("place_name")),
        F.concat(F.lit("rating "), F.col("rating").cast("string"), F.lit("/5")),
        or_null(F.col("published_date")),
        strip(F.col("text")),
        F.concat(F.lit("owner response: "), or_null(F.col("owner_response"))),
    )
    return reviews.filter(~is_blank(F.col("text"))).select(
        F.col("review_id").alias("id"), contents.alias("contents")
    )


def export_corpus(reviews: DataFrame, path: str) -> int:
    """Write the corpus as JSON lines and return the number of rows written."""
    written = Observation("corpus")
    corpus(reviews).observe(written, F.count("*").alias("rows")).write.json(path)
    return written.get["rows"]

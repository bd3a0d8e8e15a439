"""Which reviews talk about X."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouch.functions import display
from vouch.functions.text import preview
from vouch.operators.bm25 import B, K1, Index, top_hits
from vouch.session import materialize
from vouch.sources.tables import keyed_join


def ranked_hits(
    index: Index, queries: DataFrame, top_n: int, k1: float = K1, b: float = B
) -> DataFrame:
    """The text hits as a written table ``qid, review_id, score, rank``."""
    hits = top_hits(index, queries, top_n, k1, b).withColumnRenamed("doc_id", "review_id")
    # the filter repeats the cut, so that the planner knows the table to be selective
    return materialize(hits, "hits").filter(F.col("rank") <= top_n)


def search(
    index: Index,
    reviews: DataFrame,
    places: DataFrame,
    queries: DataFrame,
    top_n: int = 10,
    k1: float = K1,
    b: float = B,
    redact: bool = False,
) -> DataFrame:
    """The best reviews of each query with their place, by rank.

    Place columns are NULL for a review of an unknown place.  ``redact`` hides who wrote
    the review.
    """
    hits = ranked_hits(index, queries, top_n, k1, b)
    found = keyed_join(hits, reviews, "review_id").select(
        "qid",
        "rank",
        "review_id",
        "score",
        F.col("text").alias("review_text"),
        F.col("rating").alias("review_rating"),
        F.col("published_date").alias("review_date"),
        (F.lit(None).cast("string") if redact else F.col("reviewer_name")).alias("reviewer_name"),
        "place_id",
    )
    # at most top_n rows per query, so that the place table is the larger side
    found = materialize(found, "found").filter(F.col("rank") <= top_n)
    meta = places.select(
        *[c for c in ("shard", "place_id") if c in places.columns],
        F.col("name").alias("place_name"),
        F.col("address").alias("place_address"),
        F.col("maps_url").alias("place_maps_url"),
        F.col("rating").alias("place_rating"),
    )
    mine = keyed_join(found.select("place_id").distinct(), meta, "place_id")
    return found.join(mine, "place_id", "left").select(
        "qid",
        "rank",
        "review_id",
        "score",
        "review_text",
        "review_rating",
        "review_date",
        "reviewer_name",
        "place_name",
        "place_address",
        "place_maps_url",
        "place_rating",
    )


def search_display(found: DataFrame) -> DataFrame:
    """Search results as shown to a reader."""
    return found.select(
        "qid",
        "rank",
        display.score(F.col("score"), 3).alias("score"),
        F.coalesce("place_name", F.lit("?")).alias("place"),
        display.review_rating(F.col("review_rating")).alias("rating"),
        preview(F.col("review_text")).alias("preview"),
        display.review_meta(
            F.col("review_rating"), F.col("review_date"), F.col("reviewer_name")
        ).alias("meta"),
    )

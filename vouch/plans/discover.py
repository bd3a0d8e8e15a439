"""New listings, listing matches and reviews out of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouch.functions.ids import default_link
from vouch.functions.listing import compact_query
from vouch.operators.extract import assemble_reviews, block_fields, cap_reviews
from vouch.operators.listings import first_listings
from vouch.operators.upsert import latest, not_stored, upsert
from vouch.schemas import PLACES, REVIEWS, conform


def new_places(
    found: DataFrame, places: DataFrame, force: bool = False, scraped_at: Column | None = None
) -> DataFrame:
    """Found places not stored yet (all of them with ``force``), each once and with a link.

    ``found`` has ``query_id, rank`` and place columns, from listings or from saved
    search responses.
    """
    fresh = found if force else not_stored(found, places, "place_id")
    ordered = fresh.withColumn("seq", F.struct("query_id", "rank")).drop("query_id", "rank")
    once = latest(ordered, "place_id", "seq")
    linked = once.withColumn("maps_url", default_link(F.col("maps_url"), F.col("place_id")))
    return conform(linked, PLACES, scraped_at)


def discover_incremental(
    listings: DataFrame,
    places: DataFrame,
    max_places: int = 20,
    force: bool = False,
    scraped_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The place table with the newly found places, and those places."""
    fresh = new_places(first_listings(listings, max_places), places, force, scraped_at)
    return upsert(places, fresh.withColumn("seq", F.lit(0)), "place_id", "seq"), fresh


def search_phrases(targets: DataFrame, location: Column) -> DataFrame:
    """The phrase each target place is searched under."""
    return targets.select("place_id", compact_query(F.col("name"), location).alias("phrase"))


def extract_reviews(
    candidates: DataFrame,
    places: DataFrame,
    max_reviews: int = 100,
    sort_by: str = "newest",
    scraped_at: Column | None = None,
) -> DataFrame:
    """Review rows out of field candidates, capped per place.

    ``places(page_id, place_id, name)``.
    """
    rows = assemble_reviews(block_fields(candidates), places)
    return conform(cap_reviews(rows, max_reviews, sort_by), REVIEWS, scraped_at)


def discovery_stats(fresh: DataFrame, reviews: DataFrame) -> DataFrame:
    """``places_scraped`` and ``reviews_added``."""
    count = fresh.agg(F.count("*").alias("places_scraped"))
    return count.withColumn("reviews_added", reviews.agg(F.count("*")).scalar())

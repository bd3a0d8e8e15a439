"""Views for ad-hoc SQL and the sample data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from vouch.schemas import PLACES, REVIEWS, conform
from vouch.sources.samples import sample_places, sample_reviews
from vouch.sources.tables import TableStore


def register_views(places: DataFrame, reviews: DataFrame) -> None:
    """Make the tables available to ``spark.sql`` as ``places`` and ``reviews``."""
    places.createOrReplaceTempView("places")
    reviews.createOrReplaceTempView("reviews")


def sample_tables(
    spark: SparkSession, scraped_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Three places with two reviews each."""
    return (
        conform(sample_places(spark), PLACES, scraped_at),
        conform(sample_reviews(spark), REVIEWS, scraped_at),
    )


def load_samples(store: TableStore, scraped_at: Column | None = None) -> None:
    """Upsert the sample data into the store."""
    for name, rows in zip(("places", "reviews"), sample_tables(store.spark, scraped_at)):
        store.upsert(name, rows)

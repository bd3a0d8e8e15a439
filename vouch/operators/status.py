"""Counts and lookups over the keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table_counts(places: DataFrame, reviews: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("table_name"), "rows"
    )
    return count(places, "places").unionByName(count(reviews, "reviews"))


def listed_places(places: DataFrame) -> DataFrame:
    return places.orderBy("name", "place_id")


def place_ids(places: DataFrame) -> DataFrame:
    return places.select("place_id").distinct()

"""Listing search results, query lists and variant lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from vouch.functions.ids import bare_place_id
from vouch.functions.json import field, is_object
from vouch.functions.text import strip


def places_from_pages(pages: DataFrame, max_results: int = 20) -> DataFrame:
    """Place rows of saved search responses.

    ``pages`` has ``query_id, page_no`` and the response as VARIANT ``body``.  Items
    without id are skipped; each query keeps its first ``max_results`` places.
    """
    items = pages.select(
        "query_id",
        "page_no",
        F.posexplode(field(F.col("body"), "places", "array<variant>")).alias("pos", "item"),
    )
    item = F.col("item")
    display = field(item, "displayName", "variant")
    name = F.when(is_object(display), field(display, "text")).otherwise(field(item, "displayName"))
    text = lambda key: F.coalesce(field(item, key), F.lit(""))
    places = items.select(
        "query_id",
        "page_no",
        "pos",
        bare_place_id(text("id")).alias("place_id"),
        F.coalesce(name, F.lit("")).alias("name"),
        text("formattedAddress").alias("address"),
        field(item, "rating", "double").alias("rating"),
        field(item, "userRatingCount", "int").alias("review_count"),
        text("googleMapsUri").alias("maps_url"),
        text("primaryType").alias("category"),
    ).filter(F.length("place_id") > 0)
    order = W.partitionBy("query_id").orderBy("page_no", "pos")
    return places.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max_results
    )


def area_query(query: Column, location: Column) -> Column:
    return F.concat_ws(" in ", strip(query), strip(location))


def query_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped non-blank lines as queries."""
    return lines.withColumn("query", strip(F.col(column))).filter(F.length("query") > 0)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """Search phrases of a text file, one per line: ``qid, query``."""
    return query_lines(spark.read.text(path)).select(
        F.monotonically_increasing_id().alias("qid"), "query"
    )


def split_variants(df: DataFrame, column: str) -> DataFrame:
    """Each comma-separated part of ``column`` as a row ``variant``; blank parts dropped."""
    parts = df.withColumn("variant", F.explode(F.split(column, ",")))
    return parts.withColumn("variant", strip(F.col("variant"))).filter(F.length("variant") > 0)


def variant_list(single: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Variants given one by one, kept as they are, and those given as comma lists."""
    return single.select("variant").union(split_variants(listed, column).select("variant"))

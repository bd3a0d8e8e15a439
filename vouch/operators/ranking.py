"""From matching reviews to ranked places and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vouch.operators.exact import COPY_PREFIX, TOUCHED
from vouch.sources.tables import keyed_join

# weight of an exact hit against one point of BM25 in the combined score
HIT_WEIGHT = 10.0


def located_hits(hits: DataFrame, reviews: DataFrame) -> DataFrame:
    """Text hits in the form of touched reviews; hits without a review drop out."""
    texts = reviews.select(
        *[c for c in ("shard", "review_id", "place_id", "place_name") if c in reviews.columns],
        F.substring("text", 1, COPY_PREFIX).alias("copy_key"),
    )
    return (
        keyed_join(hits, texts, "review_id")
        .withColumn("found", F.array().cast("array<string>"))
        .select(*TOUCHED)
    )


def best_score(touched: DataFrame) -> DataFrame:
    """Best positive score per query and place."""
    return (
        touched.filter(F.col("score") > 0)
        .groupBy("qid", "place_id")
        .agg(F.max("score").alias("bm25_top"))
    )


def hits_by_place(touched: DataFrame) -> DataFrame:
    """The text hits of each query per place, best first: ``qid, place_id, review_ids``.

    A query has at most the top hits asked for, so a list is no longer than that.
    """
    hits = touched.filter(F.col("score").isNotNull())
    row = F.struct((-F.col("score")).alias("order"), F.col("review_id"))
    ranked = hits.groupBy("qid", "place_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    return ranked.select("qid", "place_id", F.col("hits.review_id").alias("review_ids"))


def candidates(touched: DataFrame) -> DataFrame:
    """Places with exact hits or a positive text score, the missing side as zero.

    Both signals come from one aggregate over numbers; the hits per spelling and the
    names are looked up later, for the places that are shown.
    """
    hits = F.size("found")
    return (
        touched.groupBy("qid", "place_id")
        .agg(
            F.sum(hits).cast("bigint").alias("exact_hits"),
            F.count_if(hits > 0).alias("exact_reviews"),
            F.coalesce(F.max(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)).alias(
                "bm25_top"
            ),
        )
        .filter((F.col("exact_hits") > 0) | (F.col("bm25_top") > 0))
        .withColumn("score", F.col("exact_hits") * HIT_WEIGHT + F.col("bm25_top"))
    )


def with_rating(candidate: DataFrame, places: DataFrame) -> DataFrame:
    return candidate.join(places.select("place_id", "rating"), "place_id", "left")


def best_places(rated: DataFrame, top_places: int = 10, order_by: str = "hits") -> DataFrame:
    """The first places of each query by hits, best text score and rating, with ``rank``."""
    by_hits = [
        F.desc("exact_hits"),
        F.desc("bm25_top"),
        F.desc(F.coalesce("rating", F.lit(0.0))),
        F.col("place_id"),
    ]
    orders = {"hits": by_hits, "score": [F.desc("score"), *by_hits]}
    window = W.partitionBy("qid").orderBy(*orders[order_by])
    return rated.withColumn("rank", F.row_number().over(window)).filter(
        F.col("rank") <= top_places
    )


def with_place(best: DataFrame, hits: DataFrame, places: DataFrame) -> DataFrame:
    """Stored place data and the hits per spelling next to each place.

    ``hits`` has ``qid, place_id, variant_hits, place_name`` of places with exact hits.
    """
    meta = places.select(
        *[c for c in ("shard", "place_id") if c in places.columns],
        "name",
        "address",
        "review_count",
        "maps_url",
        F.lit(True).alias("stored"),
    )
    mine = keyed_join(best.select("place_id").distinct(), meta, "place_id")
    joined = best.join(mine, "place_id", "left").join(
        hits.select("qid", "place_id", "variant_hits", "place_name"), ["qid", "place_id"], "left"
    )
    name = F.nullif(F.coalesce("name", "place_name"), F.lit(""))
    # text of a stored place stays as stored; of an unknown place it is empty
    text = lambda c: F.when(F.col("stored").isNull(), "").otherwise(F.col(c))
    return joined.select(
        "qid",
        "rank",
        "place_id",
        F.coalesce(name, F.lit("?")).alias("name"),
        text("address").alias("address"),
        "rating",
        "review_count",
        text("maps_url").alias("maps_url"),
        "exact_hits",
        "exact_reviews",
        F.coalesce("variant_hits", F.create_map().cast("map<string,bigint>")).alias("variant_hits"),
        "bm25_top",
        "score",
    )


def of_places(touched: DataFrame, chosen: DataFrame) -> DataFrame:
    """The touched reviews of the chosen places."""
    return touched.join(chosen.select("qid", "place_id"), ["qid", "place_id"], "left_semi")


def evidence(touched: DataFrame, per_place: int = 3) -> DataFrame:
    """The reviews to quote for each place: ``qid, place_id, review_id, score, n``.

    Text hits by score come first, then exact matches; of reviews that start alike
    only the first counts.  Copies are folded by an aggregate, so a text repeated very
    often costs one row per task, and places keep only their first rows before the
    shuffle.
    """
    keys = ["qid", "place_id"]
    row = F.struct(
        F.when(F.col("score").isNull(), 1).otherwise(0).alias("tier"),
        (-F.coalesce("score", F.lit(0.0))).alias("order"),
        F.col("review_id").alias("review_id"),
    )
    first = touched.groupBy(*keys, "copy_key").agg(F.min(row).alias("row")).select(*keys, "row.*")
    window = W.partitionBy(*keys).orderBy("tier", "order", "review_id")
    return (
        first.withColumn("n", F.row_number().over(window))
        .filter(F.col("n") <= per_place)
        .select(*keys, "review_id", F.abs("order").alias("score"), "n")
    )

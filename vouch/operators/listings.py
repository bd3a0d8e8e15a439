"""Discovered listings: clean-up, first of repeats, and matching to known places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vouch.functions.ids import absolute_href, id_kind, listing_id
from vouch.functions.listing import base_url, clean_name, label_key, match_key

# Key lengths tried when names are compared, best first.
KEY_SIZES = (12, 10, 8)

# Lengths of the pieces that ids are looked up by.
ID_SIZES = (16, 8, 4, 3, 2, 1)


def first_listings(listings: DataFrame, max_places: int = 20) -> DataFrame:
    """Places of ``listings(query_id, pos, label, href)``.

    Of equal links of a query the first counts, then nameless ones are dropped and each
    query keeps its first ``max_places``.
    """
    linked = listings.withColumn("href", absolute_href(F.col("href"))).filter(
        F.length("href") > 0
    )
    first = linked.groupBy("query_id", "href").agg(
        F.min(F.struct("pos", "label")).alias("first")
    )
    named = first.select(
        "query_id",
        F.col("first.pos").alias("pos"),
        clean_name(F.coalesce("first.label", F.lit(""))).alias("name"),
        F.col("href").alias("maps_url"),
    ).filter(F.length("name") > 0)
    order = W.partitionBy("query_id").orderBy("pos", "maps_url")
    kept = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_places)
    return kept.withColumn("place_id", listing_id(F.col("maps_url"))).withColumn(
        "id_kind", id_kind(F.col("place_id"))
    )


def _pieces(key: Column, size: int) -> Column:
    """All distinct substrings of ``size`` characters, each with its size."""
    last = F.length(key) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        F.array_distinct(F.transform(starts, lambda i: F.substring(key, i, F.lit(size)))),
        lambda piece: F.struct(F.lit(size).alias("size"), piece.alias("piece")),
    )


def _all_pieces(key: Column, sizes: tuple[int, ...] = KEY_SIZES) -> Column:
    return F.flatten(F.array(*[_pieces(key, size) for size in sizes]))


def _tail(key: Column) -> Column:
    """The last characters of ``key``, as many as the longest of ``ID_SIZES`` that it holds."""
    size = F.lit(ID_SIZES[-1])
    for one in reversed(ID_SIZES[:-1]):
        size = F.when(F.length(key) >= one, F.lit(one)).otherwise(size)
    return F.struct(size.alias("size"), F.substring(key, F.length(key) - size + 1, size).alias("piece"))


def _heads(key: Column) -> Column:
    heads = F.array(
        *[
            F.struct(F.lit(size).alias("size"), F.substring(key, 1, size).alias("piece"))
            for size in KEY_SIZES
        ]
    )
    return F.filter(heads, lambda head: F.length(head["piece"]) == head["size"])


def match_listings(targets: DataFrame, listings: DataFrame) -> DataFrame:
    """The listing each target place is taken to be.

    ``targets(query_id, place_id, name, maps_url)`` meet
    ``listings(query_id, pos, label, href)`` of the same query: a listing with the same
    link or with the id in its link, the earliest first; else the one sharing the
    longest head of the name key; else the first one.

    Containment is turned into equality on substrings of the lengths in question, and
    each side keeps the earliest position per substring before it is joined, so that
    rows never pair up by query alone.
    """
    query = "query_id"
    found = listings.select(
        query, "pos", absolute_href(F.col("href")).alias("href"), label_key(F.col("label")).alias("key")
    )
    wanted = targets.select(
        query,
        "place_id",
        base_url(absolute_href(F.col("maps_url"))).alias("base"),
        match_key(F.col("name")).alias("key"),
    )
    vote = lambda tier, size: F.struct(
        F.lit(tier).alias("tier"), (-size).alias("order"), F.col("pos").alias("pos")
    ).alias("vote")
    target = [query, "place_id"]

    by_link = found.groupBy(query, base_url(F.col("href")).alias("base")).agg(
        F.min("pos").alias("pos")
    )
    same_link = wanted.filter(F.length("base") > 0).join(by_link, [query, "base"])

    # an id is met by its last characters, as many as the longest piece that it holds, and then confirmed
    links = found.groupBy(query, "href").agg(F.min("pos").alias("pos"))
    parts = links.select(query, "pos", "href", F.inline(_all_pieces(F.col("href"), ID_SIZES)))
    ids = wanted.filter(F.length("place_id") > 0).select(*target, _tail(F.col("place_id")).alias("tail")).distinct()
    id_in_link = (
        ids.select(*target, "tail.*")
        .join(parts, [query, "size", "piece"])
        .filter(F.contains("href", "place_id"))
        .select(*target, "pos")
    )

    keys = found.filter(F.length("key") > 0).groupBy(query, "key").agg(F.min("pos").alias("pos"))
    names = wanted.filter(F.length("key") > 0)
    inside_label = (
        keys.select(query, "pos", F.inline(_all_pieces(F.col("key"))))
        .groupBy(query, "size", "piece")
        .agg(F.min("pos").alias("pos"))
    )
    label_heads = (
        keys.select(query, "pos", F.inline(_heads(F.col("key"))))
        .groupBy(query, "size", "piece")
        .agg(F.min("pos").alias("pos"))
    )
    piece = [query, "size", "piece"]
    name_in_label = names.select(*target, F.inline(_heads(F.col("key")))).join(inside_label, piece)
    label_in_name = names.select(*target, F.inline(_all_pieces(F.col("key")))).join(
        label_heads, piece
    )

    head = found.groupBy(query).agg(F.min("pos").alias("pos"))
    fallback = wanted.join(head, query)

    zero = F.lit(0)
    votes = (
        same_link.select(*target, vote(0, zero))
        .unionByName(id_in_link.select(*target, vote(0, zero)))
        .unionByName(name_in_label.select(*target, vote(1, F.col("size"))))
        .unionByName(label_in_name.select(*target, vote(1, F.col("size"))))
        .unionByName(fallback.select(*target, vote(2, zero)))
    )
    best = votes.groupBy(*target).agg(F.min("vote").alias("vote"))
    return best.select(
        *target,
        F.col("vote.tier").alias("tier"),
        (-F.col("vote.order")).alias("overlap"),
        F.col("vote.pos").alias("pos"),
    ).join(listings.select(query, "pos", "label", "href"), [query, "pos"])

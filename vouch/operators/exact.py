"""Exact phrase hits in review text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouch.functions.text import let

# characters compared when two reviews are taken for copies of each other
COPY_PREFIX = 120

TOUCHED = ["qid", "place_id", "place_name", "review_id", "copy_key", "found", "score"]

# never part of a text, so LIKE patterns have no escapes
_NO_ESCAPE = "\x00"


def has_variant(low: Column, variant: Column, wildcards: bool = False) -> Column:
    """Whether lower-cased text holds the variant; with ``wildcards`` as a LIKE pattern."""
    if wildcards:
        pattern = F.concat(F.lit("%"), variant, F.lit("%"))
        return F.like(low, pattern, F.lit(_NO_ESCAPE))
    return F.contains(low, variant)


def found_variants(text: Column, variants: Column, wildcards: bool = False) -> Column:
    """Those of ``variants`` that occur in ``text``, in array order."""
    return let(
        F.lower(text),
        lambda low: F.filter(variants, lambda v: has_variant(low, v, wildcards)),
    )


def any_variant(text: Column, variants: Column, wildcards: bool = False) -> Column:
    return let(
        F.lower(text),
        lambda low: F.exists(variants, lambda v: has_variant(low, v, wildcards)),
    )


def attach_queries(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Put the whole query table ``qid, variants`` into a list column ``asked``.

    It comes from a scalar subquery: computed once, then a constant in each task.
    """
    asked = queries.agg(F.collect_list(F.struct("qid", "variants")).alias("asked")).scalar()
    return df.withColumn("asked", asked)


def touched_reviews(
    reviews: DataFrame,
    queries: DataFrame,
    hits: DataFrame | None = None,
    wildcards: bool = False,
) -> DataFrame:
    """The reviews that bear on a query, for all queries in one scan of the text.

    ``qid, place_id, place_name, review_id, copy_key, found, score`` for each review
    that holds a variant of the query (``found``) or is among its text hits
    (``hits(qid, review_id, score)``).
    """
    texts = attach_queries(reviews, queries.select("qid", "variants"))
    if hits is None:
        texts = texts.withColumn("scores", F.lit(None))
        score_of = lambda q: F.lit(None).cast("double")
    else:
        by_review = hits.groupBy("review_id").agg(
            F.map_from_entries(F.collect_list(F.struct("qid", "score"))).alias("scores")
        )
        texts = texts.join(by_review, "review_id", "left")
        score_of = lambda q: F.try_element_at(F.col("scores"), q["qid"])

    per_query = lambda low: F.transform(
        F.col("asked"),
        lambda q: F.struct(
            q["qid"].alias("qid"),
            F.filter(q["variants"], lambda v: has_variant(low, v, wildcards)).alias("found"),
            score_of(q).alias("score"),
        ),
    )
    bearing = let(
        F.lower("text"),
        lambda low: F.filter(
            per_query(low), lambda m: (F.size(m["found"]) > 0) | m["score"].isNotNull()
        ),
    )
    # inside the generator the list is computed once; as a column of its own it would
    # be computed again by a filter the optimizer derives from the generator
    keyed = texts.withColumn("copy_key", F.substring("text", 1, COPY_PREFIX))
    return keyed.select(
        "place_id", "place_name", "review_id", "copy_key", F.inline(bearing)
    ).select(*TOUCHED)


def variant_hits(touched: DataFrame) -> DataFrame:
    """Reviews per query, place and variant.

    ``reviews`` counts each review only under its first variant, so that it adds up to
    distinct reviews.
    """
    return (
        touched.select("qid", "place_id", "place_name", F.posexplode("found").alias("at", "variant"))
        .groupBy("qid", "place_id", "variant")
        .agg(
            F.count("*").alias("hits"),
            F.count_if(F.col("at") == 0).alias("reviews"),
            F.min("place_name").alias("place_name"),
        )
    )


def place_hits(hits: DataFrame) -> DataFrame:
    """Per query and place: hits summed over variants, distinct reviews, and the map."""
    entries = F.array_sort(F.collect_list(F.struct("variant", "hits")))
    return hits.groupBy("qid", "place_id").agg(
        F.sum("hits").alias("exact_hits"),
        F.sum("reviews").alias("exact_reviews"),
        F.map_from_entries(entries).alias("variant_hits"),
        F.min("place_name").alias("place_name"),
    )


def with_place_name(hits: DataFrame, places: DataFrame) -> DataFrame:
    """The name of the stored place, else the one the reviews carry."""
    names = places.select("place_id", F.col("name").alias("stored_name"))
    return (
        hits.join(names, "place_id", "left")
        .withColumn("name", F.coalesce("stored_name", "place_name"))
        .drop("stored_name", "place_name")
    )


def mentions_by_name(reviews: DataFrame, phrases: list[str]) -> DataFrame:
    """Reviews holding any of the phrases, counted per place name, most first."""
    any_phrase = F.exists(
        F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower("text"), p)
    )
    return (
        reviews.filter(any_phrase)
        .groupBy("place_name")
        .agg(F.count("*").alias("hits"))
        .orderBy(F.desc("hits"), "place_name")
    )

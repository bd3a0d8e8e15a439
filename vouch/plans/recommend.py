"""Which place should I pick for X."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from vouch.functions import display
from vouch.functions.text import snippet
from vouch.operators.bm25 import TASK_TEXT, Index, text_bytes
from vouch.operators.exact import place_hits, touched_reviews, variant_hits
from vouch.operators.phrase_index import touched_by_words
from vouch.operators.queries import with_variants
from vouch.operators.ranking import (
    best_places,
    candidates,
    evidence,
    located_hits,
    of_places,
    with_place,
    with_rating,
)
from vouch.plans.search import ranked_hits
from vouch.session import SMALL_ROWS, least_partitions, materialize, small_rows
from vouch.sources.tables import keyed_join

def _blocks(asked: DataFrame) -> list[DataFrame]:
    """The query table in blocks small enough to be a constant in each task of a scan."""
    if small_rows(asked.select("qid")) is not None:
        return [asked]
    count = asked.count() // (SMALL_ROWS // 2) + 1
    block = F.pmod(F.xxhash64("qid"), F.lit(count))
    return [asked.filter(block == number) for number in range(count)]


# up to so many phrases comparing each text with each of them costs less than cutting it into words
MANY_PHRASES = 1_000


def _way_to_match(asked: DataFrame, wildcards: bool) -> str:
    """How to find the phrases: by their number."""
    if wildcards:
        return "scan"
    phrases = small_rows(asked.select(F.explode("variants")).distinct(), MANY_PHRASES)
    return "index" if phrases is None else "scan"


def touched(
    reviews: DataFrame,
    asked: DataFrame,
    index: Index | None,
    bm25_top_n: int = 50,
    wildcards: bool = False,
    match: str = "auto",
) -> DataFrame:
    """Reviews bearing on the queries ``asked(qid, query, variants)``, as a written table.

    ``match`` says how phrases are found, with the same result: ``scan`` compares
    each text with each phrase, ``index`` looks up the rarest word of each of many phrases among
    the words of the texts.  Hits come from the reviews given in either way, as a saved index may be older.
    """
    hits = None if index is None else ranked_hits(index, asked, bm25_top_n)
    if match == "auto":
        match = _way_to_match(asked, wildcards)
    if match == "scan":
        blocks = [touched_reviews(reviews, block, hits, wildcards) for block in _blocks(asked)]
        return materialize(reduce(DataFrame.unionByName, blocks), "touched")
    if match != "index":
        raise ValueError(f"unknown way to match {match!r}")
    # words and texts met are shuffled in tasks that follow the texts
    size = text_bytes(reviews.select(F.col("text").alias("contents")))
    with least_partitions(reviews.sparkSession, -(-size // TASK_TEXT)):
        rows = touched_by_words(reviews, asked)
        if hits is not None:
            rows = rows.unionByName(located_hits(hits, reviews))
        return materialize(rows, "touched")


def ranked_places(
    rows: DataFrame, places: DataFrame, top_places: int = 10, order_by: str = "hits"
) -> DataFrame:
    """The best places per query out of touched reviews, as a written table."""
    rated = with_rating(candidates(rows), places)
    best = materialize(best_places(rated, top_places, order_by), "best")
    # the filter repeats the cut, so that the planner knows the table to be selective
    return best.filter(F.col("rank") <= top_places)


def quotes(
    rows: DataFrame,
    best: DataFrame,
    reviews: DataFrame,
    asked: DataFrame,
    per_place: int = 3,
    redact: bool = False,
) -> DataFrame:
    """The evidence of each ranked place with text and snippet, one row per quote."""
    picked = materialize(evidence(of_places(rows, best), per_place), "quotes").filter(
        F.col("n") <= per_place
    )
    columns = ("shard", "review_id", "text", "rating", "published_date", "reviewer_name")
    told = reviews.select(*[c for c in columns if c in reviews.columns])
    return (
        keyed_join(picked, told, "review_id")
        .join(asked.select("qid", "variants"), "qid")
        .select(
            "qid",
            "place_id",
            "n",
            "review_id",
            "rating",
            F.col("published_date").alias("date"),
            (F.lit(None).cast("string") if redact else F.col("reviewer_name")).alias("reviewer"),
            "score",
            "text",
            snippet(F.col("text"), F.col("variants")).alias("snippet"),
        )
    )


def details(rows: DataFrame, best: DataFrame, places: DataFrame) -> DataFrame:
    """The ranked places with their stored data and hits per spelling."""
    hits = place_hits(variant_hits(of_places(rows, best)))
    return with_place(best, hits, places)


def recommend(
    reviews: DataFrame,
    places: DataFrame,
    index: Index | None,
    queries: DataFrame,
    top_places: int = 10,
    snippets_per_place: int = 3,
    bm25_top_n: int = 50,
    order_by: str = "hits",
    wildcards: bool = False,
    match: str = "auto",
    redact: bool = False,
) -> DataFrame:
    """The best places of each query with hits per spelling and quoted reviews.

    ``queries(qid, query, synonyms)``.  Places are ranked by exact hits, then best text
    score, then rating; ``order_by='score'`` ranks by the combined score instead.
    Without an index only exact hits count.  The text is read once for the matches and
    then only for the reviews quoted.
    """
    asked = with_variants(queries)
    rows = touched(reviews, asked, index, bm25_top_n, wildcards, match)
    best = ranked_places(rows, places, top_places, order_by)
    told = quotes(rows, best, reviews, asked, snippets_per_place, redact)
    columns = ["n", "review_id", "rating", "date", "reviewer", "score", "text", "snippet"]
    listed = told.groupBy("qid", "place_id").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("snippets")
    )
    nothing = F.array().cast(listed.schema["snippets"].dataType)
    shown = details(rows, best, places)
    return (
        shown.join(listed, ["qid", "place_id"], "left")
        .withColumn("snippets", F.coalesce("snippets", nothing))
        .join(asked.select("qid", "query", "variants"), "qid")
        .select("qid", "query", "variants", *[c for c in shown.columns if c != "qid"], "snippets")
    )


def recommend_display(ranked: DataFrame) -> DataFrame:
    """Ranked places as shown to a reader."""
    return ranked.select(
        "qid",
        "rank",
        F.col("name").alias("place"),
        "exact_hits",
        display.score(F.col("bm25_top")).alias("bm25_top"),
        display.place_rating(F.col("rating")).alias("rating"),
        display.count(F.col("review_count")).alias("reviews"),
        display.mentions(F.col("variant_hits")).alias("mentions"),
    )


def quotes_display(told: DataFrame) -> DataFrame:
    return told.select(
        "qid",
        "place_id",
        "n",
        display.evidence_meta(
            F.col("rating"), F.col("date"), F.col("reviewer"), F.col("score")
        ).alias("meta"),
        "snippet",
    )

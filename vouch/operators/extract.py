"""Review fields out of candidate strings found in stored pages.

``candidates(page_id, block_pos, field, selector_rank, pos, text)`` lists for each block
of a page the strings that may be the value of a field, better selectors first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vouch.functions.ids import source_review_id
from vouch.functions.listing import stars
from vouch.functions.text import is_blank, strip
from vouch.operators.blocks import element_blocks
from vouch.operators.upsert import numbered

# Limits of acceptable strings, and words that mark a span as page furniture.
NAME_LIMIT = 120
DATE_LIMIT = 80
TEXT_MIN = 2
SPAN_MIN = 15
SPAN_COUNT = 40
FURNITURE = ("photo", "local guide", "reviews", "star", "more")

SPANS = "span"
BLOCK = ["page_id", "block_pos"]


def page_candidates(
    pages: DataFrame,
    selectors: list[tuple[str, int, str]],
    block: str | None = None,
    elements: list[str] | None = None,
) -> DataFrame:
    """Candidates of stored HTML.

    ``selectors`` are (field, rank, pattern); group 1 of the pattern is the text.
    One review's part of a page is a match of the pattern ``block``, or an element of the names ``elements`` with all
    that is nested in it; without either a page is one block.
    """
    lists = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.lit(rank).alias("selector_rank"),
                F.regexp_extract_all("html", F.lit(pattern), 1).alias("texts"),
            )
            for name, rank, pattern in selectors
        ]
    )
    if elements is not None:
        parts = element_blocks(pages, elements).drop("name")
    elif block is None:
        parts = pages.select("page_id", F.lit(0).alias("block_pos"), "html")
    else:
        found = F.regexp_extract_all("html", F.lit(f"(?s){block}"), 0)
        parts = pages.select("page_id", F.posexplode(found).alias("block_pos", "html"))
    return (
        parts.select("page_id", "block_pos", F.inline(lists))
        .select("*", F.posexplode("texts").alias("pos", "text"))
        .select(*BLOCK, "field", "selector_rank", "pos", "text")
    )


def first_per_selector(candidates: DataFrame) -> DataFrame:
    """Only the first string of each selector; all strings of the span list."""
    cleaned = candidates.withColumn("text", strip(F.col("text")))
    single = (
        cleaned.filter(F.col("field") != SPANS)
        .groupBy(*BLOCK, "field", "selector_rank")
        .agg(F.min(F.struct("pos", "text")).alias("first"))
        .select(*BLOCK, "field", "selector_rank", "first.pos", "first.text")
    )
    return single.unionByName(cleaned.filter(F.col("field") == SPANS).select(*single.columns))


def _first(field: str, accept: Column) -> Column:
    """Text of the best-ranked acceptable string of a field."""
    wanted = (F.col("field") == field) & accept
    return F.min(
        F.when(wanted, F.struct(F.col("selector_rank"), F.col("pos"), F.col("text")))
    )["text"]


def _longest_span() -> Column:
    """The longest of the first spans that is long enough and no page furniture."""
    low = F.lower("text")
    noise = F.exists(F.array(*[F.lit(word) for word in FURNITURE]), lambda w: F.contains(low, w))
    wanted = (
        (F.col("field") == SPANS)
        & (F.col("pos") < SPAN_COUNT)
        & (F.length("text") > SPAN_MIN)
        & ~noise
    )
    return F.max(
        F.when(wanted, F.struct(F.length("text").alias("size"), (-F.col("pos")), F.col("text")))
    )["text"]


def block_fields(candidates: DataFrame) -> DataFrame:
    """One row per block with the chosen value of each field."""
    size = F.length("text")
    return (
        first_per_selector(candidates)
        .groupBy(*BLOCK)
        .agg(
            F.coalesce(
                _first("name", (size > 0) & (size < NAME_LIMIT) & ~F.col("text").rlike(r"^\d")),
                F.lit(""),
            ).alias("reviewer_name"),
            F.coalesce(_first("text", size > TEXT_MIN), _longest_span(), F.lit("")).alias("text"),
            F.coalesce(_first("date", (size > 0) & (size < DATE_LIMIT)), F.lit("")).alias(
                "published_date"
            ),
            _first("response", size > 0).alias("owner_response"),
            stars(_first("rating", F.col("text").rlike(r"\d"))).alias("rating"),
            _first("source_id", size > 0).alias("source_id"),
        )
    )


def assemble_reviews(fields: DataFrame, places: DataFrame) -> DataFrame:
    """Review rows of the blocks of each place's page; blocks without text are dropped.

    ``places(page_id, place_id, name)``.  A block without an id of its own gets one from
    its page and position.
    """
    spot = F.concat_ws("_", F.lit("gen"), F.col("page_id"), F.col("block_pos") + 1)
    source = F.coalesce("source_id", spot)
    return (
        fields.filter(~is_blank(F.col("text")))
        .join(places.select("page_id", "place_id", F.col("name").alias("place_name")), "page_id")
        .select(
            source_review_id(F.col("place_id"), source).alias("review_id"),
            "place_id",
            "place_name",
            "text",
            "rating",
            "published_date",
            "reviewer_name",
            "owner_response",
            F.struct("page_id", "block_pos").alias("pos"),
        )
    )


def age_in_days(date: Column) -> Column:
    """Days of ``3 months ago``, ``a week ago`` and the like; NULL for anything else."""
    low = F.lower(date)
    shape = r"(\d+|an?) (minute|hour|day|week|month|year)s? ago"
    count = F.regexp_extract(low, shape, 1)
    number = F.when(count.isin("a", "an"), F.lit(1)).otherwise(count.try_cast("int"))
    unit = F.regexp_extract(low, shape, 2)
    days = {"minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
    size = F.lit(None).cast("double")
    for name, length in days.items():
        size = F.when(unit == name, F.lit(length)).otherwise(size)
    return number * size


def cap_reviews(
    reviews: DataFrame, max_reviews: int = 100, sort_by: str = "newest", newest: str = "scraped_at"
) -> DataFrame:
    """At most ``max_reviews`` per place, each source review once, in the order asked for.

    The newest reviews are those with the latest ``newest``, where there is such a column, then those whose
    date tells the smallest age.
    """
    stamp = [F.desc(newest)] if newest in reviews.columns else []
    age = [F.asc_nulls_last(age_in_days(F.col("published_date")))] if "published_date" in reviews.columns else []
    orders = {
        "relevant": [],
        "newest": stamp + age,
        "highest_rating": [F.desc_nulls_last("rating")],
        "lowest_rating": [F.asc_nulls_last("rating")],
    }
    # chosen by numbers, so that texts are neither sorted nor moved before the cut
    rows = numbered(reviews, "extracted")
    once = W.partitionBy("review_id").orderBy("pos", "row_no")
    first = rows.withColumn("n", F.row_number().over(once)).filter("n = 1")
    best = W.partitionBy("place_id").orderBy(*orders[sort_by], "pos", "review_id")
    kept = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_reviews)
    columns = [c for c in reviews.columns if c not in ("pos", "review_id")]
    return rows.join(kept.select("row_no", "rank"), "row_no").select("review_id", "pos", *columns, "rank")

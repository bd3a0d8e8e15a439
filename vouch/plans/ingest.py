"""Import of listing results into the keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouch.functions.ids import UNKNOWN_PLACE
from vouch.operators.bm25 import Index, is_saved
from vouch.operators.upsert import latest, replace_rows
from vouch.plans.indexing import append_reviews, index_reviews
from vouch.schemas import PLACES, REVIEWS, conform, now_utc
from vouch.session import materialize
from vouch.sources.entries import entry_places, entry_reviews, parsed_entries
from vouch.sources.tables import TableStore


def place_updates(entries: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Place rows of all entries with ``seq``; of equal ids the last entry counts."""
    stamp = now_utc() if scraped_at is None else scraped_at
    return entry_places(entries).withColumn("scraped_at", stamp)


def review_updates(entries: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Review rows of all entries with ``seq``.

    Of equal ids the last entry counts, and within an entry the first occurrence.
    """
    stamp = now_utc() if scraped_at is None else scraped_at
    order = F.struct(F.col("seq"), (-F.col("list_no")).alias("l"), (-F.col("pos")).alias("p"))
    return (
        entry_reviews(entries)
        .withColumn("scraped_at", stamp)
        .withColumn("seq", order)
        .drop("list_no", "pos")
    )


def first_in_entry(reviews: DataFrame) -> DataFrame:
    """Each review once per entry, the better list and the earlier place first."""
    columns = [c for c in reviews.columns if c not in ("seq", "review_id", "list_no", "pos")]
    row = F.struct(*columns)
    return (
        reviews.groupBy("seq", "review_id")
        .agg(F.min_by(row, F.struct("list_no", "pos")).alias("row"))
        .select("seq", "review_id", "row.*")
    )


def import_stats(entries: DataFrame) -> DataFrame:
    """``entries`` read, of those ``unknown_places`` without any id, and ``reviews_upserted``.

    Repeats within an entry count once; that is settled inside each row.
    """
    rows = entries if "reviews" in entries.columns else parsed_entries(entries)
    sent = F.size(F.array_distinct(F.transform("reviews", lambda review: review["review_id"])))
    return rows.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("place_id") == UNKNOWN_PLACE).alias("unknown_places"),
        F.coalesce(F.sum(sent), F.lit(0)).alias("reviews_upserted"),
    )


def fresh_rows(
    entries: DataFrame, scraped_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """The place and review rows an import brings, one per key, in table form."""
    return (
        conform(latest(place_updates(entries, scraped_at), "place_id", "seq"), PLACES),
        conform(latest(review_updates(entries, scraped_at), "review_id", "seq"), REVIEWS),
    )


def import_entries(
    entries: DataFrame, places: DataFrame, reviews: DataFrame, scraped_at: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after the import, and its counts."""
    new_places, new_reviews = fresh_rows(entries, scraped_at)
    return (
        replace_rows(conform(places, PLACES), new_places, "place_id"),
        replace_rows(conform(reviews, REVIEWS), new_reviews, "review_id"),
        import_stats(entries),
    )


def _import(store: TableStore, entries: DataFrame, scraped_at: Column | None) -> tuple[DataFrame, DataFrame]:
    """Import and commit both tables; the counts and the fresh reviews."""
    # written first, so that the raw text is read and parsed once for both tables and the counts
    parsed = materialize(parsed_entries(entries), "parsed")
    for name, fresh in zip(("places", "reviews"), fresh_rows(parsed, scraped_at)):
        store.upsert(name, fresh)  # reads the written versions without the older ones
    return import_stats(parsed), fresh


def import_into(store: TableStore, entries: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Import and commit both tables; returns the counts."""
    return _import(store, entries, scraped_at)[0]


def import_and_index(
    store: TableStore, entries: DataFrame, index_path: str, scraped_at: Column | None = None
) -> tuple[DataFrame, Index | None]:
    """Import, then let the index follow: a new one of all reviews, or the imported ones appended to that below ``index_path``."""
    stats, fresh = _import(store, entries, scraped_at)
    if is_saved(store.spark, index_path):
        return stats, append_reviews(store.spark, fresh, index_path)
    reviews = store.read("reviews")
    index = None if reviews.isEmpty() else index_reviews(reviews, index_path)
    return stats, index

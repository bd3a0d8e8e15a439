"""Keyed upsert and the set operations around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouch.session import materialize


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` written with a number per row, ``row_no``, so that rows can be chosen by narrow columns."""
    return materialize(df.withColumn("row_no", F.monotonically_increasing_id()), label)


def newest_rows(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """``row_no`` of one row per key, that with the highest ``seq``."""
    number = F.coalesce(F.max_by("row_no", seq), F.max("row_no")).alias("row_no")
    return rows.groupBy(key).agg(number).select("row_no")


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, the one with the highest ``seq``; a row without it comes last.

    Only key, ``seq`` and row number are aggregated.  Wide rows are written once and neither sorted nor
    shuffled for it, unless so many of them are older versions that their numbers can't be broadcast.
    """
    columns = [key, *[c for c in df.columns if c not in (key, seq)]]
    rows = numbered(df, "versions")
    older = materialize(rows.select("row_no").join(newest_rows(rows, key, seq), "row_no", "left_anti"), "older")
    return rows.join(older, "row_no", "left_anti").select(*columns)


def replace_rows(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``existing`` with whole rows replaced or added from ``fresh``, one row per key.

    Existing rows only meet an anti join: few fresh rows are broadcast and the table is
    not shuffled at all.
    """
    columns = [c for c in existing.columns if c != "shard"]
    kept = existing.select(*columns).join(fresh.select(key), key, "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns))


def upsert(existing: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """Upsert of ``updates``, of which the highest ``seq`` per key counts."""
    return replace_rows(existing, latest(updates, key, seq), key)


def upsert_counts(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``rows_in`` sent and ``rows_new`` keys not seen before."""
    keys = updates.groupBy(key).agg(F.count("*").alias("n"))
    known = existing.select(key).withColumn("known", F.lit(1))
    return keys.join(known, key, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.count_if(F.col("known").isNull()).alias("rows_new"),
    )


def not_stored(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return new.join(existing.select(key), key, "left_anti")

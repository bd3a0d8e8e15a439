"""Query tables and the spellings a query is searched under."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouch.functions.text import squash

Query = str | tuple[str, list[str]]


def query_table(spark: SparkSession, queries: Iterable[Query]) -> DataFrame:
    """``qid, query, synonyms`` of queries given as text or as (text, synonyms)."""
    rows = [(q, []) if isinstance(q, str) else (q[0], list(q[1] or [])) for q in queries]
    table = pa.table(
        {
            "qid": pa.array(range(len(rows)), pa.int64()),
            "query": pa.array([query for query, _ in rows], pa.string()),
            "synonyms": pa.array([extra for _, extra in rows], pa.list_(pa.string())),
        }
    )
    return spark.createDataFrame(table)


def spellings(phrase: Column) -> Column:
    """The normalised phrase; of several words also hyphenated and joined."""
    words = F.split(squash(phrase), " ")
    plain = F.array_join(words, " ")
    forms = F.array(plain, F.array_join(words, "-"), F.array_join(words, ""))
    return F.when(F.size(words) > 1, forms).when(plain != "", F.array(plain)).otherwise(
        F.array().cast("array<string>")
    )


def expand(query: Column, synonyms: Column) -> Column:
    """Sorted distinct spellings of the query and of each synonym."""
    phrases = F.concat(
        F.array(query), F.coalesce(synonyms, F.array().cast("array<string>"))
    )
    return F.array_sort(F.array_distinct(F.flatten(F.transform(phrases, spellings))))


def with_variants(queries: DataFrame) -> DataFrame:
    """``qid, query, variants``; the ``synonyms`` column is optional."""
    synonyms = (
        F.col("synonyms")
        if "synonyms" in queries.columns
        else F.lit(None).cast("array<string>")
    )
    return queries.select("qid", "query", expand(F.col("query"), synonyms).alias("variants"))

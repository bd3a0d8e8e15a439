"""Building and describing the text index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouch.operators import bm25
from vouch.operators.corpus import corpus


def build_index(
    reviews: DataFrame, stop=None, vocab: DataFrame | None = None, buckets: int | None = None
) -> bm25.Index:
    """Index of the reviews, computed when used."""
    return bm25.build(corpus(reviews), stop, vocab, buckets)


def index_reviews(
    reviews: DataFrame,
    path: str,
    stop=None,
    vocab: DataFrame | None = None,
    buckets: int | None = None,
) -> bm25.Index:
    """Index of the reviews written below ``path``; fails when there is nothing to index."""
    index = bm25.save(build_index(reviews, stop, vocab, buckets), path)
    if index.stats.filter(F.col("n_docs") > 0).isEmpty():
        raise RuntimeError("no reviews with text to index")
    return index


def append_reviews(
    spark: SparkSession, reviews: DataFrame, path: str, stop=None, vocab: DataFrame | None = None
) -> bm25.Index:
    """The index below ``path`` with ``reviews`` added as a segment, in place of older reviews of the same ids.

    Reviews that have no text any more drop out of the index.
    """
    return bm25.append(spark, path, corpus(reviews), reviews.select("review_id"), stop, vocab)


def index_stats(reviews: DataFrame, index: bm25.Index) -> DataFrame:
    """Documents in the corpus and in the index."""
    wanted = corpus(reviews).agg(F.count("*").alias("corpus_docs"))
    return wanted.withColumn("indexed_docs", index.stats.select("n_docs").scalar())

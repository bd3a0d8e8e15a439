"""From raw documents to training data: each stage works on all rows that the one before kept.

Rows are told apart as rows, not by id: a row without id or one that shares its id is judged for itself.  Null and empty texts
pass every stage.  Columns that the documents have besides their own are carried along whatever their name, except that
the last stage numbers its own columns where theirs have the same name.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouch.llm.mixing import mix_documents
from vouch.llm.near_dup import drop_near_duplicates
from vouch.llm.queries import MIX, label_domains, piece_model
from vouch.llm.sentencepiece import encode
from vouch.llm.spans import remove_repeated_spans
from vouch.llm.toxicity import keep_clean, train
from vouch.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8): that with the smallest id."""
    return drop_near_duplicates(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences that repeat a span of an earlier document or place."""
    return remove_repeated_spans(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that good and poor ones have their target shares of the tokens; none is dropped."""
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix_documents(docs, labels, MIX, min_rate=1.0)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids``, ``round_trip`` (whether decoding gives the text back) and ``n_tokens``.

    A column of the documents keeps such a name; the stage's own is then called ``ids_2`` and so on.
    """
    encoded = encode(docs, piece_model(spark), check_col="round_trip")
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("ids", "round_trip", "n_tokens"):
        names.append(next(n for n in [name, *[f"{name}_{i}" for i in range(2, len(taken) + 3)]] if n.lower() not in taken))
    own = encoded.toDF(*[f"c{i}" for i in range(len(encoded.columns))])
    return own.withColumn("size", F.size(f"c{len(docs.columns)}")).toDF(*docs.columns, *names)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

# A trained classifier, a sketch and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

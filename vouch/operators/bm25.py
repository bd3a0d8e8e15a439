"""BM25 over an inverted index held in plain tables.

``postings(term, doc_id, tf, dl)`` has one row per term and document, and one row with
the empty term per document, so that a single pass over the corpus gives both the
postings and the document list.  ``terms(term, df)`` and ``stats(n_docs, avgdl)`` are
aggregates of it.  The score of a document is

    sum over distinct query terms of
        ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

(Robertson & Zaragoza 2009).  Scores are rounded to six digits before any sort, since
sums added up in another order differ in the last bits.

A saved index is a list of segments.  Each has its postings, the ids that it takes over from older segments (``gone``),
and per bucket of documents and term ``tops``: documents and words added or taken away, the largest ``tf`` and the
least ``dl``.  The newest one has the vocabulary and the statistics of all.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from vouch.functions.text import tokenize
from vouch.session import SMALL_BYTES, file_bytes, least_partitions, materialize, new_path, setting_bytes, small_rows

K1, B = 1.2, 0.75
SCORE_DIGITS = 6

POSTINGS = "term string, doc_id string, tf bigint, dl int"
TERMS = "term string, df bigint"
TOPS = "bucket int, term string, df bigint, length bigint, most_tf bigint, least_dl int"
LAYOUT = "n_docs bigint, length bigint, buckets int"
# a row per segment, written when all else of it is
SEGMENTS = "segment int, buckets int"
# query words with fewer postings than this are scored without looking for postings to skip
PRUNE_POSTINGS = 5_000_000
# bounds, of a query word in a group of buckets each, that all tasks get when postings are looked for to skip
MOST_BOUNDS = 250_000
# text whose words a task counts and sorts; in memory its postings take about forty times as much
TASK_TEXT = 8 << 20
# files of postings, about half of their text, whose words a task adds up
TASK_POSTINGS = 4 << 20
# an index gets a bucket for each such amount of text, up to a number that a catalog and a driver can hold
MOST_BUCKETS = 4096


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    stop: tuple[str, ...] = ()
    vocab: DataFrame | None = None
    buckets: int | None = None
    tops: DataFrame | None = None

    @property
    def docs(self) -> DataFrame:
        return self.postings.filter(F.col("term") == "").select("doc_id", "dl")


def mapping(vocab: DataFrame) -> DataFrame:
    """``term, canonical`` of ``vocab``, a row per term (the first form in order); empty words and forms don't count."""
    forms = vocab.filter("term != '' AND canonical != ''")
    return forms.groupBy("term").agg(F.min("canonical").alias("canonical"))


def canonical(terms: DataFrame, forms: DataFrame, *key: str) -> DataFrame:
    """Replace ``term`` by its ``canonical`` form where ``forms`` has one; ``key`` columns are joined on besides."""
    mapped = terms.join(forms, ["term", *key], "left")
    return mapped.withColumn("term", F.coalesce("canonical", "term")).drop("canonical", *key)


def text_bytes(corpus: DataFrame) -> int:
    """Bytes of all texts of ``corpus(id, contents)``: files tell little of it, as they may be compressed by any factor."""
    return corpus.agg(F.coalesce(F.sum(F.octet_length("contents")), F.lit(0)).alias("n")).first()["n"]


def _parts(spark: SparkSession, size: int, buckets: int | None) -> int:
    """Tasks for ``size`` bytes of text; with ``buckets`` a multiple of these, so that no task has rows of two buckets."""
    needed = -(-size // TASK_TEXT)
    return max(spark.sparkContext.defaultParallelism, needed) if not buckets else buckets * max(1, -(-needed // buckets))


def buckets_for(spark: SparkSession, size: int) -> int:
    """Buckets of an index of ``size`` bytes of text: the shuffle partitions, more of them for more text."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-size // TASK_TEXT)))


def count_terms(
    corpus: DataFrame,
    stop=None,
    vocab: DataFrame | None = None,
    buckets: int | None = None,
    salts: int = 32,
    size: int | None = None,
) -> DataFrame:
    """The postings of ``corpus(id, contents)``, all of a document in one partition.

    The documents are spread by id before their words become rows, so that counting the
    words needs no further shuffle: the text moves once and the far larger postings
    never do.  The number of tasks follows the bytes of the texts (``size``, counted unless given), and with ``buckets`` is a
    multiple of these, so that a task holds the postings of about ``TASK_TEXT`` bytes at any size.  A vocabulary is written to know its bytes: up to ``SMALL_BYTES`` it goes to every
    task and each word is mapped where it stands; a larger one is joined on counted words, frequent ones spread over
    ``salts`` tasks, and the mapped words go back to their documents.
    """
    spark = corpus.sparkSession
    spread = [_parts(spark, text_bytes(corpus) if size is None else size, buckets), "doc_id"]
    docs = (
        corpus.select(F.col("id").cast("string").alias("doc_id"), "contents")
        .repartition(*spread)
        .select("doc_id", tokenize(F.col("contents"), stop).alias("tokens"))
        .withColumn("dl", F.size("tokens"))
    )
    tokens = docs.select(
        "doc_id", "dl", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term")
    )
    posting = ["doc_id", "dl", "term"]
    forms = None if vocab is None else materialize(mapping(vocab), "vocabulary")
    small = forms is not None and file_bytes(forms) <= SMALL_BYTES
    if small:
        tokens = canonical(tokens, F.broadcast(forms))
    counted = tokens.groupBy(*posting).agg(F.count("*").alias("tf"))
    if forms is not None and not small:
        salted = counted.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
        dealt = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        mapped = canonical(salted, dealt, "salt").repartition(*spread)
        counted = mapped.groupBy(*posting).agg(F.sum("tf").alias("tf"))
    return counted.select("term", "doc_id", "tf", "dl")


def index_of(
    postings: DataFrame, stop=None, vocab: DataFrame | None = None, buckets: int | None = None
) -> Index:
    terms = (
        postings.filter(F.col("term") != "").groupBy("term").agg(F.count("*").alias("df"))
    )
    stats = postings.filter(F.col("term") == "").agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")
    )
    return Index(postings, terms, stats, tuple(stop or ()), vocab, buckets)


def build(
    corpus: DataFrame, stop=None, vocab: DataFrame | None = None, buckets: int | None = None
) -> Index:
    """An index that is computed when used; only the bytes of the texts are counted at once."""
    size = text_bytes(corpus)
    buckets = buckets or buckets_for(corpus.sparkSession, size)
    return index_of(count_terms(corpus, stop, vocab, buckets, size=size), stop, vocab, buckets)


def bucket_of(doc_id, buckets: int):
    """The bucket that a bucketed table keeps a document in."""
    return F.pmod(F.hash(doc_id), F.lit(buckets))


def _segment(path: str, number: int) -> str:
    return f"{path}/segment-{number:08d}"


def _postings_table(folder: str, buckets: int) -> str:
    """Name of a segment's postings in the session's catalog."""
    return f"postings_{hashlib.md5(folder.encode()).hexdigest()}_{buckets}"


def _tops(postings: DataFrame, buckets: int) -> DataFrame:
    return postings.groupBy(bucket_of(F.col("doc_id"), buckets).alias("bucket"), "term").agg(
        F.count("*").alias("df"),
        F.sum(F.col("dl").cast("bigint")).alias("length"),
        F.max("tf").alias("most_tf"),
        F.min("dl").alias("least_dl"),
    )


def _merged(tops: DataFrame) -> DataFrame:
    return tops.groupBy("bucket", "term").agg(
        F.sum("df").alias("df"),
        F.sum("length").alias("length"),
        F.max("most_tf").alias("most_tf"),
        F.min("least_dl").alias("least_dl"),
    )


def _write_segment(
    spark: SparkSession, path: str, number: int, postings: DataFrame, buckets: int, before: Index | None, replaced
) -> None:
    """Write a segment.  The words of each bucket and the vocabulary are added up by tasks that follow the postings, older ones too."""
    folder = _segment(path, number)
    with least_partitions(spark, buckets):
        (
            postings.write.bucketBy(buckets, "doc_id")
            .sortBy("term", "doc_id")
            .option("path", f"{folder}/postings")
            .saveAsTable(_postings_table(folder, buckets))
        )
    held = file_bytes(spark.read.schema(POSTINGS).parquet(f"{folder}/postings"))
    if before is not None:
        held += file_bytes(before.postings)
    with least_partitions(spark, max(buckets, -(-held // TASK_POSTINGS))):
        _write_sums(spark, path, number, buckets, before, replaced)


def _write_sums(spark: SparkSession, path: str, number: int, buckets: int, before: Index | None, replaced) -> None:
    folder = _segment(path, number)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    written = read("postings", POSTINGS)
    tops = _tops(written, buckets)
    if before is not None:
        ids = written.filter(F.col("term") == "").select("doc_id")
        if replaced is not None:
            ids = ids.union(replaced.select(F.col(replaced.columns[0]).cast("string")))
        ids.distinct().write.parquet(f"{folder}/gone")
        lost = before.postings.join(_hinted(read("gone", "doc_id string")), "doc_id", "left_semi")
        taken = _tops(lost, buckets).select(
            "bucket", "term", (-F.col("df")).alias("df"), (-F.col("length")).alias("length"),
            F.lit(0).cast("bigint").alias("most_tf"), F.lit(None).cast("int").alias("least_dl"),
        )
        tops = _merged(tops.unionByName(taken))
    tops.sortWithinPartitions("term").write.parquet(f"{folder}/tops")
    change = read("tops", TOPS)
    terms = change.filter(F.col("term") != "").groupBy("term").agg(F.sum("df").alias("df"))
    docs = change.filter(F.col("term") == "").select(F.col("df").alias("n_docs"), "length")
    if before is not None:
        terms = terms.unionByName(before.terms).groupBy("term").agg(F.sum("df").alias("df")).filter(F.col("df") > 0)
        old = spark.read.schema(LAYOUT).parquet(f"{_segment(path, number - 1)}/stats")
        docs = docs.unionByName(old.select("n_docs", "length"))
    terms.sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    totals = docs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "length")])
    totals.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/stats")
    spark.range(1).select(F.lit(number).alias("segment"), F.lit(buckets).alias("buckets")).write.mode("append").parquet(
        f"{path}/segments"
    )


def _hinted(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if file_bytes(ids) <= SMALL_BYTES else ids


def save(index: Index, path: str) -> Index:
    """Write the index below ``path`` as its first segment.

    The postings are bucketed by document and sorted by term.  A reader skips to the pages
    of the terms it wants in every bucket; the documents of a frequent term are spread
    evenly over all buckets, and as the planner knows that the terms of a document meet in
    one bucket, scores are added up and cut to the best ones without a shuffle.

    The number of buckets is that of the index (``buckets_for`` its texts, unless given), else the shuffle partitions.
    """
    spark = index.postings.sparkSession
    buckets = index.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write_segment(spark, path, 1, index.postings, buckets, None, None)
    return load(spark, path, index.stop, index.vocab)


def is_saved(spark: SparkSession, path: str) -> bool:
    """Whether an index has been written below ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append(
    spark: SparkSession,
    path: str,
    corpus: DataFrame,
    replaced: DataFrame | None = None,
    stop=None,
    vocab: DataFrame | None = None,
) -> Index:
    """Add ``corpus(id, contents)`` to a saved index as a segment of its own.

    Documents of the same id in older segments, and those whose id is in the first column of ``replaced``, no longer
    count.  Only the new texts are read; of the older postings those of the replaced documents are counted,
    to correct the vocabulary and the statistics.  One writer at a time; readers keep the segments they loaded.
    """
    before = load(spark, path, stop, vocab)
    number = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").agg(F.max("segment")).first()[0] + 1
    fresh = count_terms(corpus, stop, vocab, before.buckets)
    _write_segment(spark, path, number, fresh, before.buckets, before, replaced)
    return load(spark, path, stop, vocab)


def merge(spark: SparkSession, path: str, target: str) -> Index:
    """The live postings of all segments as one, below ``target``; no text is read."""
    index = load(spark, path)
    return save(Index(index.postings.repartition(index.buckets, "doc_id"), index.terms, index.stats, buckets=index.buckets), target)


def load(spark: SparkSession, path: str, stop=None, vocab: DataFrame | None = None) -> Index:
    """A saved index; of a document in several segments the newest counts."""
    rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").orderBy("segment").collect()
    buckets, tables, gone, tops = rows[0]["buckets"], [], None, []
    read = lambda folder, name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    for row in reversed(rows):
        folder = _segment(path, row["segment"])
        name = _postings_table(folder, buckets)
        location = f"{folder}/postings".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({POSTINGS}) USING parquet CLUSTERED BY (doc_id)"
            f" SORTED BY (term, doc_id) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        table = spark.table(name)
        tables.append(table if gone is None else table.join(_hinted(gone), "doc_id", "left_anti").select(*table.columns))
        tops.append(read(folder, "tops", TOPS))
        if row["segment"] > 1:
            ids = read(folder, "gone", "doc_id string")
            gone = ids if gone is None else gone.union(ids)
    newest = _segment(path, rows[-1]["segment"])
    stats = read(newest, "stats", LAYOUT)
    return Index(
        reduce(DataFrame.unionByName, tables),
        read(newest, "terms", TERMS),
        stats.filter("n_docs > 0").select("n_docs", (F.col("length") / F.col("n_docs")).alias("avgdl")),
        tuple(stop or ()),
        vocab,
        buckets,
        tops[0] if len(tops) == 1 else _merged(reduce(DataFrame.unionByName, tops)),
    )


def with_df(index: Index) -> DataFrame:
    """The postings of a saved index without those of the empty word, each with the ``df`` of its word.

    Where the vocabulary is too large to be broadcast, postings that are more than the shuffle partitions hold in small tasks
    are dealt to as many as they need.
    """
    spark, words = index.postings.sparkSession, index.postings.filter(F.col("term") != "")
    needed = -(-file_bytes(index.postings) // TASK_POSTINGS)
    moves = file_bytes(index.terms) > setting_bytes(spark, "spark.sql.autoBroadcastJoinThreshold")
    if moves and needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        words = words.repartition(needed, "term")
    return words.join(index.terms, "term")


def query_terms(queries: DataFrame, stop=None, vocab: DataFrame | None = None) -> DataFrame:
    """Distinct ``qid, term`` of ``queries(qid, query)``."""
    tokens = F.array_distinct(tokenize(F.col("query"), list(stop or ())))
    terms = queries.select("qid", F.explode(tokens).alias("term"))
    return terms if vocab is None else canonical(terms, mapping(vocab)).select("qid", "term").distinct()


def _local_terms(terms: DataFrame, rows: list) -> DataFrame:
    qid = terms.schema["qid"].dataType
    arrow = pa.table(
        {"qid": [r["qid"] for r in rows], "term": pa.array([r["term"] for r in rows], pa.string())}
    )
    local = terms.sparkSession.createDataFrame(arrow)
    return local.withColumn("qid", F.col("qid").cast(qid))


def scores(
    index: Index, queries: DataFrame, k1: float = K1, b: float = B, salts: int = 32
) -> DataFrame:
    """``qid, doc_id, score`` of every document that holds a query term.

    Query terms up to a fixed number are listed in the scan filter.  More of them are written
    and broadcast up to a fixed size.  Beyond it they are joined by shuffle, each term cut into
    ``salts`` parts so that no task gets all the documents of a frequent one.
    """
    wanted = query_terms(queries, index.stop, index.vocab)
    rows = small_rows(wanted)
    postings, terms = index.postings.filter(F.col("term") != ""), index.terms
    if rows is not None:
        words = sorted({row["term"] for row in rows})
        postings = postings.filter(F.col("term").isin(words))
        terms = terms.filter(F.col("term").isin(words))
        wanted = _local_terms(wanted, rows)
    n_docs = index.stats.select("n_docs").scalar()
    avgdl = index.stats.select("avgdl").scalar()
    # at most one row per row of `wanted`
    weighted = wanted.join(terms, "term").select(
        "qid", "term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    small = rows is not None
    if not small:
        weighted = materialize(weighted, "terms")
        small = file_bytes(weighted) <= SMALL_BYTES
    if small:
        matched = postings.join(F.broadcast(weighted), "term")
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
        every = weighted.withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        )
        matched = postings.withColumn("salt", salt).join(every, ["term", "salt"])
    return matched.groupBy("qid", "doc_id").agg(F.round(F.sum(_part(avgdl, k1, b)), SCORE_DIGITS).alias("score"))


def _part(avgdl, k1: float, b: float):
    norm = k1 * (1 - b + b * F.col("dl") / avgdl)
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)


def _asked_words(index: Index, queries: DataFrame) -> tuple[list[dict], float] | None:
    """``qid, term, idf, df`` of the query words and the mean length, where they are few enough for the driver."""
    rows = small_rows(query_terms(queries, index.stop, index.vocab))
    stats = index.stats.first()
    if not rows or stats is None or index.tops is None or not index.buckets:
        return None
    words = sorted({row["term"] for row in rows})
    df = {row["term"]: row["df"] for row in index.terms.filter(F.col("term").isin(words)).collect()}
    idf = {t: math.log(1 + (stats["n_docs"] - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    asked = [{"qid": r["qid"], "term": r["term"], "idf": idf[r["term"]], "df": df[r["term"]]} for r in rows if r["term"] in df]
    return asked, stats["avgdl"]


def _table(spark: SparkSession, rows: list[dict], qid_type, **kinds) -> DataFrame:
    columns = {name: pa.array([row[name] for row in rows], kind) for name, kind in kinds.items()}
    arrow = pa.table({"qid": [row["qid"] for row in rows], **columns})
    return spark.createDataFrame(arrow).withColumn("qid", F.col("qid").cast(qid_type))


def competitive_parts(
    index: Index, asked: list[dict], avgdl: float, qid_type, top_n: int, k1: float = K1, b: float = B
) -> DataFrame:
    """``qid, doc_id, part``: the documents that may reach rank ``top_n`` with the sum of their scored postings.

    The documents of a query's rarest words give it a floor.  The largest impact of each word in each bucket, and what the
    weakest words add up to there at most, tells which words are needed: a document that has none of them stays below the
    floor.  The postings of needed words are scored; those of the others only for documents that may still reach it, in
    the buckets where they are: nothing moves but the documents in reach.
    """
    spark, words = index.postings.sparkSession, F.col("term")
    by_query = defaultdict(list)
    for row in asked:
        by_query[row["qid"]].append(row)
    rare = []
    for rows in by_query.values():
        found = 0
        for row in sorted(rows, key=lambda r: r["df"]):
            if found < 8 * top_n:
                rare.append(row)
                found += row["df"]
    kinds = {"term": pa.string(), "idf": pa.float64()}
    listed = lambda df, rows: df.filter(words.isin(sorted({r["term"] for r in rows})))
    postings = index.postings.filter(words != "")
    scored = listed(postings, rare).join(F.broadcast(_table(spark, rare, qid_type, **kinds)), "term")
    partial = scored.groupBy("qid", "doc_id").agg(F.sum(_part(F.lit(avgdl), k1, b)).alias("score"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score")))
    floors = {r["qid"]: r["score"] for r in partial.withColumn("n", place).filter(F.col("n") == top_n).collect()}
    # scores are compared after rounding
    floor = _table(spark, [{"qid": q, "floor": floors.get(q, 0.0) - 1e-5} for q in by_query], qid_type, floor=pa.float64())

    # buckets that share their bounds, so that these stay few enough for every task
    groups = min(index.buckets, max(1, MOST_BOUNDS // len(asked)))
    group = F.pmod(F.col("bucket"), F.lit(groups))
    tops = (
        listed(index.tops, asked)
        .filter((F.col("most_tf") > 0) & F.col("least_dl").isNotNull())
        .groupBy(group.alias("bucket"), "term")
        .agg(F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"))
    )
    top = F.col("most_tf") / (F.col("most_tf") + k1 * (1 - b + b * F.col("least_dl") / F.lit(avgdl)))
    bounds = (
        tops.join(F.broadcast(_table(spark, asked, qid_type, **kinds)), "term")
        .join(F.broadcast(floor), "qid")
        .select("qid", "bucket", "term", "idf", "floor", (F.col("idf") * (k1 + 1) * top).alias("most"))
    )
    weakest = W.partitionBy("qid", "bucket").orderBy("most", "term")
    bounds = bounds.withColumn("upto", F.sum("most").over(weakest)).withColumn("needed", F.col("upto") >= F.col("floor"))
    rest = F.coalesce(F.max(F.when(~F.col("needed"), F.col("upto"))).over(W.partitionBy("qid", "bucket")), F.lit(0.0))
    bounds = materialize(bounds.withColumn("rest", rest), "bounds")

    located = index.postings.withColumn("bucket", F.pmod(bucket_of(F.col("doc_id"), index.buckets), F.lit(groups)))
    needed = bounds.filter("needed").select("qid", "bucket", "term", "idf", "floor", "rest")
    first = (
        listed(located, asked)
        .join(F.broadcast(needed), ["bucket", "term"])
        .groupBy("qid", "doc_id", "floor", "rest")
        .agg(F.sum(_part(F.lit(avgdl), k1, b)).alias("part"))
        .filter(F.col("part") + F.col("rest") >= F.col("floor"))
    )
    # a row per document, kept in the bucket of its postings, which don't move to meet it
    first = _bucketed(first.select("qid", "doc_id", "part"), index.buckets, "first")
    reached = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("qid", "part"))).alias("parts"))
    # the posting of the empty word, which each document has, brings the documents that have none of the other words
    none = needed.select("qid", "bucket").distinct().select("qid", "bucket", F.lit("").alias("term"), F.lit(0.0).alias("idf"))
    others = bounds.filter("not needed").select("qid", "bucket", "term", "idf").unionByName(none)
    scored = (
        listed(located, [*asked, {"term": ""}])
        .join(reached.hint("shuffle_hash"), "doc_id")
        .join(F.broadcast(others), ["bucket", "term"])
        .withColumn("known", F.try_element_at("parts", "qid"))
        .filter(F.col("known").isNotNull())
        .groupBy("qid", "doc_id")
        .agg((F.max("known") + F.sum(_part(F.lit(avgdl), k1, b))).alias("part"))
    )
    # the join leaves out a document without id
    unnamed = first.filter(F.col("doc_id").isNull())
    return scored if unnamed.isEmpty() else scored.unionByName(unnamed)


def _bucketed(df: DataFrame, buckets: int, label: str) -> DataFrame:
    """``df`` written once, in the buckets that postings of the same documents are in."""
    path = new_path(df.sparkSession, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def top_hits(
    index: Index,
    queries: DataFrame,
    top_n: int = 10,
    k1: float = K1,
    b: float = B,
    prune_postings: int = PRUNE_POSTINGS,
) -> DataFrame:
    """``qid, doc_id, score, rank``, the best ``top_n`` of each query; ties by document id.

    In a saved index, query words with ``prune_postings`` postings or more are scored without those that can't matter.
    """
    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    asked = _asked_words(index, queries) if top_n > 0 and index.tops is not None else None
    if asked and sum(row["df"] for row in asked[0]) >= max(1, prune_postings):
        qid_type = queries.schema["qid"].dataType
        parts = competitive_parts(index, *asked, qid_type, top_n, k1, b)
        scored = parts.select("qid", "doc_id", F.round("part", SCORE_DIGITS).alias("score"))
    else:
        scored = scores(index, queries, k1, b)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)

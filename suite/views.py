"""Places, reviews and raw inputs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouch.functions.text import WHITESPACE
from vouch.session import SMALL_BYTES, file_bytes, materialize
from vouch.sources.tables import TASK_BYTES

STAMP = "2024-01-01T00:00:00+00:00"

# whitespace as a SQL expression
WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input of fewer splits than cores; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def places_v(spark: SparkSession, sf: str) -> DataFrame:
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    key = F.col("s_suppkey")
    counts = (
        table(spark, sf, "documents")
        .groupBy((F.col("doc_id") % 120).cast("string").alias("place_id"))
        .agg(F.count("*").alias("n"))
    )
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("s_suppkey"),
        key.cast("string").alias("place_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("address"),
        F.when(key % 7 != 0, 1 + (key % 41) / 10.0).alias("rating"),
        F.concat(F.lit("https://maps.example.com/place/"), "s_name").alias("maps_url"),
        F.lit("supplier").alias("category"),
        F.lit(STAMP).alias("scraped_at"),
    )
    count = F.when(F.col("s_suppkey") % 11 != 0, F.coalesce("n", F.lit(0))).cast("int")
    return rows.join(counts, "place_id", "left").select(
        "place_id", "name", "address", "rating", count.alias("review_count"), "maps_url", "category", "scraped_at"
    )


def reviews_v(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with ``doc_id``, which orders them."""
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    labels = table(spark, sf, "labels")
    doc = F.col("doc_id")
    place = (doc % 120).cast("string")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        doc.cast("string").alias("review_id"),
        place.alias("place_id"),
        F.concat(F.lit("Place "), place).alias("place_name"),
        "text",
        (1 + 3 * F.col("quality") + (1 - F.col("toxic"))).cast("int").alias("rating"),
        F.when(doc % 5 == 0, "")
        .otherwise(F.concat((doc % 12).cast("string"), F.lit(" months ago")))
        .alias("published_date"),
        F.concat(F.lit("user"), (doc % 50).cast("string")).alias("reviewer_name"),
        F.when(doc % 4 == 0, "thanks").alias("owner_response"),
        F.lit(STAMP).alias("scraped_at"),
    )


VIEWS = f"""
places_v AS (
  SELECT cast(s_suppkey AS varchar) AS place_id, s_name AS name, n_name AS address,
         cast(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1 + (s_suppkey % 41) / 10.0 END AS double) AS rating,
         cast(CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE coalesce(c.n, 0) END AS integer) AS review_count,
         'https://maps.example.com/place/' || s_name AS maps_url,
         'supplier' AS category, '{STAMP}' AS scraped_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT cast(doc_id % 120 AS varchar) AS k, count(*) AS n FROM documents GROUP BY 1) c
    ON c.k = cast(s_suppkey AS varchar)),
reviews_v AS (
  SELECT d.doc_id, cast(d.doc_id AS varchar) AS review_id, cast(d.doc_id % 120 AS varchar) AS place_id,
         'Place ' || cast(d.doc_id % 120 AS varchar) AS place_name, d.text,
         cast(1 + 3 * l.quality + (1 - l.toxic) AS integer) AS rating,
         CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE (d.doc_id % 12) || ' months ago' END AS published_date,
         'user' || (d.doc_id % 50) AS reviewer_name,
         CASE WHEN d.doc_id % 4 = 0 THEN 'thanks' END AS owner_response,
         '{STAMP}' AS scraped_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# Raw result entries.  Reviews of a place are nested under it in parts of at most 100, so
# that no entry grows with the data.  Even places use snake case keys, odd ones title
# case.  Labelled reviews are in the extended list; those not labelled or with an owner
# response are in the basic list, so that some are in both.
PART = 12_000


def _nested(rows: Column, chosen: Callable[[Column], Column], fields: dict[str, str]) -> Column:
    item = lambda r: F.struct(*[r[c].alias(name) for c, name in fields.items()])
    return F.transform(F.filter(rows, chosen), item)


_TITLE = {
    "text": "Description",
    "rating": "Rating",
    "published_date": "When",
    "reviewer_name": "Name",
    "owner_response": "OwnerResponse",
}
_SNAKE = {
    "text": "text",
    "rating": "rating",
    "published_date": "date",
    "reviewer_name": "name",
    "owner_response": "owner_response",
}


def entry_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, line``: the raw entries, later parts of a place later."""
    parts = reviews_v(spark, sf).withColumn("part", F.floor(F.col("doc_id") / PART))
    # each review moves once, into so many tasks that none has to spill
    tasks = max(spark.sparkContext.defaultParallelism, -(-file_bytes(table(spark, sf, "documents")) // TASK_BYTES))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", *_TITLE)))
    nested = parts.repartition(tasks, "place_id", "part").groupBy("place_id", "part").agg(rows.alias("rows"))
    labelled = lambda r: r["rating"].isNotNull()
    basic = lambda r: r["rating"].isNull() | r["owner_response"].isNotNull()
    # an entry of an unknown place has its id and its reviews only
    places = materialize(places_v(spark, sf), "places")
    few = F.broadcast(places) if file_bytes(places) <= SMALL_BYTES else places
    entries = nested.join(few, "place_id", "left")
    snake = F.to_json(
        F.struct(
            F.col("name").alias("title"),
            F.col("maps_url").alias("link"),
            "address",
            "category",
            F.col("place_id").alias("cid"),
            "review_count",
            F.col("rating").alias("review_rating"),
            _nested(F.col("rows"), labelled, _TITLE).alias("user_reviews_extended"),
            _nested(F.col("rows"), basic, _TITLE).alias("user_reviews"),
        )
    )
    title = F.to_json(
        F.struct(
            F.col("name").alias("Title"),
            F.col("maps_url").alias("Link"),
            F.col("address").alias("Address"),
            F.col("category").alias("Category"),
            F.col("place_id").alias("PlaceID"),
            F.col("review_count").alias("ReviewCount"),
            F.col("rating").alias("ReviewRating"),
            _nested(F.col("rows"), labelled, _SNAKE).alias("UserReviewsExtended"),
            _nested(F.col("rows"), basic, _SNAKE).alias("UserReviews"),
        )
    )
    even = F.col("place_id").cast("bigint") % 2 == 0
    return entries.select(
        (F.col("part") * 1_000_000 + F.col("place_id").cast("bigint")).alias("seq"),
        F.when(even, snake).otherwise(title).alias("line"),
    )


# The same as flat rows: one per occurrence of a review in a list of an entry.
ENTRIES = f"""
occ AS (
  SELECT r.*, r.doc_id // {PART} AS part, coalesce(p.name, '') AS entry_name,
         (r.doc_id // {PART}) * 1000000 + cast(r.place_id AS bigint) AS seq
  FROM reviews_v r LEFT JOIN places_v p ON r.place_id = p.place_id),
items AS (
  SELECT *, CASE WHEN cast(place_id AS bigint) % 2 = 0 THEN 0 ELSE 1 END AS list_no,
         row_number() OVER (PARTITION BY seq ORDER BY doc_id) - 1 AS pos
  FROM occ WHERE rating IS NOT NULL
  UNION ALL
  SELECT *, CASE WHEN cast(place_id AS bigint) % 2 = 0 THEN 2 ELSE 3 END AS list_no,
         row_number() OVER (PARTITION BY seq ORDER BY doc_id) - 1 AS pos
  FROM occ WHERE rating IS NULL OR owner_response IS NOT NULL),
raw_reviews AS (
  SELECT seq, list_no, pos, place_id, entry_name AS place_name, trim(text, {WS}) AS text, rating,
         published_date, reviewer_name, owner_response,
         place_id || '::' || substr(sha256(place_id || '|' || reviewer_name || '|' || published_date || '|' ||
           substr(trim(text, {WS}), 1, 500)), 1, 16) AS review_id
  FROM items WHERE length(trim(text, {WS})) > 0)"""


def with_views(body: str, *more: str) -> str:
    """SQL with the views, further named queries, and the final select."""
    return "WITH " + ",\n".join([VIEWS, *more]) + "\n" + body

"""Ranking of places, their evidence, and reports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from suite import query
from suite.retrieval import (
    ASKED_SQL,
    MATCHES,
    SCORES,
    asked_queries,
    asked_variants,
    flat_map,
    saved_index,
)
from suite.texts import snippet_sql
from suite.views import places_v, reviews_v, table, with_views
from vouch.operators import exact, ranking
from vouch.operators.status import listed_places, table_counts
from vouch.plans.recommend import (
    details,
    quotes,
    quotes_display,
    ranked_places,
    recommend,
    recommend_display,
    touched,
)
from vouch.plans.tables import register_views
from vouch.schemas import REVIEWS, conform
from vouch.session import new_path
from vouch.sources.tables import TableStore, keyed_join

_NO_ASKED = MATCHES.replace(ASKED_SQL + ",", "")

POOL = f"""
{SCORES},
{_NO_ASKED},
located AS (
  SELECT h.qid, r.place_id, r.review_id, substr(r.text, 1, 120) AS copy_key, h.score
  FROM ranked h JOIN reviews_v r ON h.doc_id = r.review_id WHERE h.rank <= 50),
best_score AS (
  SELECT qid, place_id, max(score) AS bm25_top FROM located WHERE score > 0 GROUP BY qid, place_id),
candidates AS (
  SELECT coalesce(e.qid, b.qid) AS qid, coalesce(e.place_id, b.place_id) AS place_id, e.place_name,
         coalesce(exact_hits, 0) AS exact_hits, coalesce(exact_reviews, 0) AS exact_reviews,
         coalesce(variant_hits, '') AS variant_hits, coalesce(bm25_top, 0.0) AS bm25_top
  FROM place_hits e FULL JOIN best_score b ON e.qid = b.qid AND e.place_id = b.place_id),
pool AS (
  SELECT qid, c.place_id, coalesce(nullif(coalesce(p.name, c.place_name), ''), '?') AS name,
         coalesce(p.address, '') AS address, p.rating, p.review_count, coalesce(p.maps_url, '') AS maps_url,
         exact_hits, exact_reviews, variant_hits, bm25_top, exact_hits * 10.0 + bm25_top AS score
  FROM candidates c LEFT JOIN places_v p ON c.place_id = p.place_id)"""

BEST = f"""
{POOL},
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact_hits DESC, bm25_top DESC,
                   coalesce(rating, 0) DESC, place_id) AS rank FROM pool) WHERE rank <= 10)"""

QUOTES = f"""
{BEST},
tiers AS (
  SELECT qid, place_id, copy_key, review_id, 0 AS tier, score FROM located
  UNION ALL SELECT qid, place_id, copy_key, review_id, 1 AS tier, 0.0 AS score FROM matches),
firsts AS (
  SELECT t.* FROM tiers t SEMI JOIN best b ON t.qid = b.qid AND t.place_id = b.place_id
  QUALIFY row_number() OVER (PARTITION BY t.qid, t.place_id, copy_key ORDER BY tier, score DESC, review_id) = 1),
picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, place_id ORDER BY tier, score DESC, review_id) AS n
                 FROM firsts) WHERE n <= 3),
quotes AS (
  SELECT q.qid, q.place_id, q.n, q.review_id, r.rating, r.published_date AS date, r.reviewer_name AS reviewer, q.score,
         r.text, {snippet_sql('r.text', 'a.variants')} AS snippet
  FROM picked q JOIN reviews_v r ON q.review_id = r.review_id JOIN asked a ON a.qid = q.qid)"""


def stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return reviews_v(spark, sf).drop("doc_id"), places_v(spark, sf)


def bearing(spark: SparkSession, sf: str) -> DataFrame:
    return touched(stored(spark, sf)[0], asked_variants(spark), saved_index(spark, sf))


@query(
    "j4_candidate_places",
    with_views("SELECT qid, place_id, exact_hits, exact_reviews, bm25_top, score FROM pool", POOL),
)
def _(spark, sf):
    return ranking.candidates(bearing(spark, sf))


@query("u2_candidate_keys", with_views("SELECT qid, place_id FROM candidates", POOL))
def _(spark, sf):
    return ranking.candidates(bearing(spark, sf)).select("qid", "place_id")


@query("j5_candidate_details", with_views("SELECT * FROM pool", POOL))
def _(spark, sf):
    rows, places = bearing(spark, sf), places_v(spark, sf)
    pool = ranking.with_rating(ranking.candidates(rows), places).withColumn("rank", F.lit(0))
    hits = exact.place_hits(exact.variant_hits(rows))
    return flat_map(ranking.with_place(pool, hits, places)).drop("rank")


@query("w4_best_places", with_views("SELECT * FROM best", BEST))
def _(spark, sf):
    rows, places = bearing(spark, sf), places_v(spark, sf)
    return flat_map(details(rows, ranked_places(rows, places), places))


@query(
    "w4_best_places_by_score",
    with_views(
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, exact_hits DESC, bm25_top DESC,
                            coalesce(rating, 0) DESC, place_id) AS rank FROM pool) WHERE rank <= 5""",
        POOL,
    ),
)
def _(spark, sf):
    rows, places = bearing(spark, sf), places_v(spark, sf)
    return flat_map(details(rows, ranked_places(rows, places, 5, "score"), places))


@query("w3_evidence", with_views("SELECT qid, place_id, review_id, score, n FROM picked", QUOTES))
def _(spark, sf):
    rows = bearing(spark, sf)
    return ranking.evidence(ranking.of_places(rows, ranked_places(rows, places_v(spark, sf))))


@query(
    "f6_filled_evidence",
    with_views("SELECT qid, place_id, review_id, n FROM picked WHERE tier = 1", QUOTES),
)
def _(spark, sf):
    # only places with exact hits have quotes without a text score
    rows = bearing(spark, sf)
    best = ranked_places(rows, places_v(spark, sf))
    picked = ranking.evidence(ranking.of_places(rows, best))
    return picked.filter(F.col("score") == 0).select("qid", "place_id", "review_id", "n")


_FLAT = """SELECT b.qid, b.rank, b.place_id, b.name, b.address, b.rating, b.review_count, b.maps_url, b.exact_hits,
                  b.exact_reviews, b.variant_hits, b.bm25_top, b.score, q.n, q.review_id, q.rating AS review_rating,
                  q.date, q.reviewer, q.score AS review_score, q.text, q.snippet
           FROM best b LEFT JOIN quotes q ON b.qid = q.qid AND b.place_id = q.place_id"""


def flat(ranked: DataFrame) -> DataFrame:
    """Recommendations with one row per quote."""
    opened = flat_map(ranked).select("*", F.explode_outer("snippets").alias("quote"))
    renamed = {"rating": "review_rating", "score": "review_score"}
    fields = ["n", "review_id", "rating", "date", "reviewer", "score", "text", "snippet"]
    return opened.select(
        *[c for c in ranked.columns if c not in ("query", "variants", "snippets")],
        *[F.col(f"quote.{c}").alias(renamed.get(c, c)) for c in fields],
    )


@query("q4_recommend", with_views(_FLAT, QUOTES))
def _(spark, sf):
    return flat(recommend(*stored(spark, sf), saved_index(spark, sf), asked_queries(spark)))


@query("q4_recommend_by_index", with_views(_FLAT, QUOTES))
def _(spark, sf):
    ranked = recommend(
        *stored(spark, sf), saved_index(spark, sf), asked_queries(spark), match="index"
    )
    return flat(ranked)


@query("q4_recommend_from_store", with_views(_FLAT, QUOTES))
def _(spark, sf):
    store = TableStore(spark, new_path(spark, "store"))
    reviews, places = stored(spark, sf)
    store.commit("reviews", reviews)
    store.commit("places", places)
    ranked = recommend(
        store.read("reviews"), store.read("places"), saved_index(spark, sf), asked_queries(spark)
    )
    return flat(ranked)


@query(
    "q4_recommend_exact_only",
    with_views(
        """SELECT qid, rank, place_id, name, exact_hits, variant_hits FROM (
             SELECT h.qid, h.place_id, coalesce(nullif(coalesce(p.name, h.place_name), ''), '?') AS name, exact_hits, variant_hits,
                    row_number() OVER (PARTITION BY h.qid ORDER BY exact_hits DESC, coalesce(p.rating, 0) DESC, h.place_id) AS rank
             FROM place_hits h LEFT JOIN places_v p ON h.place_id = p.place_id) WHERE rank <= 10""",
        MATCHES,
    ),
)
def _(spark, sf):
    ranked = recommend(*stored(spark, sf), None, asked_queries(spark))
    return flat_map(ranked).select("qid", "rank", "place_id", "name", "exact_hits", "variant_hits")


@query(
    "q4_recommend_display",
    with_views(
        """SELECT qid, rank, name AS place, exact_hits, printf('%.2f', bm25_top) AS bm25_top,
                  CASE WHEN rating <> 0 THEN printf('%.1f', rating) ELSE '—' END AS rating,
                  CASE WHEN review_count <> 0 THEN cast(review_count AS varchar) ELSE '—' END AS reviews, mentions
           FROM best LEFT JOIN (SELECT qid, place_id, string_agg(variant || '×' || hits, ', ' ORDER BY hits DESC, variant) AS mentions
                      FROM variant_hits GROUP BY ALL) m USING (qid, place_id)""",
        BEST,
    ),
)
def _(spark, sf):
    ranked = recommend(*stored(spark, sf), saved_index(spark, sf), asked_queries(spark))
    shown = recommend_display(ranked)
    return shown.withColumn("mentions", F.nullif("mentions", F.lit("")))


@query(
    "q4_quotes_display",
    with_views(
        """SELECT qid, place_id, n, snippet, concat_ws(' · ', rating || '/5', nullif(date, ''), reviewer,
                  CASE WHEN score <> 0 THEN 'bm25 ' || printf('%.2f', score) END) AS meta FROM quotes""",
        QUOTES,
    ),
)
def _(spark, sf):
    reviews, places = stored(spark, sf)
    rows = bearing(spark, sf)
    told = quotes(rows, ranked_places(rows, places), reviews, asked_variants(spark))
    return quotes_display(told)


@query(
    "a5_table_counts",
    with_views(
        """SELECT 'places' AS table_name, count(*) AS rows FROM places_v
           UNION ALL SELECT 'reviews', count(*) FROM reviews_v"""
    ),
)
def _(spark, sf):
    return table_counts(places_v(spark, sf), reviews_v(spark, sf))


@query("q5_status", with_views("SELECT 'places' AS table_name, count(*) AS rows FROM places_v UNION ALL SELECT 'reviews', count(*) FROM reviews_v"))
def _(spark, sf):
    store = TableStore(spark, new_path(spark, "store"))
    reviews, places = stored(spark, sf)
    return table_counts(store.commit("places", places), store.commit("reviews", reviews))


@query("w5_listed_places", with_views("SELECT * FROM places_v ORDER BY name, place_id"))
def _(spark, sf):
    return listed_places(places_v(spark, sf))


@query(
    "f7_lookup_by_key",
    with_views(
        """SELECT b.item_id, r.review_id, r.text FROM reviews_v r JOIN benchmark b ON r.review_id = cast(b.item_id AS varchar)"""
    ),
)
def _(spark, sf):
    store = TableStore(spark, new_path(spark, "store"), shards=16)
    reviews = store.commit("reviews", conform(reviews_v(spark, sf), REVIEWS))
    wanted = table(spark, sf, "benchmark").select("item_id", F.col("item_id").cast("string").alias("review_id"))
    return keyed_join(wanted, reviews, "review_id").select("item_id", "review_id", "text")


_MENTIONS = with_views(
    """SELECT place_name, count(*) AS hits FROM reviews_v
       WHERE lower(text) LIKE '%of the%' OR lower(text) LIKE '%ofthe%' GROUP BY place_name ORDER BY hits DESC, place_name"""
)


@query("a8_mentions_by_name", _MENTIONS)
def _(spark, sf):
    return exact.mentions_by_name(reviews_v(spark, sf), ["of the", "ofthe"])


@query("q10_mentions_sql", _MENTIONS)
def _(spark, sf):
    register_views(places_v(spark, sf), reviews_v(spark, sf))
    return spark.sql(
        """SELECT place_name, count(*) AS hits FROM reviews
           WHERE lower(text) LIKE '%of the%' OR lower(text) LIKE '%ofthe%'
           GROUP BY place_name ORDER BY hits DESC, place_name"""
    )

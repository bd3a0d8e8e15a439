"""The text index, search, and exact hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from suite import query
from suite.texts import CORPUS
from suite.views import places_v, reviews_v, table, with_views
from vouch.operators import bm25, exact, ranking
from vouch.operators.corpus import export_corpus
from vouch.operators.phrase_index import touched_by_index
from vouch.operators.queries import query_table, with_variants
from vouch.plans.indexing import append_reviews, build_index, index_reviews, index_stats
from vouch.plans.recommend import touched
from vouch.plans.search import search, search_display
from vouch.session import materialize, new_path
from vouch.sources.tables import TableStore, keyed_join

ASKED = [("Of  the", ["in the"]), "that is", ("para la", ["de la", "la de la"])]

_indexes: dict[tuple[str, str], bm25.Index] = {}


def asked_queries(spark: SparkSession) -> DataFrame:
    return query_table(spark, ASKED)


def saved_index(spark: SparkSession, sf: str) -> bm25.Index:
    """The index of all reviews, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = index_reviews(reviews_v(spark, sf), new_path(spark, "index"))
    return _indexes[key]


TOKENS = r"regexp_extract_all(lower(contents), '[\p{L}\p{N}]+')"

INDEX = f"""
{CORPUS},
docs AS (SELECT id AS doc_id, len({TOKENS}) AS dl FROM corpus),
postings AS (
  SELECT term, doc_id, count(*) AS tf FROM (SELECT id AS doc_id, unnest({TOKENS}) AS term FROM corpus) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM docs)"""

ASKED_SQL = """
asked AS (
  SELECT * FROM (VALUES
    (0, 'Of  the', ['in the', 'in-the', 'inthe', 'of the', 'of-the', 'ofthe']),
    (1, 'that is', ['that is', 'that-is', 'thatis']),
    (2, 'para la', ['de la', 'de-la', 'dela', 'la de la', 'la-de-la', 'ladela', 'para la', 'para-la', 'parala'])
  ) v(qid, query, variants)),
query_terms AS (
  SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM asked)"""

SCORES = f"""
{INDEX},
{ASKED_SQL},
scores AS (
  SELECT qid, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
           / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM query_terms JOIN postings USING (term) JOIN terms USING (term) JOIN docs USING (doc_id), stats
  GROUP BY qid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores)"""


@query("snk3_corpus_export", with_views("SELECT * FROM corpus", CORPUS))
def _(spark, sf):
    path = new_path(spark, "corpus")
    export_corpus(reviews_v(spark, sf), path)
    return spark.read.schema("id string, contents string").json(path)


@query(
    "snk4_index_sizes",
    with_views(
        """SELECT (SELECT count(*) FROM postings) AS postings, (SELECT count(*) FROM terms) AS terms,
                  (SELECT sum(tf) FROM postings) AS tokens, (SELECT count(*) FROM docs) AS docs""",
        INDEX,
    ),
)
def _(spark, sf):
    index = saved_index(spark, sf)
    words = index.postings.filter(F.col("term") != "")
    return (
        words.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
        .withColumn("terms", index.terms.agg(F.count("*")).scalar())
        .withColumn("docs", index.docs.agg(F.count("*")).scalar())
    )


@query("b4_postings", with_views("SELECT term, doc_id, tf, dl FROM postings JOIN docs USING (doc_id)", INDEX))
def _(spark, sf):
    postings = build_index(reviews_v(spark, sf)).postings
    return postings.filter(F.col("term") != "")


@query("b5_document_frequency", with_views("SELECT * FROM terms", INDEX))
def _(spark, sf):
    return saved_index(spark, sf).terms


@query("b6_corpus_stats", with_views("SELECT * FROM stats", INDEX))
def _(spark, sf):
    return saved_index(spark, sf).stats


@query(
    "b3_vocabulary",
    with_views(
        """SELECT CASE WHEN length(term) > 6 THEN substr(term, 1, 6) ELSE term END AS term, doc_id, sum(tf) AS tf
           FROM postings GROUP BY 1, 2""",
        INDEX,
    ),
)
def _(spark, sf):
    # long words by their first letters, over the distinct words of the corpus
    words = saved_index(spark, sf).terms.select("term").filter(F.length("term") > 6)
    vocab = words.withColumn("canonical", F.substring("term", 1, 6))
    index = build_index(reviews_v(spark, sf), vocab=vocab)
    return index.postings.filter(F.col("term") != "").select("term", "doc_id", "tf")


@query(
    "j8_matched_postings",
    with_views(
        "SELECT qid, term, doc_id, tf FROM query_terms JOIN postings USING (term)", INDEX, ASKED_SQL
    ),
)
def _(spark, sf):
    terms = bm25.query_terms(asked_queries(spark))
    return saved_index(spark, sf).postings.join(terms, "term").select("qid", "term", "doc_id", "tf")


@query("b7_scores", with_views("SELECT * FROM scores", SCORES))
def _(spark, sf):
    return bm25.scores(saved_index(spark, sf), asked_queries(spark))


@query("w1_top_hits", with_views("SELECT * FROM ranked WHERE rank <= 50", SCORES))
def _(spark, sf):
    return bm25.top_hits(saved_index(spark, sf), asked_queries(spark), 50)


@query(
    "b8_top_hits_per_part",
    r"""WITH docs AS (SELECT cast(doc_id AS varchar) AS doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dl FROM documents
                      WHERE length(text) > 0),
        postings AS (SELECT doc_id, term, count(*) AS tf FROM (
          SELECT cast(doc_id AS varchar) AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL),
        terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
        stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM docs),
        asked AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
        scores AS (SELECT qid, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
                     / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
                   FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN docs USING (doc_id), stats GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10""",
)
def _(spark, sf):
    # many long queries at once: every benchmark item is searched for in all documents
    documents = table(spark, sf, "documents").filter(F.length("text") > 0)
    index = bm25.save(
        bm25.build(documents.select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))),
        new_path(spark, "index"),
    )
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return bm25.top_hits(index, items, 10)


@query(
    "a7_index_stats",
    with_views(
        "SELECT (SELECT count(*) FROM corpus) AS corpus_docs, (SELECT n_docs FROM stats) AS indexed_docs", INDEX
    ),
)
def _(spark, sf):
    return index_stats(reviews_v(spark, sf), saved_index(spark, sf))


@query(
    "j1_hit_reviews",
    with_views(
        """SELECT h.qid, h.rank, h.doc_id AS review_id, h.score, r.text, r.rating
           FROM ranked h JOIN reviews_v r ON h.doc_id = r.review_id
           WHERE h.rank <= 10 AND r.rating IS NOT NULL""",
        SCORES,
    ),
)
def _(spark, sf):
    # only labelled reviews are stored, so that hits on others drop out
    stored = reviews_v(spark, sf).filter(F.col("rating").isNotNull())
    hits = bm25.top_hits(saved_index(spark, sf), asked_queries(spark), 10)
    found = hits.withColumnRenamed("doc_id", "review_id")
    return keyed_join(found, stored.drop("doc_id"), "review_id").select(
        "qid", "rank", "review_id", "score", "text", "rating"
    )


@query(
    "j2_review_places",
    with_views(
        """SELECT doc_id, r.place_id, p.name, p.address, p.maps_url, p.rating AS place_rating
           FROM reviews_v r LEFT JOIN places_v p ON r.place_id = p.place_id"""
    ),
)
def _(spark, sf):
    places = places_v(spark, sf).select(
        "place_id", "name", "address", "maps_url", F.col("rating").alias("place_rating")
    )
    return reviews_v(spark, sf).select("doc_id", "place_id").join(places, "place_id", "left")


SEARCH_SQL = """
found AS (
  SELECT h.qid, h.rank, h.doc_id AS review_id, h.score, r.text AS review_text, r.rating AS review_rating,
         r.published_date AS review_date, r.reviewer_name, p.name AS place_name, p.address AS place_address,
         p.maps_url AS place_maps_url, p.rating AS place_rating
  FROM ranked h JOIN reviews_v r ON h.doc_id = r.review_id LEFT JOIN places_v p ON r.place_id = p.place_id
  WHERE h.rank <= 10)"""


@query("q3_search", with_views("SELECT * FROM found", SCORES, SEARCH_SQL))
def _(spark, sf):
    return search(
        saved_index(spark, sf), reviews_v(spark, sf).drop("doc_id"), places_v(spark, sf), asked_queries(spark)
    )


@query(
    "q3_search_display",
    with_views(
        """SELECT qid, rank, printf('%.3f', score) AS score, coalesce(place_name, '?') AS place,
                  CASE WHEN review_rating <> 0 THEN review_rating || '/5' ELSE '—' END AS rating,
                  replace(substr(review_text, 1, 200), chr(10), ' ') || CASE WHEN length(review_text) > 200 THEN '…' ELSE '' END AS preview,
                  concat_ws(' · ', review_rating || '/5', nullif(review_date, ''), reviewer_name) AS meta
           FROM found""",
        SCORES,
        SEARCH_SQL,
    ),
)
def _(spark, sf):
    found = search(
        saved_index(spark, sf), reviews_v(spark, sf).drop("doc_id"), places_v(spark, sf), asked_queries(spark)
    )
    return search_display(found)


@query("q2_index_from_parts", with_views("SELECT term, df FROM terms", INDEX))
def _(spark, sf):
    # the whole path: clean reviews, corpus, postings, written index, reloaded
    path = new_path(spark, "index")
    index_reviews(reviews_v(spark, sf), path)
    return bm25.load(spark, path).terms


@query(
    "q2_index_appended",
    with_views(
        """SELECT term, doc_id, tf, dl, df, n_docs, avgdl
           FROM postings JOIN docs USING (doc_id) JOIN terms USING (term), stats""",
        INDEX,
    ),
)
def _(spark, sf):
    # three segments: half of the reviews, some in an older form; the older ones replaced and more added; one more part
    now, path, doc = reviews_v(spark, sf), new_path(spark, "index"), F.col("doc_id")
    older = now.withColumn("text", F.when(doc % 6 == 0, F.concat("text", F.lit(" old words"))).otherwise(F.reverse("text")))
    index_reviews(older.filter(doc % 2 == 0).drop("doc_id"), path)
    append_reviews(spark, materialize(now.filter((doc % 2 == 0) | (doc % 3 == 0)).drop("doc_id"), "more"), path)
    index = append_reviews(spark, materialize(now.filter((doc % 3 != 0)).drop("doc_id"), "rest"), path)
    return bm25.with_df(index).crossJoin(F.broadcast(index.stats))


@query("b8_pruned_hits", with_views("SELECT * FROM ranked WHERE rank <= 50", SCORES))
def _(spark, sf):
    return bm25.top_hits(saved_index(spark, sf), asked_queries(spark), 50, prune_postings=0)


MATCHES = f"""
{ASKED_SQL},
matches AS (
  SELECT qid, r.place_id, r.place_name, r.review_id, substr(r.text, 1, 120) AS copy_key,
         list_filter(variants, lambda v: contains(lower(r.text), v)) AS found
  FROM reviews_v r, asked
  WHERE len(list_filter(variants, lambda v: contains(lower(r.text), v))) > 0),
variant_hits AS (
  SELECT qid, place_id, variant, count(*) AS hits, sum(first) AS reviews, min(place_name) AS place_name FROM (
    SELECT qid, place_id, place_name, found[i] AS variant, CASE WHEN i = 1 THEN 1 ELSE 0 END AS first
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matches))
  GROUP BY qid, place_id, variant),
place_hits AS (
  SELECT qid, place_id, sum(hits) AS exact_hits, sum(reviews) AS exact_reviews,
         string_agg(variant || '=' || hits, ',' ORDER BY variant) AS variant_hits, min(place_name) AS place_name
  FROM variant_hits GROUP BY qid, place_id)"""


def asked_variants(spark: SparkSession) -> DataFrame:
    return with_variants(asked_queries(spark))


@query("j7_matching_reviews", with_views("SELECT * FROM matches", MATCHES))
def _(spark, sf):
    rows = exact.touched_reviews(reviews_v(spark, sf), asked_variants(spark))
    return rows.drop("score")


@query("j7_matching_by_index", with_views("SELECT * FROM matches", MATCHES))
def _(spark, sf):
    rows = touched_by_index(
        saved_index(spark, sf), reviews_v(spark, sf).drop("doc_id"), asked_variants(spark)
    )
    return rows.drop("score")


@query("j7_matching_after_update", with_views("SELECT * FROM matches", MATCHES))
def _(spark, sf):
    # a third of the reviews is replaced after the index was built: hits follow the stored text
    store, now = TableStore(spark, new_path(spark, "store")), reviews_v(spark, sf)
    changed = F.col("doc_id") % 3 == 0
    before = now.withColumn("text", F.when(changed, F.reverse("text")).otherwise(F.col("text")))
    store.commit("reviews", before.drop("doc_id"))
    older = index_reviews(store.read("reviews"), new_path(spark, "index"))
    store.upsert("reviews", materialize(now.filter(changed).drop("doc_id"), "changed"))
    rows = touched(store.read("reviews"), asked_variants(spark), older, match="index")
    return rows.filter(F.size("found") > 0).drop("score")


def asked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every benchmark item as a phrase, one query per item."""
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.lit("").alias("query"),
        F.split("text", "[.,]").alias("synonyms"),
    )
    return with_variants(items)


@query(
    "j7_matching_many_phrases",
    r"""WITH parts AS (
          SELECT DISTINCT item_id AS qid, trim(regexp_replace(lower(unnest(string_split_regex(text, '[.,]'))), '\s+', ' ', 'g')) AS phrase
          FROM benchmark),
        forms AS (
          SELECT DISTINCT qid, unnest([phrase, replace(phrase, ' ', '-'), replace(phrase, ' ', '')]) AS variant
          FROM parts WHERE phrase <> '')
        SELECT qid, cast(doc_id AS varchar) AS review_id, cast(doc_id % 120 AS varchar) AS place_id,
               'Place ' || cast(doc_id % 120 AS varchar) AS place_name, substr(text, 1, 120) AS copy_key,
               list_sort(list(variant)) AS found
        FROM documents JOIN forms ON contains(lower(text), variant) GROUP BY ALL""",
)
def _(spark, sf):
    return touched(reviews_v(spark, sf).drop("doc_id"), asked_items(spark, sf), None).drop("score")


def hits_per_variant(spark: SparkSession, sf: str) -> DataFrame:
    return exact.variant_hits(exact.touched_reviews(reviews_v(spark, sf), asked_variants(spark)))


@query("a1_variant_hits", with_views("SELECT * FROM variant_hits", MATCHES))
def _(spark, sf):
    return hits_per_variant(spark, sf)


def flat_map(df: DataFrame) -> DataFrame:
    """The hit map as text, so that it can be compared."""
    entries = F.array_sort(
        F.transform(
            F.map_entries("variant_hits"),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        )
    )
    return df.withColumn("variant_hits", F.array_join(entries, ","))


@query("a2_place_hits", with_views("SELECT * FROM place_hits", MATCHES))
def _(spark, sf):
    return flat_map(exact.place_hits(hits_per_variant(spark, sf)))


@query(
    "j3_hit_place_names",
    with_views(
        """SELECT qid, h.place_id, exact_hits, exact_reviews, coalesce(p.name, place_name) AS name
           FROM place_hits h LEFT JOIN places_v p ON h.place_id = p.place_id""",
        MATCHES,
    ),
)
def _(spark, sf):
    hits = exact.place_hits(hits_per_variant(spark, sf))
    return exact.with_place_name(hits, places_v(spark, sf)).drop("variant_hits")


_LOCATED = """
located AS (
  SELECT h.qid, r.place_id, r.place_name, r.review_id, substr(r.text, 1, 120) AS copy_key, h.score
  FROM ranked h JOIN reviews_v r ON h.doc_id = r.review_id WHERE h.rank <= 50)"""


@query("j6_located_hits", with_views("SELECT * FROM located", SCORES, _LOCATED))
def _(spark, sf):
    hits = bm25.top_hits(saved_index(spark, sf), asked_queries(spark), 50)
    found = hits.withColumnRenamed("doc_id", "review_id")
    return ranking.located_hits(found, reviews_v(spark, sf).drop("doc_id")).drop("found")


@query(
    "a3_best_score",
    with_views(
        "SELECT qid, place_id, max(score) AS bm25_top FROM located WHERE score > 0 GROUP BY ALL", SCORES, _LOCATED
    ),
)
def _(spark, sf):
    rows = touched(
        reviews_v(spark, sf).drop("doc_id"), asked_variants(spark), saved_index(spark, sf)
    )
    return ranking.best_score(rows)


@query(
    "f5_positive_scores",
    with_views("SELECT qid, review_id, score FROM located WHERE score > 0", SCORES, _LOCATED),
)
def _(spark, sf):
    rows = touched(
        reviews_v(spark, sf).drop("doc_id"), asked_variants(spark), saved_index(spark, sf)
    )
    return rows.filter(F.col("score") > 0).select("qid", "review_id", "score")


@query(
    "a4_hits_by_place",
    with_views(
        """SELECT qid, place_id, string_agg(review_id, ',' ORDER BY score DESC, review_id) AS reviews
           FROM located GROUP BY ALL""",
        SCORES,
        _LOCATED,
    ),
)
def _(spark, sf):
    rows = touched(
        reviews_v(spark, sf).drop("doc_id"), asked_variants(spark), saved_index(spark, sf)
    )
    return ranking.hits_by_place(rows).select("qid", "place_id", F.array_join("review_ids", ",").alias("reviews"))


@query(
    "b7_many_words",
    with_views(
        """SELECT qid, doc_id, score, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
               SELECT length(term) % 4 AS qid, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
                        / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
               FROM postings JOIN terms USING (term) JOIN docs USING (doc_id), stats GROUP BY ALL))
           WHERE rank <= 20""",
        INDEX,
    ),
)
def _(spark, sf):
    # every word of the corpus is a query word, too many for the scan filter
    index = saved_index(spark, sf)
    words = index.terms.select((F.length("term") % 4).alias("qid"), F.col("term").alias("query"))
    return bm25.top_hits(index, words, 20)

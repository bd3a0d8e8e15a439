"""Registered queries of the operators, each over its whole table, next to the SQL that checks it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouch.llm.ann import approximate_top_k
from vouch.llm.impact_search import exact_top_k
from vouch.llm.lexical import rank_documents
from vouch.llm.licences import NOTICES, PHRASES, RARE, SHARE, scan_licences
from vouch.llm.mixing import copies, document_rates
from vouch.llm.near_dup import near_duplicates
from vouch.llm.runs import periodic_runs, repeat_words
from vouch.llm.sentencepiece import encode, load_model
from vouch.llm.sharding import balanced_shards
from vouch.llm.spans import remove_repeated_spans
from vouch.llm.toxicity import score, train
from vouch.llm.url_filter import judge_urls
from vouch.llm.warc import plan_records, read_archives, write_archives
from vouch.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 2: SentencePiece -------------------------------------------------------------------

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def piece_model(spark: SparkSession, name: str = "piece_bpe_32k.model"):
    return load_model(spark, f"file://{TOKENIZERS}/{name}")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, model, check_col="round_trip")
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")


# --- 3: near duplicates -------------------------------------------------------------

_NEAR_DUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.seen = l.x)
SELECT s.doc_id, len(s.s)::bigint AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT doc_id, min(seen) AS c FROM reach GROUP BY 1) r USING (doc_id)"""


@query("op3_minhash_near_dedup", _NEAR_DUP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


# --- 4: substring dedup ---------------------------------------------------------------


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_spans(docs, counts=True)


# --- 8: toxicity ----------------------------------------------------------------------


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


# --- 9: mixing ------------------------------------------------------------------------


def label_domains(labels: DataFrame) -> DataFrame:
    """``id, domain``: good or poor by the label of quality."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain"))


MIX = {"good": 0.9, "poor": 0.1}


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_domains(table(spark, sf_dir, "labels"))
    return document_rates(table(spark, sf_dir, "documents"), labels, MIX).withColumn(
        "copies", copies(F.col("rate"), F.col("doc_id"))
    )


# --- 5: sharding ----------------------------------------------------------------------


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 6: URL filter --------------------------------------------------------------------

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _level_sql(k: int) -> str:
    """One level of the template tree, as named queries."""
    node = ", ".join(["host", *[f"m{i}" for i in range(k)]])
    bound = "sqrt(ln(2 / 0.05::double) / 2)"
    return f"""
b{k} AS (SELECT {node}, s{k}, sum(n) AS n, sum(bad) AS bad FROM t{k} GROUP BY {node}, s{k}),
n{k} AS (SELECT {node}, sum(n) AS all_n, sum(bad) AS all_bad FROM b{k} GROUP BY {node}),
c{k} AS (
  SELECT {node}, s{k}, CASE WHEN n = 0 OR
      abs(bad / greatest(n, 1)::double - all_bad / greatest(all_n, 1)::double)
      <= {bound} * (1 / sqrt(greatest(n, 1)::double) + 1 / sqrt(greatest(all_n, 1)::double))
    THEN -1 ELSE least(floor(10 * bad / greatest(n, 1)::double), 9)::int END AS tenth
  FROM b{k} JOIN n{k} USING ({node})),
t{k + 1} AS (
  SELECT t{k}.*, CASE WHEN tenth < 0 THEN '*' WHEN mates = 1 THEN s{k} ELSE '*' || tenth END AS m{k}
  FROM t{k} JOIN (SELECT *, count(*) OVER (PARTITION BY {node}, tenth) AS mates FROM c{k}) USING ({node}, s{k}))"""


_URL_SQL = f"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, string_split(regexp_replace(substr(path, 2), '[0-9]+', '<n>', 'g'), '/') AS p FROM u),
w AS (
  SELECT page_id, host, path, l.bad, p[1] AS s0, coalesce(p[2], '<end>') AS s1, coalesce(p[3], '<end>') AS s2,
    CASE WHEN len(p) < 4 THEN '<end>' ELSE array_to_string(p[4:], '/') END AS s3
  FROM v LEFT JOIN l ON page_id = doc_id),
t0 AS (SELECT host, s0, s1, s2, s3, count(*) AS rows, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM w GROUP BY ALL),
{",".join(_level_sql(k) for k in range(4))},
g AS (SELECT coalesce(sum(bad), 0) / greatest(sum(n), 1)::double AS share FROM t4),
q AS (
  SELECT host, m0, m1, m2, m3, (sum(bad) + 8.0::double * any_value(share)) / (sum(n) + 8.0::double) AS purity
  FROM t4, g GROUP BY host, m0, m1, m2, m3),
f AS (
  SELECT page_id, w.host, path, m0 || '/' || m1 || '/' || m2 || '/' || m3 AS template, purity,
    CASE WHEN (w.host = 'example.net' OR w.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (w.host = 'example.com' OR w.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (w.host = 'org' OR w.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (w.host = 'net' OR w.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM w JOIN t4 USING (host, s0, s1, s2, s3) JOIN q USING (host, m0, m1, m2, m3))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, template
FROM f"""


@query("op6_url_filter", _URL_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents stand for the pages of the same number: poor or toxic ones are bad."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    judged = judge_urls(
        table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("id"), bad.alias("bad")), RULES
    )
    return judged.drop("purity")


# --- 10: WARC -------------------------------------------------------------------------


# five hex digits of the hash make four base32 letters
_WARC_SQL = """WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
parts AS (
  SELECT *, list_transform(range(32), lambda i: cast('0x' || substr(hex, cast(i // 4 * 5 + 1 AS int), 5) AS int) // cast(power(32, 3 - i % 4) AS int) % 32) AS codes
  FROM sized)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(codes, lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(c + 1 AS int), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM parts"""


@query("op10_warc", _WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = plan_records(table(spark, sf_dir, "pages"))
    archives = write_archives(records, new_path(spark, "warc"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return read_archives(archives).select(
        number("record_id").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


# --- 1: exact top-k search ------------------------------------------------------------

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""


@query("op1_exact_top_k", _TOP_K_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


# --- 7: approximate nearest neighbours ----------------------------------------------------


@query("op7_nearest_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


# --- 11: licence scans ------------------------------------------------------------------

_NOTICE_ROWS = ", ".join(f"({i}, '{label}', '{words}', '{key}')" for i, (label, words, key) in enumerate(NOTICES))
_PHRASE_ROWS = ", ".join(f"('{words}', '{label}')" for words, label in PHRASES)
_LICENCE_SQL = rf"""
WITH notices(notice, label, words, key) AS (VALUES {_NOTICE_ROWS}),
phrases(phrase, label) AS (VALUES {_PHRASE_ROWS}),
docs AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
places AS (SELECT notice, unnest(string_split(words, ' ')) AS word, unnest(range(len(string_split(words, ' ')))) AS p FROM notices),
df AS (SELECT word, count(DISTINCT id) AS df FROM occ GROUP BY 1),
idf AS (
  SELECT word, coalesce(df, 0) AS df, ln(((SELECT count(*) FROM docs) + 1) / (coalesce(df, 0) + 1)::double) AS idf
  FROM (SELECT DISTINCT word FROM places) LEFT JOIN df USING (word)),
rare AS (
  SELECT notice, word, idf FROM (SELECT DISTINCT notice, word FROM places) JOIN idf USING (word)
  QUALIFY row_number() OVER (PARTITION BY notice ORDER BY df, word) <= {RARE}),
postings AS (SELECT notice, word, p, idf FROM places JOIN rare USING (notice, word)),
laid AS (
  SELECT id, notice, i - p AS o, sum(idf) AS met FROM occ JOIN postings USING (word) GROUP BY ALL),
total AS (SELECT notice, greatest(sum(idf), 1e-9) AS total FROM postings GROUP BY 1),
near AS (
  SELECT id, notice, o, round(met / total, 6) AS met FROM laid JOIN total USING (notice) WHERE round(met / total, 6) >= {SHARE}),
sure AS (
  SELECT id, list(DISTINCT label) AS more, max(met) AS best
  FROM near JOIN notices USING (notice) JOIN docs USING (id)
  WHERE o + len(string_split(split_part(' ' || words || ' ', ' ' || key || ' ', 1), ' ')) >= 1
    AND array_to_string(w[o + len(string_split(split_part(' ' || words || ' ', ' ' || key || ' ', 1), ' ')) :
        o + len(string_split(split_part(' ' || words || ' ', ' ' || key || ' ', 1), ' ')) + len(string_split(key, ' ')) - 1], ' ') = key
  GROUP BY id),
base AS (
  SELECT id, label, i FROM docs, phrases, unnest(range(len(w))) AS u(i)
  WHERE array_to_string(w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
based AS (SELECT id, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM base GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_base, first AS first_word, last AS last_word,
  coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(labels, []) || coalesce(more, []))), ','), '') AS labels,
  (CASE WHEN n > 0 THEN 1 ELSE least(1, coalesce(best, 0)) END)::double AS score
FROM docs LEFT JOIN based USING (id) LEFT JOIN sure USING (id)"""


@query("op11_licence_scan", _LICENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


# --- 12: ranked lexical search --------------------------------------------------------------

_LEXICAL_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::bigint AS n_terms FROM d),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::double))::bigint AS w FROM p, s GROUP BY term, n_docs),
x AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(w) * n_docs) // n_terms)) AS x
  FROM p JOIN d USING (r), s),
scores AS (SELECT item_id, r, doc_id, sum(c * t.w * x)::bigint AS score FROM q JOIN t USING (term) JOIN x USING (term)
  WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::int AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""


@query("op12_lexical_search", _LEXICAL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


# --- 13: periodic runs ----------------------------------------------------------------------


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=repeat_words)

"""Listings found, matched and stored, and reviews out of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from suite import query
from suite.texts import PAGE_LINK, page_link
from suite.views import STAMP, WS, table
from vouch.functions.ids import slug_id, url_place_id
from vouch.operators.blocks import ELEMENTS, NAME, NO_NESTING, PIECE, element_blocks
from vouch.operators.extract import (
    assemble_reviews,
    block_fields,
    cap_reviews,
    first_per_selector,
    page_candidates,
)
from vouch.operators.listings import first_listings, match_listings
from vouch.operators.upsert import latest, not_stored
from vouch.plans.discover import (
    discover_incremental,
    discovery_stats,
    extract_reviews,
    new_places,
    search_phrases,
)
from vouch.schemas import PLACES, conform

H1 = "<h1>([^<]*)</h1>"

# Listings: every page is listed twice under its language, the second time with another
# label; links take the three forms of page_link.
LISTINGS = rf"""
titled AS (
  SELECT page_id, url, html, regexp_extract(url, '/([a-z][a-z])/', 1) AS query_id,
         regexp_extract(html, '{H1}', 1) AS title, {PAGE_LINK} AS link FROM pages),
listings AS (
  SELECT query_id, page_id * 2 AS pos, title || ' 4.5 stars, open' AS label, link AS href FROM titled
  UNION ALL SELECT query_id, page_id * 2 + 1, 'Again ' || title, ' ' || link FROM titled),
wanted AS (
  SELECT query_id, CASE WHEN page_id % 3 = 1 THEN 'ChIJ' || lower(to_hex(page_id)) ELSE 'none:' || page_id END AS place_id,
         CASE WHEN page_id % 3 = 2 THEN title ELSE 'Nobody ' || page_id END AS name,
         CASE WHEN page_id % 3 = 0 THEN link || '/?hl=en' ELSE '' END AS maps_url FROM titled)"""


def titled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("query_id"),
        F.regexp_extract("html", H1, 1).alias("title"),
        page_link(F.col("page_id"), F.col("url")).alias("link"),
    )


def listings_v(spark: SparkSession, sf: str) -> DataFrame:
    pages, pos = titled(spark, sf), F.col("page_id") * 2
    first = pages.select(
        "query_id",
        pos.alias("pos"),
        F.concat("title", F.lit(" 4.5 stars, open")).alias("label"),
        F.col("link").alias("href"),
    )
    again = pages.select(
        "query_id",
        (pos + 1).alias("pos"),
        F.concat(F.lit("Again "), "title").alias("label"),
        F.concat(F.lit(" "), "link").alias("href"),
    )
    return first.unionByName(again)


def targets_v(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id")
    return titled(spark, sf).select(
        "query_id",
        F.when(page % 3 == 1, F.concat(F.lit("ChIJ"), F.lower(F.hex(page))))
        .otherwise(F.concat(F.lit("none:"), page))
        .alias("place_id"),
        F.when(page % 3 == 2, F.col("title"))
        .otherwise(F.concat(F.lit("Nobody "), page))
        .alias("name"),
        F.when(page % 3 == 0, F.concat("link", F.lit("/?hl=en"))).otherwise("").alias("maps_url"),
    )


_MATCHED = """
pairs AS (
  SELECT w.query_id, w.place_id, l.pos, l.label, l.href,
         trim(l.href) AS link, regexp_replace(lower(w.name), '[^a-z0-9]', '', 'g') AS nk,
         regexp_replace(lower(string_split(l.label, ',')[1]), '[^a-z0-9]', '', 'g') AS lk,
         rtrim(string_split(w.maps_url, '?')[1], '/') AS base
  FROM wanted w JOIN listings l ON w.query_id = l.query_id),
scored AS (
  SELECT *, CASE WHEN base <> '' AND rtrim(string_split(link, '?')[1], '/') = base THEN 0
                 WHEN contains(link, place_id) THEN 0
                 WHEN overlap > 0 THEN 1 ELSE 2 END AS tier
  FROM (SELECT *, CASE WHEN nk = '' OR lk = '' THEN 0 ELSE coalesce(list_max(list_filter([12, 10, 8], lambda s:
          s <= least(length(nk), length(lk)) AND (contains(lk, substr(nk, 1, s)) OR contains(nk, substr(lk, 1, s))))), 0) END AS overlap
        FROM pairs)),
matched AS (
  SELECT query_id, pos, place_id, tier, CASE WHEN tier = 1 THEN overlap ELSE 0 END AS overlap, label, href
  FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, place_id
    ORDER BY tier, CASE WHEN tier = 1 THEN -overlap ELSE 0 END, pos) = 1)"""


@query("j10_match_listings", f"WITH {LISTINGS}, {_MATCHED} SELECT * FROM matched")
def _(spark, sf):
    return match_listings(targets_v(spark, sf), listings_v(spark, sf))


@query(
    "q8_matched_phrases",
    f"""WITH {LISTINGS}, {_MATCHED}
        SELECT m.place_id, m.href, m.tier,
               array_to_string(list_slice(regexp_split_to_array(trim(string_split(trim(string_split(trim(string_split(trim(string_split(trim(
                 w.name, {WS}), '·')[1], {WS}), ' • ')[1], {WS}), ' | ')[1], {WS}), ' - ')[1], {WS}), '\\s+'), 1, 3), ' ') || ' ' || m.query_id AS phrase
        FROM matched m JOIN wanted w ON m.place_id = w.place_id""",
)
def _(spark, sf):
    targets = targets_v(spark, sf)
    phrases = search_phrases(targets.withColumnRenamed("query_id", "area"), F.col("area"))
    matched = match_listings(targets, listings_v(spark, sf)).select("place_id", "href", "tier")
    return matched.join(phrases, "place_id")


_FIRST = f"""
first_listings AS (
  SELECT query_id, pos, name, maps_url, place_id,
         CASE WHEN place_id LIKE 'slug%' THEN 'slug' WHEN place_id LIKE '0x%' THEN 'hex_pair' ELSE 'api' END AS id_kind, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM (
    SELECT query_id, pos, trim(label, {WS}) AS name, href AS maps_url,
           CASE pos // 2 % 3 WHEN 0 THEN '0x' || lower(to_hex(pos // 2)) || ':0xFe'
             WHEN 1 THEN 'ChIJ' || lower(to_hex(pos // 2))
             ELSE 'slug_' || substr(lower(trim(regexp_replace(substr(replace(substr(href, 32), '+', ' '), 1, 80), '[^a-zA-Z0-9]+', '_', 'g'), '_')), 1, 48) END AS place_id
    FROM (SELECT query_id, min(pos) AS pos, href, arg_min(cleaned, pos) AS label FROM
           (SELECT *, regexp_replace(label, ' 4.5 stars, open$', '') AS cleaned FROM (SELECT query_id, pos, label, trim(href) AS href FROM listings))
          GROUP BY query_id, href))
    WHERE name <> ''))"""


@query(
    "w6_first_listings",
    f"WITH {LISTINGS}, {_FIRST} SELECT * FROM first_listings WHERE rank <= 20",
)
def _(spark, sf):
    return first_listings(listings_v(spark, sf))


# listings without an id in their link are stored already
_KNOWN = """
known AS (
  SELECT DISTINCT ON (l.place_id) l.place_id, t.title AS name, t.link AS maps_url
  FROM first_listings l JOIN titled t ON l.pos // 2 = t.page_id WHERE id_kind = 'slug'
  ORDER BY l.place_id, t.page_id DESC)"""


def known_places(spark: SparkSession, sf: str) -> DataFrame:
    pages = titled(spark, sf)
    named = pages.filter(url_place_id(F.col("link")).isNull() & (F.length("title") > 0))
    stored = latest(
        named.select(
            slug_id(F.col("link")).alias("place_id"),
            F.col("title").alias("name"),
            F.col("link").alias("maps_url"),
            "page_id",
        ),
        "place_id",
        "page_id",
    )
    return conform(stored, PLACES, F.lit("before"))


_NEW = f"""
fresh AS (
  SELECT DISTINCT ON (place_id) place_id, name, '' AS address, NULL::double AS rating, NULL::integer AS review_count,
         maps_url, '' AS category, '{STAMP}' AS scraped_at
  FROM first_listings WHERE rank <= 15 AND place_id NOT IN (SELECT place_id FROM known) ORDER BY place_id, query_id DESC, rank DESC)"""


@query(
    "q7_new_places",
    f"WITH {LISTINGS}, {_FIRST}, {_KNOWN}, {_NEW} SELECT * FROM fresh",
)
def _(spark, sf):
    _, fresh = discover_incremental(
        listings_v(spark, sf), known_places(spark, sf), 15, scraped_at=F.lit(STAMP)
    )
    return fresh


@query(
    "q7_discover_incremental",
    f"""WITH {LISTINGS}, {_FIRST}, {_KNOWN}, {_NEW} SELECT place_id, name, maps_url, scraped_at FROM fresh
        UNION ALL SELECT place_id, name, maps_url, 'before' FROM known""",
)
def _(spark, sf):
    places, _ = discover_incremental(
        listings_v(spark, sf), known_places(spark, sf), 15, scraped_at=F.lit(STAMP)
    )
    return places.select("place_id", "name", "maps_url", "scraped_at")


@query(
    "u4_new_listings",
    f"WITH {LISTINGS}, {_FIRST}, {_KNOWN} SELECT query_id, place_id FROM first_listings WHERE rank <= 20 AND place_id NOT IN (SELECT place_id FROM known)",
)
def _(spark, sf):
    found = first_listings(listings_v(spark, sf))
    return not_stored(found, known_places(spark, sf), "place_id").select("query_id", "place_id")


# A review's part of a stored page, and its field candidates: (field, rank, pattern).
BLOCK = "<(?:p|li|h1|footer)>.*?</(?:p|li|h1|footer)>"
SELECTORS = [
    ("name", 0, "<h1>([^<]*)</h1>"),
    ("name", 1, "<b>([^<]*)<br>"),
    ("name", 2, '<a href="/([^"]*)">'),
    ("text", 0, "<br><p>([^<]*)</p>"),
    ("text", 1, "<footer>([^<]*)</footer>"),
    ("span", 0, ">([^<]+)<"),
    ("date", 0, "&copy; ([^&]*) &middot;"),
    ("response", 0, "&middot; ([^<]*)<"),
    ("rating", 0, "([0-9]+)"),
    ("source_id", 0, "([0-9]{3,})"),
]

_LISTED = " UNION ALL ".join(
    f"SELECT page_id, block_pos, '{field}' AS field, {rank} AS selector_rank, "
    f"unnest(range(len(regexp_extract_all(html, '{pattern}', 1)))) AS pos, "
    f"unnest(regexp_extract_all(html, '{pattern}', 1)) AS text FROM blocks"
    for field, rank, pattern in SELECTORS
)

FIELDS = f"""
blocks AS (SELECT page_id, unnest(range(len(found))) AS block_pos, unnest(found) AS html FROM (
  SELECT page_id, regexp_extract_all(html, '(?s){BLOCK}', 0) AS found FROM pages)),
candidate_strings AS ({_LISTED}),
cleaned AS (SELECT page_id, block_pos, field, selector_rank, pos, trim(text, {WS}) AS text FROM candidate_strings),
firsts AS (SELECT * FROM cleaned WHERE field = 'span' OR pos = 0),
block AS (SELECT DISTINCT page_id, block_pos FROM firsts),
reviewer AS (SELECT page_id, block_pos, arg_min(text, selector_rank) AS v FROM firsts
  WHERE field = 'name' AND length(text) BETWEEN 1 AND 119 AND NOT regexp_matches(text, '^[0-9]') GROUP BY 1, 2),
body AS (SELECT page_id, block_pos, arg_min(text, selector_rank) AS v FROM firsts WHERE field = 'text' AND length(text) > 2 GROUP BY 1, 2),
longest AS (SELECT page_id, block_pos, arg_max(text, length(text) * 1000 - pos) AS v FROM firsts
  WHERE field = 'span' AND pos < 40 AND length(text) > 15 AND NOT regexp_matches(lower(text), 'photo|local guide|reviews|star|more') GROUP BY 1, 2),
dated AS (SELECT page_id, block_pos, arg_min(text, selector_rank) AS v FROM firsts WHERE field = 'date' AND length(text) BETWEEN 1 AND 79 GROUP BY 1, 2),
answer AS (SELECT page_id, block_pos, arg_min(text, selector_rank) AS v FROM firsts WHERE field = 'response' AND length(text) > 0 GROUP BY 1, 2),
marks AS (SELECT page_id, block_pos, try_cast(regexp_extract(text, '([0-9]+)', 1) AS integer) AS v FROM firsts WHERE field = 'rating'),
numbers AS (SELECT page_id, block_pos, text AS v FROM firsts WHERE field = 'source_id'),
fields AS (
  SELECT b.page_id, b.block_pos, coalesce(r.v, '') AS reviewer_name, coalesce(t.v, l.v, '') AS text, coalesce(d.v, '') AS published_date,
         a.v AS owner_response, m.v AS rating, n.v AS source_id
  FROM block b LEFT JOIN reviewer r USING (page_id, block_pos) LEFT JOIN body t USING (page_id, block_pos)
  LEFT JOIN longest l USING (page_id, block_pos) LEFT JOIN dated d USING (page_id, block_pos) LEFT JOIN answer a USING (page_id, block_pos)
  LEFT JOIN marks m USING (page_id, block_pos) LEFT JOIN numbers n USING (page_id, block_pos)),
assembled AS (
  SELECT query_id || '::' || coalesce(source_id, 'gen_' || page_id || '_' || (block_pos + 1)) AS review_id, query_id AS place_id,
         'Site ' || query_id AS place_name, text, rating, published_date, reviewer_name, owner_response, page_id, block_pos
  FROM fields JOIN (SELECT page_id, regexp_extract(url, '/([a-z][a-z])/', 1) AS query_id FROM pages) USING (page_id)
  WHERE length(trim(text, {WS})) > 0),
once AS (SELECT * FROM assembled QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY page_id, block_pos) = 1)"""


def candidates_v(spark: SparkSession, sf: str) -> DataFrame:
    return page_candidates(table(spark, sf, "pages"), SELECTORS, BLOCK)


def sites_v(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each page: its language, so that places have very many reviews."""
    return titled(spark, sf).select(
        "page_id",
        F.col("query_id").alias("place_id"),
        F.concat(F.lit("Site "), "query_id").alias("name"),
    )


@query("x0_field_candidates", f"WITH {FIELDS} SELECT * FROM firsts")
def _(spark, sf):
    return first_per_selector(candidates_v(spark, sf))


def _field(name: str, column: str):
    @query(name, f"WITH {FIELDS} SELECT page_id, block_pos, {column} FROM fields")
    def _(spark, sf):
        return block_fields(candidates_v(spark, sf)).select("page_id", "block_pos", column)


for _name, _column in (
    ("x1_reviewer_name", "reviewer_name"),
    ("x2_review_text", "text"),
    ("x3_date", "published_date"),
    ("x4_owner_response", "owner_response"),
    ("x5_rating", "rating"),
):
    _field(_name, _column)


@query("x6_assembled_reviews", f"WITH {FIELDS} SELECT * EXCLUDE (page_id, block_pos) FROM assembled")
def _(spark, sf):
    return assemble_reviews(block_fields(candidates_v(spark, sf)), sites_v(spark, sf)).drop("pos")


def _capped(order: str, limit: int) -> str:
    return f"""WITH {FIELDS} SELECT review_id, place_id, text, rating, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY {order} page_id, block_pos) AS rank FROM once)
      WHERE rank <= {limit}"""


@query("w7_capped_by_rating", _capped("rating DESC NULLS LAST,", 30))
def _(spark, sf):
    rows = assemble_reviews(block_fields(candidates_v(spark, sf)), sites_v(spark, sf))
    return cap_reviews(rows, 30, "highest_rating").select("review_id", "place_id", "text", "rating", "rank")


@query("w7_capped_in_order", _capped("", 50))
def _(spark, sf):
    rows = assemble_reviews(block_fields(candidates_v(spark, sf)), sites_v(spark, sf))
    return cap_reviews(rows, 50, "relevant").select("review_id", "place_id", "text", "rating", "rank")


@query("w7_capped_newest", _capped("length(text) % 12,", 40))
def _(spark, sf):
    rows = assemble_reviews(block_fields(candidates_v(spark, sf)), sites_v(spark, sf))
    age = F.concat((F.length("text") % 12).cast("string"), F.lit(" months ago"))
    dated = rows.withColumn("published_date", age)
    return cap_reviews(dated, 40, "newest").select("review_id", "place_id", "text", "rating", "rank")


@query(
    "q9_extract_reviews",
    f"""WITH {FIELDS} SELECT * EXCLUDE (page_id, block_pos, rank), '{STAMP}' AS scraped_at FROM (
      SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY page_id, block_pos) AS rank FROM once) WHERE rank <= 50""",
)
def _(spark, sf):
    return extract_reviews(
        candidates_v(spark, sf), sites_v(spark, sf), 50, "newest", F.lit(STAMP)
    )


# elements from start to end tag: possessive signs, which the other engine has no need of, are left out
_PIECE = PIECE.replace("*+", "*").replace("++", "+").replace("'", "''")


def _element_sql(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    single = ", ".join(f"'{n}'" for n in NO_NESTING)
    return f"""
pieces AS (SELECT page_id, unnest(range(len(f))) AS pos, unnest(f) AS piece FROM (
  SELECT page_id, regexp_extract_all(html, '{_PIECE}', 0) AS f FROM pages)),
ends AS (SELECT *, sum(length(piece)) OVER (PARTITION BY page_id ORDER BY pos) AS stop FROM pieces),
tags AS (
  SELECT page_id, stop - length(piece) AS start, stop, lower(regexp_extract(piece, '{NAME}', 1)) AS name,
         CASE WHEN piece LIKE '</%' THEN -1 WHEN piece LIKE '%/>' THEN 0 ELSE 1 END AS sign
  FROM ends WHERE lower(regexp_extract(piece, '{NAME}', 1)) IN ({listed})),
deep AS (SELECT *, sum(sign) OVER (PARTITION BY page_id, name ORDER BY start) + CASE WHEN sign < 0 THEN 1 ELSE 0 END AS level FROM tags),
reached AS (
  SELECT *, CASE WHEN sign = 0 THEN stop
    WHEN name IN ({single}) THEN lead(CASE WHEN sign < 0 THEN stop ELSE start END) OVER (PARTITION BY page_id, name ORDER BY start)
    ELSE lead(stop) OVER (PARTITION BY page_id, name, level, sign = 0 ORDER BY start) END AS reach
  FROM deep),
elements AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS block_pos, name,
         substr(html, start::bigint + 1, coalesce(reach, length(html))::bigint - start::bigint) AS html
  FROM reached JOIN pages USING (page_id) WHERE sign >= 0)"""


@query("x6_nested_blocks", f"WITH {_element_sql(ELEMENTS)} SELECT page_id, block_pos, name, md5(html) AS digest FROM elements")
def _(spark, sf):
    # every element that bears text, nested ones inside their parents
    blocks = element_blocks(table(spark, sf, "pages"))
    return blocks.select("page_id", "block_pos", "name", F.md5(F.col("html").cast("binary")).alias("digest"))


# of these the innermost hold all text of a page but that of its scripts
PARTS = ["article", "div", "footer", "h1", "header", "li", "main", "p", "section", "table", "title"]
_PART_FIELDS = (
    f"{_element_sql(PARTS)}, blocks AS (SELECT page_id, block_pos, html FROM elements),\ncandidate_strings AS"
    + FIELDS.split("candidate_strings AS", 1)[1]
)


@query("x6_fields_of_elements", f"WITH {_PART_FIELDS} SELECT * FROM fields")
def _(spark, sf):
    return block_fields(page_candidates(table(spark, sf, "pages"), SELECTORS, elements=PARTS))


@query(
    "q9_extract_from_elements",
    f"""WITH {_PART_FIELDS} SELECT * EXCLUDE (page_id, block_pos, rank), '{STAMP}' AS scraped_at FROM (
      SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY page_id, block_pos) AS rank FROM once) WHERE rank <= 50""",
)
def _(spark, sf):
    found = page_candidates(table(spark, sf, "pages"), SELECTORS, elements=PARTS)
    return extract_reviews(found, sites_v(spark, sf), 50, "newest", F.lit(STAMP))


@query(
    "a9_discovery_stats",
    f"""WITH {LISTINGS}, {_FIRST}, {_KNOWN}, {_NEW}, {FIELDS}
        SELECT (SELECT count(*) FROM fresh) AS places_scraped,
               (SELECT sum(least(n, 50)) FROM (SELECT count(*) AS n FROM once GROUP BY place_id))::bigint AS reviews_added""",
)
def _(spark, sf):
    fresh = new_places(
        first_listings(listings_v(spark, sf), 15), known_places(spark, sf), scraped_at=F.lit(STAMP)
    )
    reviews = extract_reviews(candidates_v(spark, sf), sites_v(spark, sf), 50)
    return discovery_stats(fresh, reviews)

"""Scalar functions, filters and fields as shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import query
from suite.views import WS, places_v, reviews_v, spread, table, with_views
from vouch.functions import display, ids, listing
from vouch.functions.text import is_blank, preview, snippet, squash, strip, tokenize
from vouch.operators.corpus import corpus
from vouch.operators.exact import any_variant, found_variants, has_variant
from vouch.operators.listings import first_listings
from vouch.operators.queries import expand, with_variants


@query(
    "s5_content_review_ids",
    with_views(
        f"""SELECT doc_id, place_id || '::' || substr(sha256(place_id || '|' || reviewer_name || '|' ||
                   published_date || '|' || substr(trim(text, {WS}), 1, 500)), 1, 16) AS content_id
            FROM reviews_v"""
    ),
)
def _(spark, sf):
    made = ids.content_review_id(
        F.col("place_id"), strip(F.col("text")), F.col("reviewer_name"), F.col("published_date")
    )
    return reviews_v(spark, sf).select("doc_id", made.alias("content_id"))


CORPUS = f"""
corpus AS (
  SELECT review_id AS id, concat_ws(' | ', nullif(place_name, ''), 'rating ' || rating || '/5',
         nullif(published_date, ''), trim(text, {WS}), 'owner response: ' || nullif(owner_response, '')) AS contents
  FROM reviews_v WHERE length(trim(text, {WS})) > 0)"""


@query("s6_corpus_contents", with_views("SELECT * FROM corpus", CORPUS))
def _(spark, sf):
    return corpus(reviews_v(spark, sf))


@query("s7_strip", f"SELECT doc_id, trim(text, {WS}) AS stripped FROM documents")
def _(spark, sf):
    # padded with signs of all kinds that count as space
    padded = F.concat(F.lit("　\t "), "text", F.lit("\x1f  \n"))
    return table(spark, sf, "documents").select("doc_id", strip(padded).alias("stripped"))


@query(
    "s9_squash",
    r"""SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS squashed
        FROM documents""",
)
def _(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", squash(F.col("text")).alias("squashed")
    )


_SPELLINGS = """
phrases AS (
  SELECT p_partkey, unnest([p_name, p_type, p_brand || '  New']) AS phrase FROM part),
normal AS (
  SELECT p_partkey, trim(regexp_replace(lower(phrase), '\\s+', ' ', 'g')) AS phrase FROM phrases),
spellings AS (
  SELECT DISTINCT p_partkey, unnest([phrase, replace(phrase, ' ', '-'), replace(phrase, ' ', '')]) AS variant
  FROM normal)"""


@query("s10_query_variants", f"WITH {_SPELLINGS} SELECT * FROM spellings")
def _(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("qid"),
        F.concat(F.lit("  "), F.upper("p_name"), F.lit("\n")).alias("query"),
        F.array("p_type", F.concat("p_brand", F.lit("  New")), F.lit(" ")).alias("synonyms"),
    )
    return with_variants(part).select(
        F.col("qid").alias("p_partkey"), F.explode("variants").alias("variant")
    )


@query("u1_variant_union", f"WITH {_SPELLINGS} SELECT DISTINCT variant FROM spellings")
def _(spark, sf):
    part = table(spark, sf, "part")
    own = part.select(F.explode(expand(F.col("p_name"), F.array("p_type"))).alias("variant"))
    more = part.select(
        F.explode(expand(F.concat("p_brand", F.lit(" new")), F.array())).alias("variant")
    )
    return own.union(more).distinct()


# variants the texts are searched for, sorted as `expand` gives them
VARIANTS = "['in the', 'in-the', 'inthe', 'of the', 'of-the', 'ofthe']"


def variants_column():
    return expand(F.lit("Of  the"), F.array(F.lit("in the")))


def snippet_sql(text: str, variants: str, width: int = 220) -> str:
    """SQL of the snippet of ``text``; both arguments are SQL expressions."""
    hit = f"""list_sort(list_filter(list_transform(range(1, len({variants}) + 1),
      lambda i: {{'p': instr(lower({text}), {variants}[i]), 'i': i}}), lambda h: h.p > 0))[1]"""
    start = f"greatest(0, h.p - 1 - {width})"
    end = f"least(length({text}), h.p - 1 + length({variants}[h.i]) + {width})"
    return f"""list_transform([{hit}], lambda h: CASE WHEN h IS NULL
      THEN substr(replace(trim({text}, {WS}), chr(10), ' '), 1, {2 * width}) ||
           CASE WHEN length({text}) > {2 * width} THEN '…' ELSE '' END
      ELSE CASE WHEN {start} > 0 THEN '…' ELSE '' END ||
           replace(trim(substr({text}, {start} + 1, {end} - {start}), {WS}), chr(10), ' ') ||
           CASE WHEN {end} < length({text}) THEN '…' ELSE '' END END)[1]"""


@query("s11_snippets", f"SELECT doc_id, {snippet_sql('text', VARIANTS)} AS snippet FROM documents")
def _(spark, sf):
    documents = spread(table(spark, sf, "documents"), "doc_id")
    return documents.select("doc_id", snippet(F.col("text"), variants_column()).alias("snippet"))


@query(
    "s12_preview",
    """SELECT doc_id, replace(substr(text, 1, 200), chr(10), ' ') ||
                      CASE WHEN length(text) > 200 THEN '…' ELSE '' END AS preview FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


def page_link(page, url):
    """A maps link made of a page: with a hex pair, with another id, or with neither."""
    site = F.lit("https://maps.example.com/place/")
    number = F.lower(F.hex(page))
    return (
        F.when(page % 3 == 0, F.concat(site, F.lit("a/data=!4m2!1s0x"), number, F.lit(":0xFe!2z")))
        .when(page % 3 == 1, F.concat(site, F.lit("b+c/@1,2,3z/data=!4m2!1sChIJ"), number, F.lit("!x")))
        .otherwise(F.concat(site, F.replace(url, F.lit("/"), F.lit("+"))))
    )


PAGE_LINK = """CASE page_id % 3
  WHEN 0 THEN 'https://maps.example.com/place/a/data=!4m2!1s0x' || lower(to_hex(page_id)) || ':0xFe!2z'
  WHEN 1 THEN 'https://maps.example.com/place/b+c/@1,2,3z/data=!4m2!1sChIJ' || lower(to_hex(page_id)) || '!x'
  ELSE 'https://maps.example.com/place/' || replace(url, '/', '+') END"""


@query(
    "s13_url_place_ids",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '0x' || lower(to_hex(page_id)) || ':0xFe'
                       WHEN 1 THEN 'ChIJ' || lower(to_hex(page_id)) END AS place_id FROM pages""",
)
def _(spark, sf):
    link = page_link(F.col("page_id"), F.col("url"))
    return table(spark, sf, "pages").select("page_id", ids.url_place_id(link).alias("place_id"))


@query(
    "s14_bare_place_ids",
    with_views(
        "SELECT place_id AS key, regexp_replace(CASE WHEN address LIKE '%1%' THEN 'places/' ELSE '' END || name, '^places/', '') AS bare FROM places_v"
    ),
)
def _(spark, sf):
    raw = F.concat(F.when(F.col("address").contains("1"), "places/").otherwise(""), "name")
    return places_v(spark, sf).select(
        F.col("place_id").alias("key"), ids.bare_place_id(raw).alias("bare")
    )


@query(
    "s15_absolute_hrefs",
    f"""SELECT page_id, href, CASE WHEN link LIKE '//%' THEN 'https:' || link
                               WHEN link LIKE '/%' THEN 'https://www.google.com' || link ELSE link END AS absolute
        FROM (SELECT page_id, href, trim(href, {WS}) AS link FROM (
          SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages
          UNION ALL SELECT page_id, '/' || substr(url, instr(url, '//') + 1) FROM pages
          UNION ALL SELECT page_id, url FROM pages))""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages")
    own = F.concat(F.lit("/"), F.substring("url", F.instr("url", "//") + 1, F.length("url")))
    hrefs = F.concat(
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), F.array(own, F.col("url"))
    )
    links = pages.select("page_id", F.explode(hrefs).alias("href"))
    return links.select("page_id", "href", ids.absolute_href(F.col("href")).alias("absolute"))


@query(
    "s16_slug_ids",
    r"""SELECT page_id, 'slug_' || substr(lower(trim(regexp_replace(substr(title, 1, 80), '[^a-zA-Z0-9]+', '_', 'g'), '_')), 1, 48) AS slug
        FROM (SELECT page_id, replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '/', '-'), '+', ' ') AS title FROM pages)""",
)
def _(spark, sf):
    title = F.replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("/"), F.lit("-"))
    link = F.concat(F.lit("https://maps.example.com/maps/place/"), F.url_encode(title), F.lit("/@1,2"))
    return table(spark, sf, "pages").select("page_id", ids.slug_id(link).alias("slug"))


@query("s17_clean_names", with_views("SELECT place_id, trim(name) AS name FROM places_v"))
def _(spark, sf):
    label = F.concat(
        F.lit(" "),
        F.col("name"),
        F.when(F.col("rating").isNull(), "").otherwise(
            F.format_string("  %.1f Stars · %d reviews", "rating", F.coalesce("review_count", F.lit(0)))
        ),
    )
    return places_v(spark, sf).select("place_id", listing.clean_name(label).alias("name"))


@query(
    "s18_compact_queries",
    r"""SELECT p_partkey, array_to_string(list_slice(regexp_split_to_array(trim(
                 string_split(string_split(p_name || ' ' || p_type || ' x y' || sep || p_brand, '·')[1], ' | ')[1]), '\s+'), 1, 3), ' ')
               || ' near ' || p_brand AS phrase
        FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN '·' WHEN 1 THEN ' | ' ELSE ' z ' END AS sep FROM part)""",
)
def _(spark, sf):
    size = F.col("p_size") % 3
    sep = F.when(size == 0, "·").when(size == 1, " | ").otherwise(" z ")
    name = F.concat("p_name", F.lit(" "), "p_type", F.lit(" x y"), sep, "p_brand")
    place = F.concat(F.lit(" near "), "p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", listing.compact_query(name, place).alias("phrase")
    )


@query(
    "s19_match_keys",
    """SELECT p_partkey, regexp_replace(lower(p_name || ', ' || p_brand), '[^a-z0-9]', '', 'g') AS name_key,
              regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS label_key FROM part""",
)
def _(spark, sf):
    name = F.concat_ws(", ", "p_name", "p_brand")
    return table(spark, sf, "part").select(
        "p_partkey",
        listing.match_key(name).alias("name_key"),
        listing.label_key(name).alias("label_key"),
    )


@query(
    "s20_default_links",
    with_views(
        """SELECT place_id, CASE WHEN rating IS NULL THEN 'https://www.google.com/maps/place/?q=place_id:' || place_id
                            ELSE maps_url END AS maps_url FROM places_v"""
    ),
)
def _(spark, sf):
    known = F.when(F.col("rating").isNotNull(), F.col("maps_url")).otherwise("")
    return places_v(spark, sf).select(
        "place_id", ids.default_link(known, F.col("place_id")).alias("maps_url")
    )


@query(
    "s21_stars",
    "SELECT event_id, CASE WHEN event_type <> 'view' THEN cast(user_id AS integer) END AS stars FROM events",
)
def _(spark, sf):
    label = F.when(
        F.col("event_type") != "view", F.concat(F.lit(" "), "user_id", F.lit(" stars of 5"))
    ).otherwise("no stars")
    return table(spark, sf, "events").select("event_id", listing.stars(label).alias("stars"))


@query(
    "s22_display_fields",
    with_views(
        """SELECT r.doc_id, CASE WHEN r.rating <> 0 THEN r.rating || '/5' ELSE '—' END AS rating,
                  CASE WHEN p.rating <> 0 THEN printf('%.1f', p.rating) ELSE '—' END AS place_rating,
                  CASE WHEN p.review_count <> 0 THEN cast(p.review_count AS varchar) ELSE '—' END AS reviews,
                  concat_ws(' · ', r.rating || '/5', nullif(r.published_date, ''), r.reviewer_name) AS meta,
                  concat_ws(' · ', r.rating || '/5', nullif(r.published_date, ''), r.reviewer_name,
                            'bm25 ' || CASE WHEN p.rating <> 0 THEN printf('%.2f', p.rating) END) AS evidence
           FROM reviews_v r LEFT JOIN places_v p ON r.place_id = p.place_id"""
    ),
)
def _(spark, sf):
    places = places_v(spark, sf).select("place_id", F.col("rating").alias("stars"), "review_count")
    said = F.col("rating"), F.col("published_date"), F.col("reviewer_name")
    return (
        reviews_v(spark, sf)
        .join(places, "place_id", "left")
        .select(
            "doc_id",
            F.coalesce(display.review_rating(F.col("rating")), F.lit(display.NONE)).alias("rating"),
            F.coalesce(display.place_rating(F.col("stars")), F.lit(display.NONE)).alias("place_rating"),
            F.coalesce(display.count(F.col("review_count")), F.lit(display.NONE)).alias("reviews"),
            display.review_meta(*said).alias("meta"),
            display.evidence_meta(*said, F.col("stars")).alias("evidence"),
        )
    )


@query(
    "f1_contains_variant",
    "SELECT doc_id, contains(lower(text), 'of the') AS literal, lower(text) LIKE '%of%the%' AS pattern FROM documents",
)
def _(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        has_variant(low, F.lit("of the")).alias("literal"),
        has_variant(low, F.lit("of%the"), wildcards=True).alias("pattern"),
    )


@query(
    "f2_any_variant",
    f"""SELECT doc_id, len(list_filter({VARIANTS}, lambda v: contains(lower(text), v))) > 0 AS any_variant,
               list_filter({VARIANTS}, lambda v: contains(lower(text), v)) AS found FROM documents""",
)
def _(spark, sf):
    documents = spread(table(spark, sf, "documents"), "doc_id")
    return documents.select(
        "doc_id",
        any_variant(F.col("text"), variants_column()).alias("any_variant"),
        found_variants(F.col("text"), variants_column()).alias("found"),
    )


_LINES = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"""


@query(
    "f3_text_not_blank",
    f"WITH {_LINES} SELECT doc_id, line FROM lines WHERE length(trim(line, {WS})) > 0",
)
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(~is_blank(F.col("line")))


@query(
    "f8_named_places",
    with_views(
        """SELECT address AS query_id, cast(place_id AS bigint) AS pos, name, maps_url
           FROM places_v WHERE rating IS NOT NULL"""
    ),
)
def _(spark, sf):
    # a place without rating stands for a listing without name, or without link
    known, even = F.col("rating").isNotNull(), F.col("place_id").cast("bigint") % 2 == 0
    listings = places_v(spark, sf).select(
        F.col("address").alias("query_id"),
        F.col("place_id").cast("bigint").alias("pos"),
        F.when(known | ~even, F.col("name")).alias("label"),
        F.when(known | even, F.col("maps_url")).otherwise("  ").alias("href"),
    )
    return first_listings(listings, max_places=1 << 30).select("query_id", "pos", "name", "maps_url")


@query(
    "b1_tokens",
    r"""SELECT doc_id, len(tokens) AS tokens, md5(array_to_string(tokens, ' ')) AS digest
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens FROM documents)""",
)
def _(spark, sf):
    documents = spread(table(spark, sf, "documents"), "doc_id")
    tokens = documents.select("doc_id", tokenize(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id",
        F.size("tokens").alias("tokens"),
        F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"),
    )


@query(
    "b2_stop_words",
    r"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'),
               lambda t: t NOT IN ('the', 'of', 'la', 'der'))) AS tokens FROM documents""",
)
def _(spark, sf):
    documents = spread(table(spark, sf, "documents"), "doc_id")
    stop = ["the", "of", "la", "der"]
    return documents.select("doc_id", F.size(tokenize(F.col("text"), stop)).alias("tokens"))

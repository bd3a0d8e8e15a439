"""Sources, import and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from suite import query
from suite.views import (
    ENTRIES,
    STAMP,
    WS,
    entry_lines,
    places_v,
    reviews_v,
    spread,
    table,
    with_views,
)
from vouch.functions.json import is_object, pick
from vouch.operators.status import place_ids
from vouch.operators.upsert import latest, not_stored, upsert_counts
from vouch.plans import ingest
from vouch.schemas import PLACES, REVIEWS, conform
from vouch.session import materialize, new_path
from vouch.sources import entries as src
from vouch.sources.listings import area_query, places_from_pages, query_lines, split_variants
from vouch.sources.tables import TableStore


_lines: dict[tuple[str, str], DataFrame] = {}


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The raw entries as a written table, made once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _lines:
        _lines[key] = materialize(entry_lines(spark, sf), "lines")
    return spread(_lines[key], "seq")


def raw_entries(spark: SparkSession, sf: str) -> DataFrame:
    return src.entries_from_lines(raw_lines(spark, sf))


@query(
    "src1_entries_ndjson",
    with_views("SELECT DISTINCT place_id, entry_name AS name, part FROM occ", ENTRIES),
)
def _(spark, sf):
    # every page and document text is a line that is no JSON object
    noise = (
        table(spark, sf, "documents")
        .select("text")
        .unionByName(table(spark, sf, "pages").select(F.col("html").alias("text")))
    )
    path = new_path(spark, "entries")
    lines = raw_lines(spark, sf).select("line").union(noise)
    lines.write.option("lineSep", "\n").text(path)
    entries = src.load_entries(spark, path, "ndjson")
    rows = src.entry_places(entries).select("place_id", "name", "seq")
    # entries of one place come in the order of their parts
    number = F.row_number().over(W.partitionBy("place_id").orderBy("seq")) - 1
    return rows.select("place_id", "name", number.cast("bigint").alias("part"))


# parts of places in one file: a file is written by one task, so more parts make more files
LIST_PARTS = 16


def write_lists(lines: DataFrame) -> str:
    """``lines(seq, line)`` as files of one JSON list each, in the order of ``seq``; the folder of these files."""
    path, seq = new_path(lines.sparkSession, "lists"), F.col("seq")
    run, place = F.floor(seq / (LIST_PARTS * 1_000_000)), F.pmod(seq % 1_000_000, F.lit(4))
    entries = lines.select(
        run.alias("run"), place.alias("place"), F.lit(1).alias("at"), seq, F.concat(F.lit(", "), "line").alias("line")
    )
    ends = entries.filter(seq.isNotNull()).select("run", "place").distinct().select(
        "run",
        "place",
        F.inline(F.array(*[F.struct(F.lit(n).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(text).alias("line")) for n, text in ((0, "[7"), (2, ', "} ["]'))])),
    )
    runs = lines.agg(F.max(run) - F.min(run) + 1).first()[0] or 1
    name = F.when(F.col("run").isNotNull(), F.format_string("%019d-%d", "run", "place"))
    rows = entries.unionByName(ends).withColumn("file", name)
    rows = rows.repartitionById(4 * runs, F.coalesce(F.pmod(F.col("run") * 4 + F.col("place"), F.lit(4 * runs)), F.lit(0)).cast("int"))
    rows.sortWithinPartitions("file", "at", "seq").select("file", "line").write.partitionBy("file").text(path)
    return path


@query(
    "src1_entries_lists",
    with_views("SELECT DISTINCT place_id, entry_name AS name, part FROM occ", ENTRIES),
)
def _(spark, sf):
    # a few files, each one JSON list with a number before its entries and a text after them; a place is in one file of
    # each run of parts, and files are named in the order of these
    path = write_lists(raw_lines(spark, sf))
    rows = src.entry_places(src.load_entries(spark, path)).select("place_id", "name", "seq")
    number = F.row_number().over(W.partitionBy("place_id").orderBy("seq")) - 1
    return rows.select("place_id", "name", number.cast("bigint").alias("part"))


@query(
    "src1_entries_documents",
    with_views(
        """SELECT DISTINCT seq, place_id, entry_name AS name,
                  CASE WHEN cast(place_id AS bigint) % 3 = 0 THEN 1 WHEN cast(place_id AS bigint) % 3 = 1 THEN 0 ELSE 2 END AS pos
           FROM occ""",
        ENTRIES,
    ),
)
def _(spark, sf):
    # a list with non-objects, one object, or lines of which one is an entry
    kind = F.col("seq") % 1_000_000 % 3
    body = (
        F.when(kind == 0, F.concat(F.lit(' [7, '), "line", F.lit(', "x"] ')))
        .when(kind == 1, F.concat(F.lit("\n"), "line", F.lit("\n")))
        .otherwise(F.concat(F.lit("[1]\n\n"), "line", F.lit("\n{broken")))
    )
    documents = raw_lines(spark, sf).select("seq", body.alias("body"))
    entries = src.entries_from_documents(documents)
    return src.entry_places(entries).select(
        F.col("seq.seq").alias("seq"), "place_id", "name", F.col("seq.pos").alias("pos")
    )


@query(
    "src2_review_items",
    with_views(
        "SELECT seq, list_no, pos, place_id, reviewer_name AS reviewer FROM items", ENTRIES
    ),
)
def _(spark, sf):
    return src.review_items(raw_entries(spark, sf)).select(
        "seq",
        "list_no",
        "pos",
        "place_id",
        pick(F.col("item"), "Name", "name", "reviewer_name").alias("reviewer"),
    )


_PAGES_SQL = """
page_items AS (
  SELECT address AS query_id, cast(place_id AS bigint) // 40 AS page_no, place_id, name, address, rating,
         review_count, maps_url, category,
         row_number() OVER (PARTITION BY address ORDER BY cast(place_id AS bigint)) AS rank
  FROM places_v)"""


def saved_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Saved search responses: one query per nation, places in pages, one item without id each."""
    key = F.col("place_id").cast("bigint")
    name = F.when(key % 2 == 0, F.to_json(F.struct(F.col("name").alias("text")))).otherwise(
        F.concat(F.lit('"'), "name", F.lit('"'))
    )
    rest = F.to_json(
        F.struct(
            F.col("address").alias("formattedAddress"),
            "rating",
            F.col("review_count").alias("userRatingCount"),
            F.col("maps_url").alias("googleMapsUri"),
            F.col("category").alias("primaryType"),
        )
    )
    item = F.concat(
        F.lit('{"id":"places/'), "place_id", F.lit('","displayName":'), name, F.lit(","),
        F.substring(rest, F.lit(2), F.length(rest)),
    )
    items = F.array_sort(F.collect_list(F.struct(key.alias("k"), item.alias("item"))))
    body = F.concat(
        F.lit('{"places":[{"displayName":"no id"},'),
        F.array_join(F.transform(items, lambda i: i["item"]), ","),
        F.lit("]}"),
    )
    return (
        places_v(spark, sf)
        .groupBy(F.col("address").alias("query_id"), F.floor(key / 40).alias("page_no"))
        .agg(F.parse_json(body).alias("body"))
    )


@query(
    "src3_places_from_pages",
    with_views(
        """SELECT query_id, rank, place_id, name, address, rating, review_count, maps_url, category
           FROM page_items WHERE rank <= 20""",
        _PAGES_SQL,
    ),
)
def _(spark, sf):
    return places_from_pages(saved_pages(spark, sf)).drop("page_no", "pos")


@query(
    "src4_query_lines",
    f"""SELECT doc_id, query FROM (
          SELECT doc_id, trim(unnest(string_split(text, chr(10))), {WS}) AS query FROM documents)
        WHERE length(query) > 0""",
)
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return query_lines(lines).select("doc_id", "query")


@query(
    "src4_area_queries",
    with_views("SELECT place_id, name || ' in ' || address AS query FROM places_v"),
)
def _(spark, sf):
    padded = F.concat(F.lit(" "), "name", F.lit("\t"))
    return places_v(spark, sf).select("place_id", area_query(padded, F.col("address")).alias("query"))


@query(
    "src5_variant_list",
    f"""SELECT doc_id, variant FROM (
          SELECT doc_id, trim(unnest(string_split(text, ',')), {WS}) AS variant FROM documents)
        WHERE length(variant) > 0""",
)
def _(spark, sf):
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return split_variants(documents, "text").select("doc_id", "variant")


@query(
    "src6_typed_tables",
    with_views(
        f"""SELECT review_id, place_id, '' AS place_name, text, rating, published_date, '' AS reviewer_name,
                  owner_response, '{STAMP}' AS scraped_at FROM reviews_v"""
    ),
)
def _(spark, sf):
    loose = reviews_v(spark, sf).select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % 120).alias("place_id"),
        "text",
        F.col("rating").cast("string").alias("rating"),
        "published_date",
        "owner_response",
    )
    return conform(loose, REVIEWS, F.lit(STAMP))


@query(
    "s1_pick_alias",
    """SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN event_type END,
                                 CASE WHEN event_type <> 'view' THEN cast(user_id AS varchar) END, 'none') AS picked
       FROM events""",
)
def _(spark, sf):
    kind = F.col("event_type")
    entry = F.parse_json(
        F.to_json(
            F.struct(
                F.when(kind == "click", kind).otherwise("").alias("Name"),
                F.when(kind != "view", F.col("user_id")).alias("name"),
            )
        )
    )
    events = table(spark, sf, "events").select("event_id", entry.alias("entry"))
    return events.select(
        "event_id", pick(F.col("entry"), "Name", "name", default="none").alias("picked")
    )


@query("s2_review_fields", with_views("SELECT * FROM raw_reviews", ENTRIES))
def _(spark, sf):
    return src.entry_reviews(raw_entries(spark, sf))


_ENTRY_PLACES = with_views(
    """SELECT DISTINCT o.seq, o.place_id, coalesce(p.name, '') AS name, coalesce(p.address, '') AS address, p.rating,
              p.review_count, coalesce(p.maps_url, '') AS maps_url, coalesce(p.category, '') AS category
       FROM occ o LEFT JOIN places_v p ON o.place_id = p.place_id""",
    ENTRIES,
)


@query("s3_entry_places", _ENTRY_PLACES)
def _(spark, sf):
    return src.entry_places(raw_entries(spark, sf))


@query(
    "s4_entry_place_ids",
    """SELECT page_id, CASE page_id % 5
              WHEN 0 THEN 'p' || page_id WHEN 1 THEN cast(page_id AS varchar)
              WHEN 2 THEN '0x' || lower(to_hex(page_id)) || ':0xAB' || lower(to_hex(length(html)))
              WHEN 3 THEN '0x1:0x' || lower(to_hex(page_id)) ELSE 'unknown' END AS place_id
       FROM pages""",
)
def _(spark, sf):
    page = F.col("page_id")
    kind = page % 5
    size = F.lower(F.hex(F.length("html")))
    number = F.lower(F.hex(page))
    entry = F.to_json(
        F.struct(
            F.when(kind == 0, F.concat(F.lit("p"), page)).otherwise("").alias("place_id"),
            F.when(kind == 1, page).otherwise(0).alias("Cid"),
            F.when(kind == 2, F.concat(F.lit("https://x/place/a!1S0x"), number, F.lit(":0xAB"), size, F.lit("!z")))
            .when(kind < 2, F.col("url"))
            .alias("link"),
            F.when(kind == 3, F.concat(F.lit("data=1s0x1:0x"), number)).alias("Link"),
        )
    )
    entries = table(spark, sf, "pages").select(page.alias("seq"), F.parse_json(entry).alias("entry"))
    return src.entry_places(entries).select(F.col("seq").alias("page_id"), "place_id")


@query(
    "s8_lenient_rating",
    """SELECT event_id, cast(trunc(value) AS integer) AS from_number,
              CASE WHEN value = trunc(value) AND false THEN 1 END AS from_decimal_text,
              cast(user_id AS integer) AS from_text FROM events""",
)
def _(spark, sf):
    from vouch.functions.json import field

    entry = F.parse_json(
        F.to_json(
            F.struct(
                F.col("value").alias("a"),
                F.format_string("%.2f", "value").alias("b"),
                F.col("user_id").cast("string").alias("c"),
            )
        )
    )
    events = table(spark, sf, "events").select("event_id", entry.alias("entry"))
    number = lambda key: field(F.col("entry"), key, "int")
    return events.select(
        "event_id",
        number("a").alias("from_number"),
        number("b").alias("from_decimal_text"),
        number("c").alias("from_text"),
    )


@query(
    "f4_json_objects",
    "SELECT event_id, event_type IN ('click', 'view') AS is_object FROM events",
)
def _(spark, sf):
    text = (
        F.when(F.col("event_type").isin("click", "view"), F.col("props"))
        .when(F.col("event_type") == "error", F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf, "events").select(
        "event_id", is_object(F.try_parse_json(text)).alias("is_object")
    )


_FIRST_IN_ENTRY = """
first_in_entry AS (
  SELECT * FROM raw_reviews QUALIFY row_number() OVER (PARTITION BY seq, review_id ORDER BY list_no, pos) = 1)"""


@query(
    "w2_first_in_entry",
    with_views("SELECT * EXCLUDE (list_no, pos) FROM first_in_entry", ENTRIES, _FIRST_IN_ENTRY),
)
def _(spark, sf):
    return ingest.first_in_entry(src.entry_reviews(raw_entries(spark, sf)))


@query(
    "a6_import_stats",
    with_views(
        """SELECT (SELECT count(DISTINCT seq) FROM occ) AS entries, 0 AS unknown_places,
                  (SELECT count(*) FROM first_in_entry) AS reviews_upserted""",
        ENTRIES,
        _FIRST_IN_ENTRY,
    ),
)
def _(spark, sf):
    return ingest.import_stats(raw_entries(spark, sf))


# updates to half-overlapping tables: labelled reviews in two versions, and the turns of
# conversations as reviews not seen before
def review_updates_v(spark: SparkSession, sf: str) -> DataFrame:
    labelled = reviews_v(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    old = labelled.withColumn("owner_response", F.lit("first answer")).withColumn("seq", F.lit(1))
    new = labelled.withColumn("text", F.concat("text", F.lit(" (edited)"))).withColumn("seq", F.lit(2))
    turns = table(spark, sf, "conversations").select(
        F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("review_id"),
        (F.col("conv_id") % 120).cast("string").alias("place_id"),
        F.col("role").alias("place_name"),
        "text",
    )
    fresh = conform(turns, REVIEWS, F.lit(STAMP)).withColumn("seq", F.lit(3))
    columns = [*REVIEWS.fieldNames(), "seq"]
    return old.select(*columns).unionByName(new.select(*columns)).unionByName(fresh)


_UPDATES = f"""
updates AS (
  SELECT review_id, place_id, place_name, text || ' (edited)' AS text, rating, published_date, reviewer_name,
         owner_response, scraped_at
  FROM reviews_v WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT 'c:' || conv_id || ':' || turn, cast(conv_id % 120 AS varchar), role, text, NULL, '', '', NULL, '{STAMP}'
  FROM conversations)"""


@query(
    "snk2_upsert_reviews",
    with_views(
        """SELECT * FROM updates UNION ALL
           SELECT * EXCLUDE (doc_id) FROM reviews_v WHERE review_id NOT IN (SELECT review_id FROM updates)""",
        _UPDATES,
    ),
)
def _(spark, sf):
    store = TableStore(spark, new_path(spark, "store"))
    store.commit("reviews", reviews_v(spark, sf))
    store.upsert("reviews", materialize(latest(review_updates_v(spark, sf), "review_id", "seq"), "updates"))
    return store.read("reviews").drop("shard")


@query(
    "snk2_upsert_counts",
    with_views(
        """SELECT (SELECT count(*) FROM updates) + (SELECT count(*) FROM labels) AS rows_in,
                  (SELECT count(*) FROM updates WHERE review_id NOT IN (SELECT review_id FROM reviews_v)) AS rows_new""",
        _UPDATES,
    ),
)
def _(spark, sf):
    return upsert_counts(reviews_v(spark, sf), review_updates_v(spark, sf), "review_id")


@query("w8_latest_version", with_views("SELECT * FROM updates", _UPDATES))
def _(spark, sf):
    return latest(review_updates_v(spark, sf), "review_id", "seq")


_CUSTOMER_PLACES = f"""
more AS (
  SELECT cast(c_custkey AS varchar) AS place_id, c_name AS name, c_mktsegment AS address, c_acctbal AS rating,
         NULL::integer AS review_count, '' AS maps_url, 'customer' AS category, '{STAMP}' AS scraped_at FROM customer)"""


def customer_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("place_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("address"),
        F.col("c_acctbal").alias("rating"),
        F.lit("customer").alias("category"),
    )
    return conform(rows, PLACES, F.lit(STAMP))


@query(
    "snk1_upsert_places",
    with_views(
        """SELECT * FROM places_v UNION ALL
           SELECT * FROM more WHERE place_id NOT IN (SELECT place_id FROM places_v)""",
        _CUSTOMER_PLACES,
    ),
)
def _(spark, sf):
    store = TableStore(spark, new_path(spark, "store"))
    store.commit("places", customer_places(spark, sf))
    store.upsert("places", materialize(places_v(spark, sf), "updates"))
    return store.read("places").drop("shard")


@query(
    "j9_not_stored",
    with_views(
        "SELECT * FROM more WHERE place_id NOT IN (SELECT place_id FROM places_v)", _CUSTOMER_PLACES
    ),
)
def _(spark, sf):
    return not_stored(customer_places(spark, sf), places_v(spark, sf), "place_id")


@query(
    "u3_union_versions",
    with_views("SELECT * FROM places_v UNION ALL SELECT * FROM more", _CUSTOMER_PLACES),
)
def _(spark, sf):
    return conform(places_v(spark, sf), PLACES).unionByName(customer_places(spark, sf))


@query("a10_place_ids", with_views("SELECT DISTINCT place_id FROM reviews_v"))
def _(spark, sf):
    return place_ids(reviews_v(spark, sf))


_LAST_ENTRY = """
imported AS (
  SELECT * FROM first_in_entry QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq DESC) = 1)"""


@query(
    "q1_import_reviews",
    with_views(
        f"SELECT * EXCLUDE (list_no, pos, seq), '{STAMP}' AS scraped_at FROM imported",
        ENTRIES,
        _FIRST_IN_ENTRY,
        _LAST_ENTRY,
    ),
)
def _(spark, sf):
    store = TableStore(spark, new_path(spark, "store"))
    ingest.import_into(store, raw_entries(spark, sf), F.lit(STAMP))
    # a second import of the same entries changes nothing
    ingest.import_into(store, raw_entries(spark, sf), F.lit(STAMP))
    return store.read("reviews").drop("shard")


@query(
    "q1_import_places",
    with_views(
        f"""SELECT o.place_id, coalesce(p.name, '') AS name, coalesce(p.address, '') AS address, p.rating, p.review_count,
                  coalesce(p.maps_url, '') AS maps_url, coalesce(p.category, '') AS category, '{STAMP}' AS scraped_at
           FROM (SELECT DISTINCT place_id FROM occ) o LEFT JOIN places_v p ON o.place_id = p.place_id""",
        ENTRIES,
    ),
)
def _(spark, sf):
    entries = raw_entries(spark, sf)
    none = places_v(spark, sf).limit(0), conform(reviews_v(spark, sf), REVIEWS).limit(0)
    places, _, _ = ingest.import_entries(entries, *none, F.lit(STAMP))
    return places


@query(
    "q6_import_and_index",
    with_views(
        r"""SELECT term, doc_id, count(*) AS tf FROM (
             SELECT review_id AS doc_id, unnest(regexp_extract_all(lower(concat_ws(' | ', nullif(place_name, ''),
                      'rating ' || rating || '/5', nullif(published_date, ''), text,
                      'owner response: ' || nullif(owner_response, ''))), '[\p{L}\p{N}]+')) AS term
             FROM imported) GROUP BY ALL""",
        ENTRIES,
        _FIRST_IN_ENTRY,
        _LAST_ENTRY,
    ),
)
def _(spark, sf):
    store = TableStore(spark, new_path(spark, "store"))
    _, index = ingest.import_and_index(store, raw_entries(spark, sf), new_path(spark, "index"), F.lit(STAMP))
    return index.postings.filter(F.col("term") != "").select("term", "doc_id", "tf")

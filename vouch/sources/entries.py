"""Listing result files: JSON documents or one JSON object per line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouch.functions.json import field, first_truthy, is_object, number, pick, strict_parse, truthy
from vouch.functions.ids import content_review_id, entry_link, entry_place_id
from vouch.functions.text import let, or_null, strip
from vouch.session import materialize
from vouch.sources.lists import file_ranges, list_items

# Fields that may hold reviews, better ones first.
REVIEW_LISTS = ("user_reviews_extended", "UserReviewsExtended", "user_reviews", "UserReviews")


# A JSON list of this many characters that cannot be parsed as a whole is reported, as the
# engine's limit of 128 MB for one value may be the cause.
LARGE_LIST = 64 << 20
# The engine's limit for one value, in bytes.
LARGEST_VALUE = 128 << 20


def _last_key_wins(df: DataFrame) -> None:
    """A repeated key in a JSON object keeps its last value, whoever made the session."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def entries_from_lines(lines: DataFrame) -> DataFrame:
    """Entries from a ``seq, line`` table; blank, broken and non-object lines are skipped."""
    _last_key_wins(lines)
    objects = lines.select("seq", strip(F.col("line")).alias("line")).filter(
        F.col("line").startswith("{")
    )
    return objects.select("seq", F.explode(strict_parse(F.col("line"))).alias("entry"))


def entries_from_documents(documents: DataFrame) -> DataFrame:
    """Entries from a ``seq, body`` table of whole files.

    A file that is one JSON list gives its objects, one that is a JSON object gives
    itself; any other file is read line by line.  A long list that cannot be parsed raises.
    """
    _last_key_wins(documents)
    values = documents.select(
        "seq", "body", F.explode_outer(strict_parse(strip(F.col("body")))).alias("doc")
    )
    kind = F.schema_of_variant("doc")
    line = lambda text: F.when(text.startswith("{"), F.get(strict_parse(text), F.lit(0)))
    lines = F.transform(F.split("body", r"\R"), lambda text: line(strip(text)))
    too_large = F.lit("a JSON list is broken or too large to be read as one value: give one object per line")
    # every file as a list, so that one pass and one explode serve all kinds
    listed = values.select(
        "seq",
        F.when(kind.startswith("ARRAY"), F.col("doc"))
        .when(kind.startswith("OBJECT"), F.to_variant_object(F.array("doc")))
        .when((F.length("body") > LARGE_LIST) & strip(F.col("body")).startswith("["), F.raise_error(too_large))
        .otherwise(F.to_variant_object(lines))
        .alias("items"),
    )
    # yields the elements one by one, where a cast would build an array of them all
    items = listed.sparkSession.tvf.variant_explode(F.col("items").outer())
    return (
        listed.lateralJoin(items)
        .filter(is_object(F.col("value")))
        .select(F.struct("seq", "pos").alias("seq"), F.col("value").alias("entry"))
    )


def _entries_of_any(spark: SparkSession, path: str | list[str]) -> DataFrame:
    ranges = materialize(file_ranges(spark, path), "ranges")
    listed = (F.col("first") == "[") & F.col("balanced")
    # a file of one object is one value, a larger file cannot be one
    single = (F.col("first") == "{") & (F.col("bytes") <= LARGEST_VALUE)
    kind = F.when(listed, "list").when(single, "document").otherwise("lines")
    files = ranges.select("file", "bytes", "block", kind.alias("kind"))
    kinds = {r.kind for r in files.select("kind").distinct().collect()}
    where = lambda *names: F.struct(*[F.col(c).cast(t).alias(n) for c, t, n in names]).alias("seq")
    found, by_line = [], files.filter("kind = 'lines'").select("file").distinct()
    if "list" in kinds:
        _last_key_wins(ranges)
        items = list_items(spark, path, ranges.filter(listed))
        broken = materialize(items.filter(F.col("items").isNull()).select("file").distinct(), "broken")
        by_line = by_line.unionByName(broken)
        elements = spark.tvf.variant_explode(F.col("items").outer())
        found.append(
            items.join(broken, "file", "left_anti")
            .lateralJoin(elements)
            .filter(is_object(F.col("value")))
            .select(where(("file", "string", "file"), ("block", "long", "block"), ("no", "long", "row"), ("pos", "long", "pos")), F.col("value").alias("entry"))
        )
    if "document" in kinds:
        bodies = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("seq"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("body")
        )
        chosen = files.filter("kind = 'document'").select(F.col("file").alias("seq")).distinct()
        whole = entries_from_documents(bodies.filter(F.col("bytes") <= LARGEST_VALUE).drop("bytes").join(chosen, "seq", "left_semi"))
        zero = whole.withColumn("zero", F.lit(0))
        found.append(
            zero.select(where(("seq.seq", "string", "file"), ("zero", "long", "block"), ("zero", "long", "row"), ("seq.pos", "long", "pos")), "entry")
        )
    if "lines" in kinds or (kinds & {"list"} and not broken.isEmpty()):
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value"),
        )
        # the reader ends lines at newlines, a document also at the rarer marks
        cut = lines.join(by_line, "file", "left_semi").select("file", "block", "row", F.posexplode(F.split("value", r"\R")).alias("pos", "line"))
        found.append(
            entries_from_lines(
                cut.select(where(("file", "string", "file"), ("block", "long", "block"), ("row", "long", "row"), ("pos", "long", "pos")), "line")
            )
        )
    if not found:
        return entries_from_lines(spark.createDataFrame([], "seq struct<file:string,block:long,row:long,pos:long>, line string"))
    return reduce(DataFrame.unionByName, found)


def load_entries(spark: SparkSession, path: str | list[str], format: str = "auto") -> DataFrame:
    """Entries ``seq, entry`` of the files under ``path``.

    ``ndjson`` reads splittable files line by line, the form for large inputs.
    ``auto`` decides per file, as ``entries_from_documents`` does.  A list is read by as many tasks as it has byte ranges
    and may have any size, its elements up to 128 MB; a broken one is read line by line, whatever its size.  The files are read
    once to tell their kinds and once more for each kind among them.
    """
    if format == "ndjson":
        lines = spark.read.text(path).select(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("seq"),
            F.col("value").alias("line"),
        )
        return entries_from_lines(lines)
    if format == "auto":
        return _entries_of_any(spark, path)
    raise ValueError(f"unknown format {format!r}")


def _numbered(items: Column, list_no: int) -> Column:
    return F.transform(
        F.coalesce(items, F.array().cast("array<variant>")),
        lambda item, pos: F.struct(
            F.lit(list_no).alias("list_no"), pos.alias("pos"), item.alias("item")
        ),
    )


def _first(value: Column, *keys: str) -> Column:
    return F.coalesce(*[or_null(field(value, key)) for key in keys], F.lit(""))


def _review(numbered: Column, place_id: Column) -> Column:
    """The normalised fields of one raw review object, NULL if it is no object."""

    def normalised(item: Column) -> Column:
        when = F.coalesce(
            *[truthy(item, key) for key in ("When", "when", "date", "published_date")], F.lit("")
        )
        rating = F.when(pick(item, "Rating").isNotNull(), field(item, "Rating", "int")).otherwise(
            field(item, "rating", "int")
        )
        return F.struct(
            numbered["list_no"].alias("list_no"),
            numbered["pos"].alias("pos"),
            strip(_first(item, "Description", "description", "text", "body")).alias("text"),
            rating.alias("rating"),
            when.alias("published_date"),
            _first(item, "Name", "name", "reviewer_name").alias("reviewer_name"),
            F.coalesce(truthy(item, "OwnerResponse"), truthy(item, "owner_response")).alias(
                "owner_response"
            ),
        )

    def identified(review: Column) -> Column:
        made = content_review_id(
            place_id, review["text"], review["reviewer_name"], review["published_date"]
        )
        return F.struct(made.alias("review_id"), *[review[c].alias(c) for c in _REVIEW_FIELDS])

    return F.when(is_object(numbered["item"]), let(normalised(numbered["item"]), identified))


_REVIEW_FIELDS = (
    "list_no",
    "pos",
    "text",
    "rating",
    "published_date",
    "reviewer_name",
    "owner_response",
)


def parsed_entries(entries: DataFrame) -> DataFrame:
    """One row per entry: ``seq``, the place columns and the list ``reviews``.

    Everything an import needs of an entry, so that the raw text is parsed once.
    Reviews are in the order of lists and positions; blank ones are left out, repeats
    are still in.
    """
    entry = F.col("entry")
    text = lambda *keys: F.coalesce(first_truthy(entry, *keys), F.lit(""))
    lists = F.concat(
        *[
            _numbered(field(entry, key, "array<variant>"), list_no)
            for list_no, key in enumerate(REVIEW_LISTS)
        ]
    )
    placed = entries.select(
        "seq",
        entry_place_id(entry).alias("place_id"),
        text("title", "Title").alias("name"),
        text("address", "Address").alias("address"),
        number(entry, "double", "review_rating", "ReviewRating").alias("rating"),
        number(entry, "int", "review_count", "ReviewCount").alias("review_count"),
        entry_link(entry).alias("maps_url"),
        text("category", "Category").alias("category"),
        lists.alias("items"),
    )
    reviews = F.filter(
        F.transform("items", lambda item: _review(item, F.col("place_id"))),
        lambda review: F.length(review["text"]) > 0,
    )
    return placed.withColumn("reviews", reviews).drop("items")


def _parsed(entries: DataFrame) -> DataFrame:
    return entries if "reviews" in entries.columns else parsed_entries(entries)


def entry_places(entries: DataFrame) -> DataFrame:
    """One place row per entry, raw or parsed, with its ``seq``."""
    return _parsed(entries).drop("reviews")


def entry_reviews(entries: DataFrame) -> DataFrame:
    """Review rows of all entries, raw or parsed, repeats still in."""
    return _parsed(entries).select(
        "seq", "place_id", F.col("name").alias("place_name"), F.inline("reviews")
    )


def review_items(entries: DataFrame) -> DataFrame:
    """The raw review objects: ``seq, place_id, place_name, list_no, pos, item``."""
    entry = F.col("entry")
    lists = [
        _numbered(field(entry, key, "array<variant>"), list_no)
        for list_no, key in enumerate(REVIEW_LISTS)
    ]
    named = entries.select(
        "seq",
        entry_place_id(entry).alias("place_id"),
        F.coalesce(first_truthy(entry, "title", "Title"), F.lit("")).alias("place_name"),
        "entry",
    )
    items = named.select("seq", "place_id", "place_name", F.inline(F.concat(*lists)))
    return items.filter(is_object(F.col("item")))

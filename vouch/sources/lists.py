"""Large JSON lists in files, read by many tasks.

A file is cut at its closing braces, so that any byte range of it can be read alone.  Each piece tells how far it turns
the quotes and the depth of brackets; running sums per range, then over the ranges of a file, give the depth at each
piece, and a brace that leads back to depth one ends an element of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, WindowSpec, functions as F

from vouch.functions.json import strict_parse
from vouch.functions.text import strip
from vouch.session import materialize


def _in_range() -> WindowSpec:
    return W.partitionBy("file", "block").orderBy("row")


def _earlier(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(W.unboundedPreceding, -1)


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _depth(marks: Column) -> Column:
    """Brackets opened less those closed outside of strings, where ``marks`` starts outside of one."""
    bare = F.regexp_replace(marks, '"[^"]*("|$)', "")
    return _count(bare, "[{") - _count(bare, "]}")


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text up to each closing brace, with its turns of quotes and depth for either state at its start."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("piece"),
    )
    # quotes and brackets alone, without escaped characters: a short text for all that follows
    marks = F.regexp_replace("piece", r'(?s)\\.|[^"\\\[\]{}]+|\\$', "")
    quotes = _count(F.col("marks"), '"')
    # the brace that ended the piece closes one level where it is outside of a string
    closes = lambda inside: F.when((quotes + inside) % 2 == 0, 1).otherwise(0)
    return read.withColumn("marks", marks).select(
        "file",
        "block",
        "bytes",
        "row",
        "piece",
        quotes.alias("quotes"),
        (_depth(F.col("marks")) - closes(0)).alias("from_outside"),
        (_depth(F.concat(F.lit('"'), "marks")) - closes(1)).alias("from_inside"),
    )


def _turned(pieces: DataFrame) -> DataFrame:
    """With ``odd``: quotes before the piece in its range, modulo two."""
    return pieces.withColumn("odd", F.coalesce(F.sum("quotes").over(_earlier(_in_range())), F.lit(0)) % 2)


def _pick(odd: Column) -> Column:
    return F.when(odd == 0, F.col("from_outside")).otherwise(F.col("from_inside"))


def file_ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per range of a file: ``file, block, bytes``, the file's first character ``first``, whether it ends as a list
    (``balanced``), its last range, and the state where the range starts (``inside`` a string, ``depth``)."""
    narrow = _pieces(spark, path).select(
        "file", "block", "bytes", "row", "quotes", "from_outside", "from_inside",
        (F.octet_length("piece") + 1).cast("long").alias("octets"),
        F.regexp_extract("piece", r"(?U)\S", 0).alias("mark"),
    )
    totals = (
        _turned(narrow)
        .groupBy("file", "block")
        .agg(
            F.max("bytes").alias("bytes"),
            F.sum("octets").alias("octets"),
            (F.sum("quotes") % 2).alias("quotes"),
            F.sum(_pick(F.col("odd"))).alias("from_outside"),
            F.sum(_pick(1 - F.col("odd"))).alias("from_inside"),
            F.min(F.when(F.col("mark") != "", F.struct("row", "mark"))).alias("mark"),
        )
    )
    whole = W.partitionBy("file")
    in_order = whole.orderBy("block")
    earlier = _earlier(in_order)
    state = totals.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    state = state.withColumn("depth", F.coalesce(F.sum(_pick(F.col("inside"))).over(earlier), F.lit(0)))
    # the last piece has no brace after it, unless the file ends with one; a byte order mark is not read
    spare = F.sum("octets").over(whole) - F.col("bytes")
    ends_open = ~spare.isin(0, -3)
    return state.select(
        "file",
        "block",
        "bytes",
        "inside",
        "depth",
        F.first("mark.mark", ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("first"),
        (ends_open & (F.sum("quotes").over(whole) % 2 == 0) & (F.sum(_pick(F.col("inside"))).over(whole) == -1)).alias("balanced"),
        F.max("block").over(whole).alias("last_block"),
    )


def _fragments(spark: SparkSession, path: str | list[str], ranges: DataFrame) -> DataFrame:
    """Texts of the elements, cut where ranges meet: ``file, block, no, row, closed, text``."""
    starts = ranges.select("file", "block", "inside", "depth", "last_block")
    turned = _turned(_pieces(spark, path).join(starts, ["file", "block"]))
    state = (F.col("inside") + F.col("odd")) % 2
    last = F.lead("row").over(_in_range()).isNull() & (F.col("block") == F.col("last_block"))
    deep = turned.withColumn("state", state).withColumn("last", last)
    deep = deep.withColumn("depth", F.col("depth") + F.sum(_pick(F.col("state"))).over(_in_range()))
    outside = (F.col("state") + F.col("quotes")) % 2 == 0
    ended = deep.withColumn("ends", outside & (F.col("depth") == 1) & ~F.col("last"))
    numbered = ended.withColumn("no", F.coalesce(F.sum(F.col("ends").cast("int")).over(_earlier(_in_range())), F.lit(0)))
    part = F.struct("row", F.when(F.col("last"), F.col("piece")).otherwise(F.concat("piece", F.lit("}"))).alias("piece"))
    return (
        numbered.groupBy("file", "block", "no")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("ends").alias("closed"))
        .select("file", "block", "no", "closed", F.array_join("parts.piece", "").alias("text"))
    )


def _chunks(fragments: DataFrame) -> DataFrame:
    """Whole elements ``file, block, no, text, head, tail``; at most two fragments of a range are put together."""
    edge = (F.col("no") == 0) | ~F.col("closed")
    whole = fragments.filter(~edge).select("file", "block", "no", "text", F.lit(False).alias("head"), F.lit(False).alias("tail"))
    before = _earlier(W.partitionBy("file").orderBy("block", "no"))
    chunk = F.coalesce(F.sum(F.col("closed").cast("int")).over(before), F.lit(0))
    joined = (
        fragments.filter(edge)
        .withColumn("chunk", chunk)
        .groupBy("file", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("block", "no", "text"))).alias("parts"), F.max("closed").alias("closed"))
    )
    return whole.unionByName(
        joined.select(
            "file",
            F.col("parts")[0]["block"].alias("block"),
            F.col("parts")[0]["no"].alias("no"),
            F.array_join("parts.text", "").alias("text"),
            (F.col("chunk") == 0).alias("head"),
            (~F.col("closed")).alias("tail"),
        )
    )


def list_items(spark: SparkSession, path: str | list[str], ranges: DataFrame) -> DataFrame:
    """``file, block, no, items`` of the lists in ``ranges``, in order; ``items`` is NULL where the list is broken.

    An element and the plain values before it are parsed together.  The engine's limit for one value holds for an
    element, not for the list.
    """
    chunks = _chunks(materialize(_fragments(spark, path, ranges), "list"))
    text = strip(F.col("text"))
    opened = F.when(~F.col("head"), text).when(text.startswith("["), F.substr(text, F.lit(2)))
    inner = F.when(~F.col("tail"), opened).when(opened.endswith("]"), F.left(opened, F.length(opened) - 1))
    body = strip(inner)
    # between elements stands one comma; after the last one there may be none
    rest = strip(F.substr(body, F.lit(2)))
    values = (
        F.when(F.col("head") | (F.col("tail") & (body == "")), body)
        .when(body.startswith(",") & (rest != ""), rest)
    )
    # a list inside a list, so that what follows a first complete value makes the parser fail
    items = F.get(strict_parse(F.concat(F.lit("["), values, F.lit("]"))), F.lit(0))
    return chunks.select("file", "block", "no", items.alias("items"))

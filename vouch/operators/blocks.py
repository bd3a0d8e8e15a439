"""Elements of stored pages, from their start tag to the end tag that closes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# A page in pieces: comments, scripts and styles whole, tags with their quoted attributes, and text.
PIECE = (
    r"""(?si)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>"""
    r"""|<(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>|[^<]+|<"""
)
NAME = "^</?([a-zA-Z][a-zA-Z0-9-]*)"

# Elements that hold text or others that do, and those that end where the next one of their name starts.
ELEMENTS = (
    "article aside blockquote dd div dl dt figcaption footer h1 h2 h3 h4 header li main nav ol option p section"
    " span table td th title tr ul"
).split()
NO_NESTING = ("dd", "dt", "option", "p", "td", "th")


def page_tags(pages: DataFrame, names: list[str]) -> DataFrame:
    """``page_id, name, start, stop, sign``: the tags of some names, by place, with 1 for a start, -1 for an end, 0 for both.

    Names are lower-cased.  Tags in comments, scripts, styles and attributes are none.
    """
    pieces = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(PIECE), 0)).alias("pos", "piece"))
    stop = F.sum(F.length("piece")).over(W.partitionBy("page_id").orderBy("pos"))
    placed = pieces.select(
        "page_id",
        F.lower(F.regexp_extract("piece", NAME, 1)).alias("name"),
        (stop - F.length("piece")).alias("start"),
        stop.alias("stop"),
        F.when(F.col("piece").startswith("</"), -1).when(F.col("piece").endswith("/>"), 0).otherwise(1).alias("sign"),
    )
    return placed.filter(F.col("name").isin(list(names)))


def element_blocks(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``page_id, block_pos, name, html``: every element of the given names, in the order of their start tags.

    An element reaches to the end tag of its own depth among those of its name, so that it holds nested ones whole and
    ends where it ends; elements that do not nest end with their end tag or before the next start tag of the name.  One that is never
    closed reaches to the end of the page.  Each page is a group of its own, as large as its number of tags.
    """
    tags = page_tags(pages, list(names or ELEMENTS))
    by_name = W.partitionBy("page_id", "name").orderBy("start")
    depth = F.sum("sign").over(by_name)
    tags = tags.withColumn("level", F.when(F.col("sign") < 0, depth + 1).otherwise(depth))
    following = F.lead(F.when(F.col("sign") < 0, F.col("stop")).otherwise(F.col("start")))
    single = F.col("name").isin(*NO_NESTING)
    of_level = W.partitionBy("page_id", "name", "level", F.col("sign") == 0).orderBy("start")
    reach = (
        F.when(F.col("sign") == 0, F.col("stop"))
        .when(single, following.over(by_name))
        .otherwise(F.lead("stop").over(of_level))
    )
    opened = tags.withColumn("reach", reach).filter("sign >= 0")
    order = F.row_number().over(W.partitionBy("page_id").orderBy("start")) - 1
    spans = opened.select("page_id", order.alias("block_pos"), "name", "start", "reach")
    html = F.substring("html", F.col("start") + 1, F.coalesce(F.col("reach"), F.length("html")) - F.col("start"))
    return pages.select("page_id", "html").join(spans, "page_id").select("page_id", "block_pos", "name", html.alias("html"))

"""Identifiers of places and reviews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vouch.functions.json import first_truthy
from vouch.functions.text import or_null, strip

# Formats of identifiers inside links.
LINK_HEX_PAIR = r"(?i)1s(0x[0-9a-f]+:0x[0-9a-f]+)"
URL_HEX_PAIR = r"(?i)!1s(0x[0-9a-f]+:0x[0-9a-f]+)"
URL_DATA_ID = r"/place/[^/]+/(@[^/]+/)?data=![^!]*!1s([^!]+)"
UNKNOWN_PLACE = "unknown"
HASH_PREFIX = "link_"
SLUG_PREFIX = "slug_"
SITE = "https://www.google.com"
PLACE_LINK = "https://www.google.com/maps/place/?q=place_id:"

_HASH_RANGE = 10**12


def entry_link(entry: Column) -> Column:
    return F.coalesce(first_truthy(entry, "link", "Link"), F.lit(""))


def link_hash_id(link: Column) -> Column:
    """Stable id of a place known only by its link."""
    return F.concat(F.lit(HASH_PREFIX), F.pmod(F.xxhash64(link), F.lit(_HASH_RANGE)).cast("string"))


def entry_place_id(entry: Column) -> Column:
    link = entry_link(entry)
    return F.coalesce(
        first_truthy(entry, "place_id", "PlaceID", "cid", "Cid"),
        or_null(F.regexp_extract(link, LINK_HEX_PAIR, 1)),
        F.when(link != "", link_hash_id(link)),
        F.lit(UNKNOWN_PLACE),
    )


def content_review_id(place_id: Column, text: Column, reviewer: Column, date: Column) -> Column:
    """``place::`` and 16 hex digits of the hash of who said what when."""
    body = F.concat_ws("|", place_id, reviewer, date, F.substring(text, 1, 500))
    return F.concat(place_id, F.lit("::"), F.substring(F.sha2(body, 256), 1, 16))


def source_review_id(place_id: Column, source_id: Column) -> Column:
    return F.concat(place_id, F.lit("::"), source_id)


def url_place_id(url: Column) -> Column:
    """Place id written in a maps link, NULL when there is none."""
    return F.coalesce(
        or_null(F.regexp_extract(url, URL_HEX_PAIR, 1)),
        or_null(F.regexp_extract(url, URL_DATA_ID, 2)),
    )


def bare_place_id(raw: Column) -> Column:
    return F.regexp_replace(raw, "^places/", "")


def absolute_href(href: Column, site: str = SITE) -> Column:
    link = strip(F.coalesce(href, F.lit("")))
    return (
        F.when(link.startswith("//"), F.concat(F.lit(site.split("//")[0]), link))
        .when(link.startswith("/"), F.concat(F.lit(site), link))
        .otherwise(link)
    )


def slug_id(url: Column) -> Column:
    segment = F.substring_index(F.substring_index(url, "/place/", -1), "/", 1)
    # a percent sign that starts no escape stays as it is
    escaped = F.regexp_replace(segment, "%(?![0-9A-Fa-f]{2})", "%25")
    words = F.substring(F.replace(F.try_url_decode(escaped), F.lit("+"), F.lit(" ")), 1, 80)
    slug = F.lower(F.btrim(F.regexp_replace(words, "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.concat(F.lit(SLUG_PREFIX), F.substring(slug, 1, 48))


def listing_id(url: Column) -> Column:
    return F.coalesce(url_place_id(url), slug_id(url))


def id_kind(place_id: Column) -> Column:
    """Which discovery route an id came from."""
    return (
        F.when(place_id == UNKNOWN_PLACE, "unknown")
        .when(place_id.startswith(SLUG_PREFIX), "slug")
        .when(place_id.startswith(HASH_PREFIX), "link_hash")
        .when(place_id.rlike("^(?i)0x[0-9a-f]+:0x[0-9a-f]+$"), "hex_pair")
        .when(place_id.rlike("^[0-9]+$"), "cid")
        .otherwise("api")
    )


def default_link(url: Column, place_id: Column, prefix: str = PLACE_LINK) -> Column:
    return F.coalesce(or_null(url), F.concat(F.lit(prefix), or_null(place_id)), F.lit(""))

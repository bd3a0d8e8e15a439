"""Functions on literals, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from vouch.functions import display, ids, listing
from vouch.functions.text import preview, snippet, squash, strip
from vouch.operators.exact import has_variant
from vouch.operators.queries import expand


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def strings(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "query, synonyms, wanted",
    [
        ("aqua k lenses", [], ["aqua k lenses", "aqua-k-lenses", "aquaklenses"]),
        ("  Keyboard   REPAIR ", [], ["keyboard repair", "keyboard-repair", "keyboardrepair"]),
        ("aqua-k", [], ["aqua-k"]),
        ("a", ["  ", "B c", "a"], ["a", "b c", "b-c", "bc"]),
        ("", [], []),
    ],
)
def test_variants(spark, query, synonyms, wanted):
    assert value(spark, expand(F.lit(query), strings(*synonyms))) == wanted


def test_strip_and_squash(spark):
    assert value(spark, strip(F.lit(" 　\t a b \n\x1f"))) == "a b"
    assert value(spark, squash(F.lit(" A  B\n c "))) == "a b c"


def cut(spark, text, *variants):
    return value(spark, snippet(F.lit(text), strings(*variants)))


def test_snippet_around_a_hit(spark):
    a = "a" * 600
    assert cut(spark, a + "foo" + a, "foo") == "…" + "a" * 220 + "foo" + "a" * 220 + "…"
    # two variants at one place: the first in order sets the right edge
    assert len(cut(spark, a + "foo" + a, "fo", "foo")) == 444
    assert cut(spark, "x\nFOO y", "foo") == "x FOO y"


def test_snippet_without_a_hit(spark):
    assert cut(spark, "b" * 441, "zzz") == "b" * 440 + "…"
    assert cut(spark, "b" * 440, "zzz") == "b" * 440
    assert cut(spark, "  b\nc ") == "b c"


def test_preview(spark):
    assert value(spark, preview(F.lit("a\nb"))) == "a b"
    assert value(spark, preview(F.lit("a" * 201))) == "a" * 200 + "…"


def test_wildcards(spark):
    text = F.lit("50% off a_b \\ x")
    assert value(spark, has_variant(text, F.lit("0%f")) | F.lit(False)) is False
    assert value(spark, has_variant(text, F.lit("0%f"), wildcards=True)) is True
    assert value(spark, has_variant(text, F.lit("\\ x"), wildcards=True)) is True


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("https://x/place/a/data=!4m2!1s0xAb:0xCd!8", "0xAb:0xCd"),
        ("https://x/place/a+b/@1,2,3z/data=!3m1!1sChIJ_x-1!9", "ChIJ_x-1"),
        ("https://x/place/a/data=!3m1!1sChIJ", "ChIJ"),
        ("https://x/place/a", None),
    ],
)
def test_url_place_id(spark, url, wanted):
    assert value(spark, ids.url_place_id(F.lit(url))) == wanted


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("https://x/maps/place/Joe%27s+Caf%C3%A9/@1,2", "slug_joe_s_caf"),
        ("https://x/place/100%+off+%zz/x", "slug_100_off_zz"),
        ("https://x/place/" + "a" * 60, "slug_" + "a" * 48),
    ],
)
def test_slug_id(spark, url, wanted):
    assert value(spark, ids.slug_id(F.lit(url))) == wanted


@pytest.mark.parametrize(
    "href, wanted",
    [
        (" /maps/x ", "https://www.google.com/maps/x"),
        ("//host/x", "https://host/x"),
        ("http://a/b", "http://a/b"),
        ("", ""),
    ],
)
def test_absolute_href(spark, href, wanted):
    assert value(spark, ids.absolute_href(F.lit(href))) == wanted


def test_id_kinds(spark):
    kinds = {"unknown": "unknown", "slug_a": "slug", "link_1": "link_hash", "0xA:0xb": "hex_pair", "12": "cid", "ChIJ": "api"}
    for key, kind in kinds.items():
        assert value(spark, ids.id_kind(F.lit(key))) == kind


def test_link_hash_is_stable(spark):
    made = value(spark, ids.link_hash_id(F.lit("https://x")))
    assert made == value(spark, ids.link_hash_id(F.lit("https://x")))
    assert made.startswith("link_") and int(made[5:]) < 10**12


@pytest.mark.parametrize(
    "name, wanted",
    [("Joe's 4.5 stars 20 Reviews", "Joe's"), ("Five Stars Cafe", "Five Stars Cafe"), ("A 5 star", "A")],
)
def test_clean_name(spark, name, wanted):
    assert value(spark, listing.clean_name(F.lit(name))) == wanted


@pytest.mark.parametrize(
    "name, location, wanted",
    [
        ("Acme Eye Care Centre | Dr X", "Town", "Acme Eye Care Town"),
        ("A · B", "", "A"),
        ("A - B", " T ", "A T"),
        ("", "T", "T"),
    ],
)
def test_compact_query(spark, name, location, wanted):
    assert value(spark, listing.compact_query(F.lit(name), F.lit(location))) == wanted


def test_keys(spark):
    assert value(spark, listing.label_key(F.lit("Joe's Café, open"))) == "joescaf"
    assert value(spark, listing.stars(F.lit("4 stars of 5"))) == 4
    assert value(spark, listing.stars(F.lit("none"))) is None


def test_display(spark):
    assert value(spark, display.review_rating(F.lit(0))) == "—"
    assert value(spark, display.review_rating(F.lit(None).cast("int"))) == "—"
    assert value(spark, display.place_rating(F.lit(4.0))) == "4.0"
    hits = F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(2), F.lit("c"), F.lit(5))
    assert value(spark, display.mentions(hits)) == "c×5, a×2, b×2"
    meta = display.evidence_meta(F.lit(0), F.lit(""), F.lit("Ann"), F.lit(1.234))
    assert value(spark, meta) == "0/5 · Ann · bm25 1.23"

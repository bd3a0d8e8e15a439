"""Listing match and field extraction against a plain reading of the rules."""

import random
import re

from pyspark.sql import functions as F

from vouch.operators.blocks import element_blocks
from vouch.operators.extract import assemble_reviews, block_fields, cap_reviews, page_candidates
from vouch.operators.listings import first_listings, match_listings


def key(text):
    return re.sub(r"[^a-z0-9]", "", text.lower())


def plain_url(text):
    return text.split("?")[0].rstrip("/")


def place_of(listing, target):
    """How well a listing fits, smaller is better: (tier, -length of the common start, position).

    Tier 0: same link, or the id is in the link.  Tier 1: the first 12, 10 or 8 characters of one name are in
    the other.  Tier 2: neither.
    """
    (_, pos, label, href), (_, place_id, name, url) = listing, target
    linked = plain_url(url) not in ("", None) and plain_url(href) == plain_url(url)
    if linked or place_id and place_id in href:
        return (0, 0, pos)
    names = key(name), key(label.split(",")[0])
    common = [
        n for n in (8, 10, 12) if n <= min(map(len, names)) and any(x[:n] in y for x, y in (names, names[::-1]))
    ]
    return (1, -max(common), pos) if common else (2, 0, pos)


def test_match_equals_plain_rules(spark):
    random.seed(7)
    words = ["north", "mill", "harbour", "eye", "care", "shop", "opti"]
    name = lambda: " ".join(random.choices(words, k=random.randint(0, 4)))
    listings, targets = [], []
    for q in ("q1", "q2"):
        for pos in range(40):
            label = name() + random.choice([", open", "", " x"])
            listings.append((q, pos, label, f"https://h/place/{random.randint(1, 60)}/?x={pos}"))
        for i in range(60):
            url = random.choice(["", f"https://h/place/{random.randint(50, 70)}"])
            targets.append((q, f"{q}-{i}" if i % 3 else f"/{i + 5}/", name(), url))
    found = match_listings(
        spark.createDataFrame(targets, "query_id string, place_id string, name string, maps_url string"),
        spark.createDataFrame(listings, "query_id string, pos int, label string, href string"),
    )
    got = {(r.query_id, r.place_id): r.pos for r in found.collect()}
    wanted = {
        (t[0], t[1]): min(place_of(x, t) for x in listings if x[0] == t[0])[2] for t in targets
    }
    assert got == wanted


def test_match_plan_has_no_pairing_by_query_alone(spark):
    t = spark.createDataFrame([("q", "p", "n", "u")], "query_id string, place_id string, name string, maps_url string")
    x = spark.createDataFrame([("q", 1, "l", "h")], "query_id string, pos int, label string, href string")
    text = match_listings(t, x)._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_first_listings(spark):
    rows = [
        ("q", 1, "A 4.5 stars", "/maps/place/a"),
        ("q", 2, "Other", "https://www.google.com/maps/place/a"),
        ("q", 3, " 5 stars", "/maps/place/b"),
        ("q", 4, "B", "/maps/place/b"),
        ("q", 5, "C", ""),
        ("q", 6, "D", "/maps/place/d"),
        ("q", 7, "E", "/maps/place/e"),
    ]
    listings = spark.createDataFrame(rows, "query_id string, pos int, label string, href string")
    got = [(r.name, r.place_id) for r in first_listings(listings, 2).orderBy("rank").collect()]
    # the link of the nameless listing counts as seen
    assert got == [("A", "slug_a"), ("D", "slug_d")]


def fields_of(spark, *rows):
    made = spark.createDataFrame(
        [(1, b, f, rank, pos, t) for b, f, rank, pos, t in rows],
        "page_id int, block_pos int, field string, selector_rank int, pos int, text string",
    )
    return {r.block_pos: r for r in block_fields(made).collect()}


def test_field_rules(spark):
    got = fields_of(
        spark,
        (0, "name", 0, 0, "4 reviews"), (0, "name", 0, 1, "Not looked at"), (0, "name", 1, 0, " Ann "),
        (0, "text", 0, 0, " ok "), (0, "text", 1, 0, "fine text"),
        (0, "date", 0, 0, "x" * 80), (0, "date", 1, 0, "a day ago"),
        (0, "response", 0, 0, " "), (0, "response", 1, 0, "thanks"),
        (0, "rating", 0, 0, "stars"), (0, "rating", 1, 0, "4 of 5 stars"),
        (1, "name", 0, 0, "n" * 120),
        (1, "text", 0, 0, " a "),
        (1, "span", 0, 0, "long enough to count"), (1, "span", 0, 1, "long enough to pass!"),
        (1, "span", 0, 2, "this one is longest but shows a PHOTO of it"), (1, "span", 0, 3, "short"),
        (1, "span", 0, 40, "the forty first span is longer than all but not read"),
    )
    a, b = got[0], got[1]
    assert (a.reviewer_name, a.text, a.published_date, a.owner_response, a.rating) == ("Ann", "fine text", "a day ago", "thanks", 4)
    assert (b.reviewer_name, b.text, b.published_date, b.owner_response, b.rating) == ("", "long enough to count", "", None, None)


def test_assembly_and_cap(spark):
    fields = spark.createDataFrame(
        [(1, 0, "n", "t0", "", None, 3, "s0"), (1, 1, "n", "t1", "", None, 5, None), (1, 2, "n", " ", "", None, 1, "s2"), (1, 3, "n", "again", "", None, 4, "s0"), (1, 4, "n", "t4", "", None, None, "s4")],
        "page_id int, block_pos int, reviewer_name string, text string, published_date string, owner_response string, rating int, source_id string",
    )
    places = spark.createDataFrame([(1, "p", "P")], "page_id int, place_id string, name string")
    rows = assemble_reviews(fields, places)
    ids = lambda n, by: [r.review_id for r in cap_reviews(rows, n, by).orderBy("rank").collect()]
    assert ids(9, "relevant") == ["p::s0", "p::gen_1_2", "p::s4"]
    assert ids(2, "highest_rating") == ["p::gen_1_2", "p::s0"]
    assert ids(2, "lowest_rating") == ["p::s0", "p::gen_1_2"]
    assert [r.text for r in cap_reviews(rows, 1, "relevant").collect()] == ["t0"]
    stamped = rows.withColumn("scraped_at", F.when(F.col("review_id") == "p::s4", "2").otherwise("1"))
    assert cap_reviews(stamped, 1, "newest").first().review_id == "p::s4"


def test_capped_texts_are_not_aggregated(spark):
    rows = spark.createDataFrame(
        [(f"r{i % 30}", f"p{i % 3}", "n", f"t{i}", i % 5, "", (1, i)) for i in range(60)],
        "review_id string, place_id string, place_name string, text string, rating int, published_date string, pos struct<page_id: int, block_pos: int>",
    )
    got = cap_reviews(rows, 4, "highest_rating")
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    wanted = {}
    for r in sorted(rows.collect(), key=lambda r: r.pos)[:30]:
        wanted.setdefault(r.place_id, []).append(r)
    for place, listed in wanted.items():
        best = sorted(listed, key=lambda r: (-r.rating, r.pos))[:4]
        assert [(r.review_id, r.text) for r in got.filter(F.col("place_id") == place).orderBy("rank").collect()] == [(r.review_id, r.text) for r in best]


def test_reviews_of_several_blocks_and_pages(spark):
    html = "".join(f"<li><p>text {i} of it</p><i>{a}</i></li>" for i, a in enumerate(["2 months ago", "a day ago", "soon"]))
    pages = spark.createDataFrame([(1, html), (2, html), (3, "<p>none</p>")], "page_id int, html string")
    places = spark.createDataFrame([(n, "p", "P") for n in (1, 2, 3)], "page_id int, place_id string, name string")
    found = page_candidates(
        pages, [("text", 0, "<p>([^<]*)</p>"), ("date", 0, "<i>([^<]*)</i>")], block="<li>.*?</li>"
    )
    rows = assemble_reviews(block_fields(found), places)
    assert {r.review_id for r in rows.collect()} == {f"p::gen_{p}_{b}" for p in (1, 2) for b in (1, 2, 3)}
    newest = [r.text for r in cap_reviews(rows, 4).orderBy("rank").collect()]
    assert newest == ["text 1 of it"] * 2 + ["text 0 of it"] * 2


def test_nested_elements_end_where_they_end(spark):
    html = (
        '<div class="r" title="a > b </div>"><DIV>one <b>two</b></DIV><!-- </div> --><p>three<p>four</p>'
        "<script>var t = '</div>';</script><div/>five</div><div>open <ul><li>x<ul><li>y</li></ul></li></ul> 2 < 3"
    )
    pages = spark.createDataFrame([(1, html), (2, "</div><div>late</div>"), (3, ""), (4, None)], "page_id int, html string")
    rows = element_blocks(pages, ["div", "p", "li"]).orderBy("page_id", "block_pos").collect()
    first = html[: html.index("<div>open")]
    assert [(r.page_id, r.block_pos, r.name, r.html) for r in rows] == [
        (1, 0, "div", first),
        (1, 1, "div", "<DIV>one <b>two</b></DIV>"),
        (1, 2, "p", "<p>three"),
        (1, 3, "p", "<p>four</p>"),
        (1, 4, "div", "<div/>"),
        (1, 5, "div", html[len(first) :]),
        (1, 6, "li", "<li>x<ul><li>y</li></ul></li>"),
        (1, 7, "li", "<li>y</li>"),
        (2, 0, "div", "<div>late</div>"),
    ]
    long = spark.createDataFrame([(1, '<p a="' + "x'>" * 200_000 + '">' + "<b>" * 50_000 + "t</p>")], "page_id int, html string")
    assert element_blocks(long, ["p"]).select(F.length("html")).first()[0] == 750_013


def test_reviews_out_of_nested_blocks(spark):
    one = '<div class="review"><div><p>good {0} text</p></div><div class="meta"><i>{0} days ago</i></div></div>'
    html = "<div id='all'>" + "".join(one.format(i) for i in (3, 1, 2)) + "</div>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    reviews = element_blocks(pages, ["div"]).filter(F.col("html").startswith('<div class="review"'))
    found = page_candidates(
        reviews.select((F.col("block_pos") + 100).alias("page_id"), "html"),
        [("text", 0, "<p>([^<]*)</p>"), ("date", 0, "<i>([^<]*)</i>")],
    )
    got = {(r.text, r.published_date) for r in block_fields(found).collect()}
    assert got == {(f"good {i} text", f"{i} days ago") for i in (1, 2, 3)}

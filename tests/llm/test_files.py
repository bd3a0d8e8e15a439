"""Sharding, URL rules and WARC archives."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from vouch.llm.queries import ORACLES, RULES
from vouch.llm.sharding import balanced_shards
from vouch.llm.url_filter import judge_urls
from vouch.llm.warc import (
    RecordError,
    base32_sha1,
    build_record,
    pack_archive,
    parse_record,
    plan_records,
    read_archives,
    unpack_archive,
    write_archives,
)
from vouch.session import new_path

# --- sharding ----------------------------------------------------------------------------

SCHEMA = "doc_id bigint, text string, shard string, range int, size int"


def least_capacity(sizes, shards):
    def needed(capacity):
        used, left = 1, capacity
        for s in sizes:
            if s > left:
                used, left = used + 1, capacity
            left -= s
        return used

    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)


@pytest.mark.parametrize("hot", [0, 60])
def test_shards_are_the_best_contiguous_ones(spark, hot):
    rng = random.Random(hot)
    data = [(i, "é" * rng.randint(0, 90) if rng.random() < 0.9 else "same") for i in range(200)]
    data += [(500 + i, "hot text") for i in range(hot)] + [(None, "no id"), (None, None), (900, None), (900, None), (901, "")]
    rng.shuffle(data)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in data], SCHEMA).repartition(3)
    out = balanced_shards(df, 7).collect()
    assert len(out) == len(data)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, str(r.text_crc32)) for r in out) == sorted(
        (str(i), size(t), str(None if t is None else zlib.crc32(t.encode()))) for i, t in data
    )
    groups = {}
    for n, (i, t) in enumerate(data):
        groups.setdefault(("bare", n) if t is None else t, []).append((2**63 if i is None else i, size(t)))
    order = sorted(groups.values(), key=min)
    got = {}
    for r in out:
        got[r.shard] = got.get(r.shard, 0) + r.size
    assert max(got.values()) == least_capacity([sum(s for _, s in g) for g in order], 7)
    for shard in got:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    for text in {t for _, t in data if t}:
        assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(text.encode())}) == 1


def test_shards_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, 2)], SCHEMA)
    assert [(r.shard, r.slot) for r in balanced_shards(df, 16).collect()] == [(0, 0)]
    assert balanced_shards(df.limit(0), 16).collect() == []


def test_sharding_plan_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, 2)], SCHEMA)
    plan = balanced_shards(df, 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- URLs --------------------------------------------------------------------------------


def judged(spark, urls, labels=(), **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in urls], "page_id bigint, url string, host string")
    marks = spark.createDataFrame(list(labels), "id bigint, bad int")
    return {r.page_id: r for r in judge_urls(pages, marks, RULES, **more).collect()}


def test_rules_fit_hosts_subdomains_and_paths(spark):
    urls = [
        (1, "HTTP://A.Example.NET/en/1?x#y"), (2, "http://example.net/de"), (3, "http://example.com/de/x"),
        (4, "http://badexample.com/de/x"), (5, "http://a.org/fr/"), (6, "http://a.org/fr"), (7, "http://net"),
        (8, "http://x.net?q=/en/"), (9, None), (10, "no scheme/en"), (11, ""), (12, "x://h/a://b/c#d"), (13, "http://net/"),
    ]
    got = judged(spark, urls)
    assert {i: (r.host, r.path) for i, r in got.items()} == {
        1: ("a.example.net", "/en/1"), 2: ("example.net", "/de"), 3: ("example.com", "/de/x"),
        4: ("badexample.com", "/de/x"), 5: ("a.org", "/fr/"), 6: ("a.org", "/fr"), 7: ("net", ""), 8: ("x.net", ""),
        9: ("", ""), 10: ("", ""), 11: ("", ""), 12: ("h", "/a://b/c"), 13: ("net", "/"),
    }
    rules = {1: "example.net/en/", 2: "net/", 3: "example.com/de/", 5: "org/fr/", 13: "net/"}
    assert {i: r.rule for i, r in got.items()} == {i: rules.get(i) for i in got}
    blocked = {i for i, r in got.items() if r.verdict == "block"}
    assert blocked == {2, 3, 13}


def test_templates_split_where_labels_differ_and_merge_elsewhere(spark):
    urls = [(i, f"http://shop.example/{'ads' if i % 3 == 0 else 'items' if i % 3 == 1 else 'news'}/{i}.html") for i in range(600)]
    urls += [(1000 + i, f"http://wide.example/{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}") for i in range(200)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 600, 2)] + [(0, 0), (None, 1), (3, None)]
    got = judged(spark, urls + [(0, "http://shop.example/ads/77.html")], labels)
    assert len(got) == 800
    assert all((r.verdict == "block") == (i % 3 == 0) for i, r in got.items() if i < 600)
    assert {r.template.split("/")[0] for i, r in got.items() if i >= 1000} == {"*"}
    assert len({r.template for i, r in got.items() if i < 600}) <= 3


def test_a_bad_section_of_a_wide_host_keeps_its_template(spark):
    urls = [(i, f"http://wide.example/{chr(97 + i % 20)}{chr(97 + i // 20 % 2)}/{i}") for i in range(12_000)]  # 40 equal sections
    got = judged(spark, urls, [(i, int(i % 40 == 7)) for i in range(12_000)])
    assert all((r.verdict == "block") == (i % 40 == 7) for i, r in got.items())
    assert {r.template.split("/")[0] for i, r in got.items() if i % 40 == 7} == {"ha"}
    assert {r.template.split("/")[0] for i, r in got.items() if i % 40 != 7} == {"*"}


def test_like_sections_share_a_wildcard_and_sql_agrees(spark):
    # 40 sections: three all bad, two half bad, the others good; and odd rows
    bad = lambda i: 1 if i % 40 < 3 else i // 40 % 2 if i % 40 < 5 else 0
    name = lambda i: "abcdefgh"[i % 40 // 8] + "abcdefgh"[i % 8]
    urls = [(i, f"http://Wide.example/{name(i)}/x{i}/y") for i in range(12_000)]
    urls += [(None, "http://wide.example/aa/1"), (20_000, None), (20_001, "no scheme"), (20_002, "http://wide.example/" + "a/" * 9_000)]
    marks = [(i, bad(i)) for i in range(0, 12_000, 2)] + [(i, bad(i)) for i in range(1, 12_000, 4)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    labels = spark.createDataFrame(marks, "id bigint, bad int")
    rows = judge_urls(pages, labels, RULES).drop("purity")
    got = {r.page_id: r for r in rows.collect()}
    assert len({got[i].template.split("/")[0] for i in (0, 1, 2)}) == 1 and got[0].template.startswith("*9/")
    assert {got[i].template.split("/")[0] for i in range(5, 40)} <= {"*", "*0"}
    assert all(got[i].verdict == "block" for i in range(0, 12_000) if i % 40 < 3)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id bigint, url varchar)")
    connection.execute("CREATE TABLE labels (doc_id bigint, quality int, toxic int)")
    connection.register("given_urls", pages.toPandas())
    connection.register("given_marks", labels.toPandas())
    connection.execute("INSERT INTO pages SELECT page_id, url FROM given_urls")
    connection.execute("INSERT INTO labels SELECT id, 1, bad FROM given_marks")
    wanted = connection.execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLES['op6_url_filter']})").fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in rows.collect())


def test_urls_of_an_empty_table(spark):
    assert judged(spark, []) == {}


# --- WARC --------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, sha int, first string"


def test_pages_come_back_from_their_archives(spark):
    rng = random.Random(1)
    html = [f"<p>{'é' * rng.randint(0, 300)} {i % 9}</p>" for i in range(40)] + [None, "", "x" * 3_000_000]
    data = [(i * 3 % 43, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)]
    data += [(100 + i, None, "copy") for i in range(25)] + [(None, "u", "copy"), (100, "again", "copy")]
    pages = spark.createDataFrame([(*r, 1, "f") for r in data], PAGES).repartition(4)
    archives = write_archives(plan_records(pages), new_path(spark, "warc"))
    out = read_archives(archives).collect()
    assert len(out) == len(data) and all(r.error is None for r in out)
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in data:
        body, response = (h or "").encode(), first[h or ""] == i
        repeats = None if response else f"<urn:page:{first[h or '']}>"
        want.append((base32_sha1(body), len(body), "response" if response else "revisit", repeats, f"<urn:page:{i}>"))
    want.sort(key=str)
    assert sorted(((r.digest, r.bytes, r.type, r.refers_to, r.record_id) for r in out), key=str) == want
    payloads = {bytes(r.payload) for r in out if r.type == "response"}
    assert payloads == {(h or "").encode() for _, _, h in data}
    assert read_archives(archives.limit(0)).collect() == []


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(i, "u", t, 1, "f") for i, t in enumerate(["ab", "ab", "abc", "abc"])], PAGES)
    got = {r.page_id: r.first for r in plan_records(pages, min_bytes=3).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 2}


def record(payload=b"hello", first=None):
    return build_record(7, "http://h/", payload, base32_sha1(payload), first, "2024-01-01T00:00:00Z")


def test_records_are_validated():
    assert parse_record(record())["payload"] == b"hello"
    assert parse_record(record(first=3))["bytes"] == 5
    good = record()
    for bad in (
        good[:-4], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type: response\r\n", b""),
        good.replace(b"hello", b"jello"), good.replace(b"WARC-Date", b"WARC Date "), b"", b"WARC/1.1\r\n\r\n",
    ):
        with pytest.raises(RecordError):
            parse_record(bad)


def test_archives_have_a_frame_per_record_and_are_validated(spark):
    records = [record(bytes([65 + i]) * 500 * i) for i in range(20)]
    data = pack_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(unpack_archive(data)) == records
    for bad in (data[:-3], data + b"xyz", data[:200] + b"\x00\x01" + data[-900:]):
        with pytest.raises(RecordError):
            list(unpack_archive(bad))
    assert list(unpack_archive(b"")) == []
    path = f"{new_path(spark, 'broken')}.warc.zst"
    with open(path, "wb") as f:
        f.write(pack_archive([records[1], records[2].replace(b"CCC", b"CDC", 1), records[3]]))
    paths = spark.createDataFrame([(path,)], "path string")
    rows = {r.position: r.error for r in read_archives(paths, strict=False).collect()}
    assert rows[0] is None and rows[2] is None and "length" not in rows[1] and "digest" in rows[1]
    with pytest.raises(Exception, match="digest"):
        read_archives(paths).collect()

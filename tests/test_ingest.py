"""Reading result files, import and upsert."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vouch.operators.upsert import latest, newest_rows, numbered, upsert, upsert_counts
from vouch.plans.ingest import first_in_entry, import_and_index, import_entries, import_into, import_stats
from vouch.schemas import PLACES, REVIEWS, conform, empty
from vouch.session import new_path
from vouch.sources.entries import entries_from_lines, entry_places, entry_reviews, load_entries
from vouch.sources.listings import load_queries, places_from_pages, variant_list
from vouch.sources.tables import TableStore
from vouch.streaming.refresh import refresh


def entries_of(spark, *objects):
    lines = [(i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    return entries_from_lines(spark.createDataFrame(lines, "seq int, line string"))


def test_lines(spark):
    kept = entries_of(spark, {"title": "a"}, "", "  ", '{"a":1} x', "[1]", "3", '{"a":', ' {"title":"b"} ')
    assert [r.seq for r in kept.orderBy("seq").collect()] == [0, 7]


def test_files(spark, tmp_path):
    files = {
        "list.json": '[{"title":"a"}, 3, {"title":"b"}]',
        "one.json": '\n{"title":\n"c"}\n',
        "lines.json": '{"title":"d"}\n\nbad\n[1]\n{"title":"e"}\r\n{"title":"f"} x',
        "listlines.json": '[{"title":"x"}]\n{"title":"g"}',
        "empty.json": "",
        "scalar.json": "7",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    names = lambda df: sorted(r.name for r in entry_places(df).collect())
    assert names(load_entries(spark, str(tmp_path))) == ["a", "b", "c", "d", "e", "g"]
    assert names(load_entries(spark, str(tmp_path / "lines.json"), "ndjson")) == ["d", "e"]
    seqs = load_entries(spark, str(tmp_path / "lines.json"), "ndjson")
    ordered = [r.name for r in entry_places(seqs).orderBy("seq").collect()]
    assert ordered == ["d", "e"]


def test_place_fields(spark):
    rows = entry_places(
        entries_of(
            spark,
            {"review_rating": 0, "title": "", "Title": "T", "link": "l1s0xA:0xb!"},
            {"ReviewRating": 0, "review_count": "5", "cid": 12},
            {"review_count": 4.7, "place_id": 0, "Cid": "9"},
            {"review_count": "4.5", "link": "https://x"},
            {"place_id": "", "Link": ""},
        )
    ).orderBy("seq").collect()
    assert [r.rating for r in rows] == [None, 0.0, None, None, None]
    assert [r.review_count for r in rows] == [None, 5, 4, None, None]
    assert [r.place_id for r in rows[:3]] == ["0xA:0xb", "12", "9"]
    assert rows[3].place_id.startswith("link_") and rows[4].place_id == "unknown"
    assert rows[0].name == "T"


def test_review_fields_and_repeats(spark):
    entries = entries_of(
        spark,
        {
            "place_id": "p",
            "title": "P",
            "user_reviews": [
                {"Name": "x", "Description": " hi ", "Rating": 1},
                {"name": "y", "text": " "},
                3,
                {"name": "z", "body": "yo", "rating": "4.5", "date": "today", "owner_response": "thx"},
            ],
            "user_reviews_extended": [{"Name": "x", "Description": "hi", "Rating": 4.7}],
            "UserReviews": "none",
        },
    )
    rows = entry_reviews(entries)
    assert rows.count() == 3
    first = {r.reviewer_name: r for r in first_in_entry(rows).collect()}
    assert first["x"].rating == 4  # of the extended list, truncated
    assert (first["z"].rating, first["z"].text, first["z"].published_date, first["z"].owner_response) == (
        None, "yo", "today", "thx",
    )
    stats = import_stats(entries).first()
    assert (stats.entries, stats.unknown_places, stats.reviews_upserted) == (1, 0, 2)


def test_last_entry_wins(spark):
    review = lambda rating: {"name": "a", "text": "t", "rating": rating}
    entries = entries_of(
        spark,
        {"place_id": "p", "title": "old", "user_reviews": [review(1), review(2)]},
        {"place_id": "p", "title": "new", "user_reviews": [review(3), review(4)]},
    )
    places, reviews, _ = import_entries(entries, empty(spark, PLACES), empty(spark, REVIEWS), F.lit("s"))
    assert [r.name for r in places.collect()] == ["new"]
    assert [(r.rating, r.place_name) for r in reviews.collect()] == [(3, "new")]


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    new = spark.createDataFrame(
        [("b", 3, "n", 1), ("b", None, "m", 2), ("c", 5, "o", 1)], "k string, v int, w string, seq int"
    )
    wanted = [("a", 1, "x"), ("b", None, "m"), ("c", 5, "o")]
    once = upsert(old, new, "k", "seq")
    assert sorted(map(tuple, once.collect())) == wanted
    assert sorted(map(tuple, upsert(once, new, "k", "seq").collect())) == wanted
    counts = upsert_counts(old, new, "k").first()
    assert (counts.rows_in, counts.rows_new) == (3, 1)
    assert upsert_counts(old, new.limit(0), "k").first().rows_in == 0


def test_store_and_index(spark):
    store = TableStore(spark, new_path(spark, "store"), shards=4)
    assert store.read("reviews").count() == 0
    none, index = import_and_index(store, entries_of(spark, {"place_id": "p"}), new_path(spark, "index"))
    assert index is None and none.first().entries == 1
    entries = entries_of(
        spark, {"place_id": "p", "title": "P", "user_reviews": [{"name": str(i), "text": f"word{i} same"} for i in range(9)]}
    )
    _, index = import_and_index(store, entries, new_path(spark, "index"))
    assert index.stats.first().n_docs == 9
    old = store.read("reviews")
    import_into(store, entries)
    assert len(store.snapshots("reviews")) == 3
    assert old.count() == store.read("reviews").count() == 9
    key = old.first().review_id
    assert [r.review_id for r in store.lookup("reviews", key).collect()] == [key]
    assert "PartitionFilters: [isnotnull(shard" in store.lookup("reviews", key)._jdf.queryExecution().toString()


def test_long_lists_are_read_in_ranges(spark, tmp_path):
    rows = [{"title": f"t{i}", "note": 'a "quoted" } ] [ { \\\\ brace', "user_reviews": [{"text": "x" * (i % 90)}, {}]} for i in range(3000)]
    mixed = [v for i, row in enumerate(rows) for v in ([7, "}", [{"a": 1}]] if i % 50 == 0 else []) + [row]]
    for name, body in {
        "tight.json": json.dumps(mixed, separators=(",", ":")),
        "spread.json": " " + json.dumps(mixed, indent=2, ensure_ascii=False) + "\n",
        "plain_end.json": json.dumps(mixed + [1, "]"]),
    }.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("9001b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = entry_places(load_entries(spark, str(tmp_path), "auto")).select("seq", "name").orderBy("seq").collect()
            for file in ("tight", "spread", "plain_end"):
                assert [r.name for r in read if file in r.seq.file] == [row["title"] for row in rows], (size, file)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_lists_are_read_by_line(spark, tmp_path):
    lines = ",\n".join(json.dumps({"title": f"t{i}"}) for i in range(500))
    bodies = {
        "no_end": "[\n" + lines,
        "no_comma": "[\n" + lines.replace("},\n", "}\n", 1) + "\n]",
        "last_comma": "[\n" + lines + ",\n]",
        "more": "[\n" + lines + "\n]\n" + '{"title":"m"}',
        "brace": "[\n" + lines + "\n]}",
        "value": "[\n" + lines + ",\nnope]",
        "two": "[1][2]",
        "empty": "[]",
        "none": "[ ]\n\n",
        "open": "[",
    }
    def plain(body):
        try:
            value = json.loads(body)
            return [v["title"] for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
        except ValueError:
            found = []
            for line in body.splitlines():
                try:
                    value = json.loads(line)
                except ValueError:
                    continue
                found += [value["title"]] if isinstance(value, dict) else []
            return found

    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = entry_places(load_entries(spark, str(tmp_path), "auto")).select("seq.file", "name").orderBy("seq").collect()
            for name, body in bodies.items():
                assert [r.name for r in read if r.file.endswith(f"/{name}.json")] == plain(body), (size, name)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_upsert_touches_only_its_shards(spark):
    store = TableStore(spark, new_path(spark, "store"), shards=16)
    rows = lambda *names: conform(
        spark.createDataFrame([(n, "new" if len(names) < 9 else "old") for n in names], "place_id string, name string"), PLACES
    )
    old = store.commit("places", rows(*[f"p{i}" for i in range(200)]))
    new = store.upsert("places", rows("p7", "extra"))
    before, after = set(old.inputFiles()), set(new.inputFiles())
    touched = {path.split("/shard=")[1].split("/")[0] for path in after - before}
    assert len(touched) <= 2 and len(before & after) == len(before) - len(touched)
    values = {r.place_id: r.name for r in new.collect()}
    assert len(values) == new.count() == 201 and old.count() == 200
    assert {k for k, v in values.items() if v == "new"} == {"p7", "extra"}
    assert store.upsert("places", rows()).count() == 201 and len(store.snapshots("places")) == 2
    store.expire("places")
    assert len(store.snapshots("places")) == 1 and store.read("places").count() == 201
    assert store.commit("places", store.read("places")).count() == 201


def test_shards_grow_with_the_files(spark, monkeypatch):
    from vouch.sources import tables

    store = TableStore(spark, new_path(spark, "store"))
    few = store.commit("places", spark.range(50).select(F.col("id").alias("place_id")))
    assert tables.shard_count(few) == tables.LEAST_SHARDS
    monkeypatch.setattr(tables, "SHARD_BYTES", 1000)
    more = store.commit("places", few)
    assert tables.shard_count(more) > tables.LEAST_SHARDS and more.count() == 50
    # an upsert keeps the number of its table
    assert tables.shard_count(store.upsert("places", few.limit(1))) == tables.shard_count(more)


def test_refresh_takes_the_newer_file(spark, tmp_path):
    store = TableStore(spark, new_path(spark, "store"), shards=2)
    drop = tmp_path / "drop"
    drop.mkdir()
    for name, title, age in (("b", "older", 100), ("a", "newer", 50)):
        (drop / f"{name}.json").write_text(json.dumps({"place_id": "p", "title": title}) + "\n")
        os.utime(drop / f"{name}.json", (1_700_000_000 - age,) * 2)
    assert refresh(store, str(drop), str(tmp_path / "state")).awaitTermination(120)
    assert [r.name for r in store.read("places").collect()] == ["newer"]


def test_refresh_reads_each_file_once(spark, tmp_path):
    store = TableStore(spark, new_path(spark, "store"), shards=2)
    drop, state = tmp_path / "drop", str(tmp_path / "state")
    drop.mkdir()
    entry = lambda i: json.dumps({"place_id": f"p{i}", "user_reviews": [{"name": "a", "text": f"t{i}"}]})
    for i in range(3):
        (drop / f"{i}.json").write_text(entry(i) + "\n")
        query = refresh(store, str(drop), state)
        assert query.awaitTermination(120)
        assert store.read("places").count() == store.read("reviews").count() == i + 1
    snapshots = len(store.snapshots("reviews"))
    assert refresh(store, str(drop), state).awaitTermination(120)
    assert len(store.snapshots("reviews")) == snapshots


def test_lists(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" a b \n\n\t\nc\n")
    assert [r.query for r in load_queries(spark, str(tmp_path / "q.txt")).orderBy("qid").collect()] == ["a b", "c"]
    single = spark.createDataFrame([("x, y",)], "variant string")
    listed = spark.createDataFrame([(" p ,, q",)], "csv string")
    assert [r.variant for r in variant_list(single, listed, "csv").collect()] == ["x, y", "p", "q"]


def test_pages_are_cut_per_query(spark):
    page = lambda *ids_: json.dumps({"places": [{"id": i, "displayName": {"text": "n" + i}} for i in ids_]})
    pages = spark.createDataFrame(
        [("q", 0, page("places/a", "", "b")), ("q", 1, page("c", "d")), ("r", 0, page("a")), ("s", 0, "{}")],
        "query_id string, page_no int, body string",
    ).withColumn("body", F.parse_json("body"))
    rows = places_from_pages(pages, max_results=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.place_id) for r in rows] == [("q", "a"), ("q", "b"), ("q", "c"), ("r", "a")]
    assert rows[0].name == "nplaces/a" and rows[0].rating is None and rows[0].address == ""


def test_latest_takes_whole_rows_by_number(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("b", None, "only"), ("c", 5, "same"), ("c", 5, "same"), (None, 1, "x"), (None, 3, "y")]
    got = latest(spark.createDataFrame(rows, "k string, seq int, text string"), "k", "seq")
    assert got.columns == ["k", "text"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 4 and set(found) == {("a", "new"), ("b", "only"), ("c", "same"), (None, "y")}
    assert latest(spark.createDataFrame([], "k string, seq int, text string"), "k", "seq").count() == 0


def test_versions_are_chosen_by_hashing_narrow_rows(spark):
    rows = numbered(spark.createDataFrame([("a", 1, "old")], "k string, seq int, text string"), "versions")
    plan = newest_rows(rows, "k", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "text" not in plan.split("ReadSchema")[1]


def test_lists_are_cut_by_parts(spark):
    from suite.ingest import LIST_PARTS, write_lists
    from vouch.sources.entries import entry_places, load_entries

    keys = [(part, place) for part in range(3 * LIST_PARTS) for place in range(1, 7)]
    lines = spark.createDataFrame(
        [(part * 1_000_000 + place, f'{{"cid": "{place}", "title": "{part}"}}') for part, place in keys] + [(None, "{}")],
        "seq long, line string",
    )
    path = write_lists(lines)
    named = spark.read.text(path).select("_metadata.file_path").distinct().filter("file_path NOT LIKE '%HIVE_DEFAULT%'")
    assert named.count() == 12  # three runs of parts, four files each
    found = entry_places(load_entries(spark, path)).orderBy("seq").select("place_id", "name").collect()
    by_place = {place: [int(r["name"]) for r in found if r["place_id"] == str(place)] for place in range(1, 7)}
    assert by_place == {place: list(range(3 * LIST_PARTS)) for place in range(1, 7)} and len(found) == len(keys)


def test_reviews_move_once_into_entries(spark):
    import json

    from suite.views import entry_lines
    from vouch.session import new_path

    folder = new_path(spark, "tables")
    tables = {
        "documents": ([(1, "one"), (121, "two"), (2, "three"), (121, "again"), (None, "none")], "doc_id long, text string"),
        "labels": ([(121, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"),
        "supplier": ([(1, 0, "S1")], "s_suppkey long, s_nationkey int, s_name string"),
        "nation": ([(0, "N")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    lines = entry_lines(spark, folder)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    found = {r["seq"]: json.loads(r["line"]) for r in lines.collect()}
    texts = lambda entry, key, field: [item[field] for item in entry[key]]
    assert texts(found[1], "UserReviewsExtended", "text") == ["again", "two"]
    assert texts(found[1], "UserReviews", "text") == ["one"]
    assert texts(found[2], "user_reviews_extended", "Description") == ["three"] and found[2]["user_reviews"] == []
    assert set(found) == {1, 2, None}

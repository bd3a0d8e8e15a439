"""Index, search and recommendation on small tables, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vouch.operators import bm25, phrase_index
from vouch.operators.phrase_index import touched_by_index, touched_by_words
from vouch.operators.queries import query_table, with_variants
from vouch.operators.ranking import best_places, evidence, of_places
from vouch.plans.indexing import build_index, index_reviews
from vouch.plans.recommend import recommend, touched
from vouch.plans.search import search
from vouch.plans.tables import load_samples, sample_tables
from vouch.schemas import REVIEWS, conform
from vouch.session import new_path
from vouch.sources.tables import TableStore, keyed_join

TEXTS = [
    "the cat sat on the mat",
    "The dog: dog-house, doghouse!",
    "a cat and a dog",
    "mat mat mat",
    "été à l'été",
    "...",
    "the cat sat on the mat",
]


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, contents string")


def brute_force(texts, query, k1=1.2, b=0.75):
    docs = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    average = sum(map(len, docs)) / len(docs)
    frequency = Counter(t for d in docs for t in set(d))
    out = {}
    for i, doc in enumerate(docs):
        counts, score, hit = Counter(doc), 0.0, False
        for term in set(re.findall(r"[^\W_]+", query.lower())):
            tf, df = counts[term], frequency[term]
            if tf:
                hit = True
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(doc) / average))
        if hit:
            out[str(i)] = round(score, 6)
    return out


@pytest.mark.parametrize("saved", [False, True])
def test_scores(spark, saved):
    index = bm25.build(corpus(spark))
    if saved:
        index = bm25.save(index, new_path(spark, "index"))
    asked = query_table(spark, ["the cat", "Dog mat dog", "ÉTÉ", "nothing here", ""])
    got = {(r.qid, r.doc_id): r.score for r in bm25.scores(index, asked).collect()}
    wanted = {
        (i, doc): score
        for i, q in enumerate(["the cat", "dog mat", "été", "nothing here", ""])
        for doc, score in brute_force(TEXTS, q).items()
    }
    assert got == pytest.approx(wanted, abs=2e-6)


def test_salted_join_gives_the_same_scores(spark, monkeypatch):
    index = bm25.build(corpus(spark))
    asked = query_table(spark, ["the cat", "mat"])
    direct = sorted(map(tuple, bm25.scores(index, asked).collect()))
    monkeypatch.setattr(bm25, "small_rows", lambda df: None)
    assert sorted(map(tuple, bm25.scores(index, asked).collect())) == direct
    monkeypatch.setattr(bm25, "SMALL_BYTES", 0)
    assert sorted(map(tuple, bm25.scores(index, asked).collect())) == direct


def test_top_hits_are_nested_and_ties_ordered(spark):
    index = bm25.build(corpus(spark))
    asked = query_table(spark, ["cat mat"])
    ten = [r.doc_id for r in bm25.top_hits(index, asked, 10).orderBy("rank").collect()]
    two = [r.doc_id for r in bm25.top_hits(index, asked, 2).orderBy("rank").collect()]
    assert ten[:2] == two and ten.index("0") + 1 == ten.index("6")


def test_stop_words_and_vocabulary(spark):
    vocab = spark.createDataFrame([("dog", "animal"), ("cat", "animal")], "term string, canonical string")
    index = bm25.build(corpus(spark), stop=["the", "a"], vocab=vocab)
    rows = {(r.term, r.doc_id): (r.tf, r.dl) for r in index.postings.collect()}
    assert rows[("animal", "2")] == (2, 3) and ("the", "0") not in rows
    hits = bm25.scores(index, query_table(spark, ["the cat"])).collect()
    assert {r.doc_id for r in hits} == {"0", "1", "2", "6"}


def test_small_and_large_vocabularies_give_the_same_postings(spark, monkeypatch):
    vocab = spark.createDataFrame(
        [("dog", "pet"), ("dog", "animal"), ("cat", "animal"), ("the", ""), ("", "none"), (None, "x"), ("mat", None)],
        "term string, canonical string",
    )
    rows = lambda p: sorted(tuple(r) for r in p.collect())
    few = bm25.count_terms(corpus(spark), vocab=vocab)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(term" not in plan and plan.count("HashAggregate(keys") == 2
    monkeypatch.setattr(bm25, "SMALL_BYTES", -1)
    many = bm25.count_terms(corpus(spark), vocab=vocab)
    assert rows(few) == rows(many)
    plain = [(Counter({"dog": "animal", "cat": "animal"}.get(w, w) for w in re.findall(r"[^\W_]+", t.lower())), i) for i, t in enumerate(TEXTS)]
    wanted = {(w, str(i)): n for words, i in plain for w, n in words.items()}
    assert {(t, d): n for t, d, n, _ in rows(few) if t} == wanted
    assert sum(t == "" for t, *_ in rows(many)) == len(TEXTS)


def test_empty_index_is_an_error(spark):
    reviews = conform(spark.createDataFrame([("a", " ")], "review_id string, text string"), REVIEWS)
    with pytest.raises(RuntimeError):
        index_reviews(reviews, new_path(spark, "index"))


def reviews_of(spark, rows):
    made = spark.createDataFrame(rows, "review_id string, place_id string, place_name string, text string")
    return conform(made, REVIEWS, F.lit("s"))


def some_documents(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    return [(str(i), " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(200)], k=rng.randint(1, 60)))) for i in range(n)]


def test_pruned_hits_equal_all_scores(spark):
    docs = some_documents(1, 3_000) + [(f"copy{i}", "w150 w3 w0") for i in range(50)]
    corpus = spark.createDataFrame(docs, "id string, contents string")
    index = bm25.save(bm25.build(corpus, buckets=4), new_path(spark, "index"))
    asked = ["w0 w150 w3", "w1", "w0 w1 w2 w3 w4", "w199 w0", "nowhere", "w180 w181 nowhere w0"]
    queries = query_table(spark, asked)
    for top_n in (1, 10, 60):
        whole = bm25.top_hits(index, queries, top_n, prune_postings=1 << 60)
        pruned = bm25.top_hits(index, queries, top_n, prune_postings=0)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pruned.collect()))
    rows, avgdl = bm25._asked_words(index, queries.limit(1))
    scored = bm25.competitive_parts(index, rows, avgdl, queries.schema["qid"].dataType, 10)
    # far fewer postings than the words have, most of which are those of the most frequent one
    assert scored.count() < sum(row["df"] for row in rows) / 3


def test_segments_equal_a_fresh_index(spark):
    path, base = new_path(spark, "index"), some_documents(2, 300)
    frame = lambda rows: spark.createDataFrame(rows, "id string, contents string")
    bm25.save(bm25.build(frame(base), buckets=3), path)
    second = [(i, text + " again again") for i, text in base[:50]] + [("n1", "new words"), ("n2", "w0")]
    bm25.append(spark, path, frame(second))
    third = [("n1", "newer words")]
    index = bm25.append(spark, path, frame(third), spark.createDataFrame([("100",), ("n2",), ("unheard",)], "id string"))
    now = dict(base) | dict(second) | dict(third)
    del now["100"], now["n2"]
    fresh = bm25.build(frame(list(now.items())))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.postings) == rows(fresh.postings)
    assert rows(index.terms) == rows(fresh.terms)
    assert rows(index.stats)[0][0] == len(now) and rows(index.stats)[0][1] == pytest.approx(rows(fresh.stats)[0][1])
    queries = query_table(spark, ["w0 w3 again", "newer new", "w1 w150"])
    wanted = rows(bm25.top_hits(fresh, queries, 7))
    assert rows(bm25.top_hits(index, queries, 7)) == rows(bm25.top_hits(index, queries, 7, prune_postings=0)) == wanted
    merged = bm25.merge(spark, path, new_path(spark, "index"))
    assert rows(merged.postings) == rows(fresh.postings) and rows(merged.terms) == rows(fresh.terms)


PHRASED = [
    ("1", "p", "P", "Aqua-k here, aquak there"),
    ("2", "p", "P", "AQUA K"),
    ("3", "q", "Q", "unaqua keen"),
    ("4", "q", "Q2", "co-aqua k"),
    ("5", "r", "R", "wait... what?! aquakeratology"),
    ("6", "r", "R", "50% sure"),
    ("7", "s", "S", "plain"),
]


@pytest.mark.parametrize(
    "asked",
    [["aqua k"], [("aqua k", ["aquak", "aquakeratology"])], ["...", "?!"], ["what?!", "50%", "a", "-"], ["zzz"], ["qua ke", "o k", "re, aqua"]],
)
def test_phrases_by_index_equal_a_scan(spark, asked):
    reviews, queries = reviews_of(spark, PHRASED), with_variants(query_table(spark, asked))
    index = build_index(reviews)
    keep = ["qid", "review_id", "place_id", "copy_key", "found"]
    scan = touched(reviews, queries, None, match="scan").select(*keep)
    indexed = touched(reviews, queries, index, bm25_top_n=0, match="index").select(*keep)
    saved = touched_by_index(index, reviews, queries).select(*keep)
    wanted = sorted(
        (q.qid, r[0], r[1], r[3][:120], [v for v in q.variants if v in r[3].lower()])
        for q in queries.collect()
        for r in PHRASED
        if any(v in r[3].lower() for v in q.variants)
    )
    assert sorted(map(tuple, scan.collect())) == wanted
    assert sorted(map(tuple, indexed.collect())) == wanted
    assert sorted(map(tuple, saved.collect())) == wanted


def test_hits_come_from_the_reviews_and_not_from_an_older_index(spark):
    older = build_index(reviews_of(spark, PHRASED[:1]))
    reviews, queries = reviews_of(spark, PHRASED), with_variants(query_table(spark, ["aqua k"]))
    ids = lambda how: sorted(
        r.review_id for r in touched(reviews, queries, older, bm25_top_n=0, match=how).collect()
    )
    assert ids("index") == ids("scan") == ids("auto") and len(ids("scan")) > 1


def test_phrases_without_letters_are_found_in_every_number(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "SMALL_ROWS", 4)  # two of them in a block
    signs = ["...", "?!", "%", "-", "#", "*", "$", "!!"]
    reviews, queries = reviews_of(spark, PHRASED), with_variants(query_table(spark, signs))
    found = lambda how: sorted(
        (r.qid, r.review_id) for r in touched(reviews, queries, None, match=how).collect()
    )
    assert found("index") == found("scan") and len(found("scan")) >= 4


def test_nothing_to_look_for(spark):
    queries = with_variants(query_table(spark, ["x"])).withColumn("variants", F.array().cast("array<string>"))
    assert touched(reviews_of(spark, PHRASED), queries, None, match="index").collect() == []


@pytest.mark.parametrize("limit, small", [(20_000, 32 << 20), (20, 0)])
def test_many_phrases_equal_a_scan(spark, monkeypatch, limit, small):
    # on both sides of the bounds: words listed in the scan and a broadcast dictionary, or a salted join by shuffle
    monkeypatch.setattr(phrase_index, "SMALL_ROWS", limit)
    monkeypatch.setattr(phrase_index, "SMALL_BYTES", small)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    reviews = reviews_of(spark, [(str(i), str(i % 7), "P", text(30).capitalize()) for i in range(200)])
    asked = [(text(rng.randint(1, 3)), [text(2), word() + "-" + word()]) for _ in range(150)]
    queries = with_variants(query_table(spark, asked))
    keep = ["qid", "review_id", "place_id", "copy_key", "found"]
    found = touched(reviews, queries, None, match="index").select(*keep).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, touched(reviews, queries, None, match="scan").select(*keep).collect()))
    assert len(found) > 1_000


def test_more_phrases_than_a_scan_takes(spark):
    made = spark.range(21_000).select(
        F.col("id").alias("qid"), F.array(F.concat(F.lit("aqua "), F.col("id").cast("string"))).alias("variants")
    )
    reviews = reviews_of(spark, PHRASED + [("8", "t", "T", "aqua 20999 aqua 7"), ("9", "t", "T", "aqua 77")])
    found = touched(reviews, made.withColumn("query", F.lit("")), None).collect()
    assert {(r.qid, r.review_id) for r in found} == {(20_999, "8"), (2, "8"), (20, "8"), (209, "8"), (2_099, "8"), (7, "8"), (7, "9"), (77, "9")}


def test_phrases_never_leave_the_jvm(spark):
    queries = with_variants(query_table(spark, [("aqua k", [f"word {i}" for i in range(30)])]))
    plan = touched_by_words(reviews_of(spark, PHRASED), queries)._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas")), plan


def test_samples(spark):
    store = TableStore(spark, new_path(spark, "store"), shards=2)
    load_samples(store, F.lit("s"))
    load_samples(store, F.lit("s"))
    reviews, places = store.read("reviews"), store.read("places")
    assert (places.count(), reviews.count()) == (3, 6)
    index = index_reviews(reviews, new_path(spark, "index"))
    asked = query_table(spark, [("keyboard repair", ["keyboardrepair"]), "keyboard repair"])
    rows = recommend(reviews, places, index, asked).orderBy("qid", "rank").collect()
    north = rows[0]
    assert north.place_id == "sample_north" and north.name == "Northside Keyworks"
    # two reviews, one of which counts under two variants
    assert (north.exact_hits, north.exact_reviews) == (3, 2)
    assert north.variant_hits == {"keyboard repair": 1, "keyboard-repair": 1, "keyboardrepair": 1}
    assert [q.n for q in north.snippets] == [1, 2]
    # a mention is a mention, also where they say no
    assert rows[1].place_id == "sample_mill" and rows[1].exact_hits == 1
    for row in rows:
        assert row.score == pytest.approx(10 * row.exact_hits + row.bm25_top)
        assert row.variants == sorted(set(row.variants))
        assert len({q.text[:120] for q in row.snippets}) == len(row.snippets) <= 3
        assert sum(row.variant_hits.values()) == row.exact_hits
    # several queries at once give what each gives alone
    alone = recommend(reviews, places, index, query_table(spark, ["keyboard repair"])).orderBy("rank").collect()
    batch = [r for r in rows if r.qid == 1]
    strip = lambda r: {k: v for k, v in r.asDict(True).items() if k != "qid"}
    assert list(map(strip, alone)) == list(map(strip, batch))


def test_exact_only_without_index(spark):
    places, reviews = sample_tables(spark, F.lit("s"))
    rows = recommend(reviews, places, None, query_table(spark, ["keyboard repair", "battery"])).collect()
    assert {(r.qid, r.place_id, r.bm25_top) for r in rows} == {
        (0, "sample_north", 0.0), (0, "sample_mill", 0.0), (1, "sample_harbour", 0.0),
    }


def test_unknown_place_and_redaction(spark):
    reviews = reviews_of(spark, [("1", "p", "", "good cat"), ("2", "x", "Named", "cat cat")])
    _, places = None, sample_tables(spark, F.lit("s"))[0]
    index = build_index(reviews)
    asked = query_table(spark, ["cat"])
    names = {r.place_id: r.name for r in recommend(reviews, places, index, asked).collect()}
    assert names == {"p": "?", "x": "Named"}
    found = search(index, reviews, places, asked, redact=True).collect()
    assert len(found) == 2 and all(r.place_name is None and r.reviewer_name is None for r in found)


def test_copies_are_quoted_once_and_text_hits_first(spark):
    same = "z" * 120
    rows = [
        (0, "p", "n", "1", same, ["a"], None),
        (0, "p", "n", "2", same, ["a"], 0.5),
        (0, "p", "n", "3", "other", ["a"], None),
        (0, "p", "n", "4", "third", [], 0.9),
        (0, "p", "n", "5", "last", ["a"], None),
        (0, "q", "n", "6", "elsewhere", ["a"], None),
    ]
    touched_rows = spark.createDataFrame(
        rows, "qid int, place_id string, place_name string, review_id string, copy_key string, found array<string>, score double"
    )
    chosen = spark.createDataFrame([(0, "p")], "qid int, place_id string")
    got = [(r.n, r.review_id, r.score) for r in evidence(of_places(touched_rows, chosen)).orderBy("n").collect()]
    assert got == [(1, "4", 0.9), (2, "2", 0.5), (3, "3", 0.0)]


def test_order_of_places(spark):
    rows = [(0, "a", 1, 9.0, None, 19.0), (0, "b", 2, 0.0, 3.0, 20.0), (0, "c", 2, 0.0, 4.0, 20.0), (0, "d", 1, 50.0, 1.0, 60.0), (0, "e", 2, 0.0, 4.0, 20.0)]
    pool = spark.createDataFrame(rows, "qid int, place_id string, exact_hits int, bm25_top double, rating double, score double")
    order = lambda by: [r.place_id for r in best_places(pool, 10, by).orderBy("rank").collect()]
    assert order("hits") == ["c", "e", "b", "d", "a"]
    assert order("score") == ["d", "c", "e", "b", "a"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    store = TableStore(spark, new_path(spark, "store"), shards=4)
    load_samples(store, F.lit("s"))
    index_path = new_path(spark, "index")
    index = index_reviews(store.read("reviews"), index_path, buckets=3)
    asked = query_table(spark, ["keyboard repair"])
    top = plan(bm25.top_hits(index, asked))
    assert "PushedFilters: [IsNotNull(term), Not(EqualTo(term,)), In(term, [keyboard,repair])" in top
    assert top.count("WindowGroupLimit") >= 2 and "BroadcastHashJoin" in top
    # scores are added up and cut within the buckets: documents never move
    bm25.top_hits(index, asked).collect()
    executed = bm25.top_hits(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in executed and "hashpartitioning(qid" in executed
    assert not re.search(r"hashpartitioning\([^)]*doc_id", executed)
    again = bm25.load(spark, index_path)
    assert again.buckets == index.buckets and again.postings.count() == index.postings.count()
    hits = spark.createDataFrame([("x", 1)], "review_id string, rank int").filter("rank <= 3")
    assert "dynamicpruning" in plan(keyed_join(hits, store.read("reviews"), "review_id"))
    from vouch.operators.exact import touched_reviews, variant_hits

    scan = variant_hits(touched_reviews(store.read("reviews"), with_variants(asked)))
    physical = scan._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("FileScan parquet") == 1 and "Python" not in physical
    assert "CartesianProduct" not in physical and "NestedLoop" not in physical


def test_scan_in_blocks_of_queries(spark, monkeypatch):
    from vouch.plans import recommend as plans

    reviews = reviews_of(spark, PHRASED)
    queries = with_variants(query_table(spark, ["aqua k", "aquak", "a", "what?!", "50%"]))
    index = build_index(reviews)
    whole = sorted(map(str, touched(reviews, queries, index, match="scan").collect()))
    monkeypatch.setattr(plans, "SMALL_ROWS", 4)
    monkeypatch.setattr(plans, "small_rows", lambda df, limit=0: None)
    assert len(plans._blocks(queries)) == 3
    assert sorted(map(str, touched(reviews, queries, index, match="scan").collect())) == whole


def test_tasks_and_buckets_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(bm25, "TASK_TEXT", 20)
    texts = TEXTS * 6
    size = sum(len(text.encode()) for text in texts)
    assert bm25.text_bytes(corpus(spark, texts)) == size
    built = bm25.build(corpus(spark, texts))
    assert built.buckets == -(-size // 20) > 8 and built.postings.rdd.getNumPartitions() == built.buckets
    # a given number of buckets stays, each has the rows of several tasks
    few = bm25.count_terms(corpus(spark, texts), buckets=4)
    assert few.rdd.getNumPartitions() % 4 == 0 and few.rdd.getNumPartitions() * 20 >= size
    asked = query_table(spark, ["cat dog"])
    for index in (built, bm25.build(corpus(spark, texts), buckets=4)):
        path = new_path(spark, "index")
        bm25.save(index, path)
        saved = bm25.append(spark, path, corpus(spark, texts[:5]))
        found = {r.doc_id: r.score for r in bm25.scores(saved, asked).collect()}
        assert found == pytest.approx(brute_force(texts, "cat dog"), abs=2e-6)


def test_large_shards_are_written_by_several_tasks(spark, monkeypatch):
    from vouch.sources import tables

    rows = [(f"r{i:03d}", "p", f"text {i}") for i in range(200)]
    made = conform(spark.createDataFrame(rows, "review_id string, place_id string, text string"), REVIEWS)
    path = new_path(spark, "rows")
    made.write.parquet(path)
    reviews = spark.read.schema(made.schema).parquet(path)
    monkeypatch.setattr(tables, "TASK_BYTES", 1000)
    store = TableStore(spark, new_path(spark, "store"), shards=2)
    stored = store.commit("reviews", reviews)
    files = stored.groupBy(F.input_file_name().alias("file"), "shard").agg(F.collect_list("review_id").alias("ids")).collect()
    assert len(files) > 4 and {f["shard"] for f in files} == {0, 1}
    assert all(f["ids"] == sorted(f["ids"]) for f in files)
    store.upsert("reviews", reviews.withColumn("text", F.upper("text")).filter("review_id < 'r050'"))
    texts = {r["review_id"]: r["text"] for r in store.read("reviews").collect()}
    assert texts == {r: t.upper() if r < "r050" else t for r, _, t in rows}
    assert [r["text"] for r in store.lookup("reviews", "r007").collect()] == ["TEXT 7"]


def test_words_inside_very_many_tokens_stay_out_of_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "MOST_TERMS", 5)
    texts = [f"x{i}y{i % 3} of the" for i in range(60)]
    reviews = spark.createDataFrame(
        [(f"r{i}", "p", "P", t) for i, t in enumerate(texts)], "review_id string, place_id string, place_name string, text string"
    )
    asked = with_variants(query_table(spark, [("y1", ["x7y1", "of the", "!", "none"])]))
    options = phrase_index.ways(asked)
    terms = spark.createDataFrame([(t.split()[0], 1) for t in texts] + [("of", 60), ("the", 60)], "term string, df bigint")
    words, broad = phrase_index.dictionary(terms, options)
    assert sorted(r["variant"] for r in broad.collect()) == ["!", "y1"]
    # the tokens listed do not follow the vocabulary, and every phrase is still found
    assert {r["variant"] for r in words.collect()} == {"x7y1", "of the", "of-the"} and words.count() == 3
    found = {r["review_id"]: r["found"] for r in touched_by_words(reviews, asked).collect()}
    held = {f"r{i}": sorted(v for v in ("y1", "x7y1", "of the", "!", "none") if v in t) for i, t in enumerate(texts)}
    assert found == held


def test_pruned_hits_without_moving_postings(spark, monkeypatch):
    docs = some_documents(3, 1_500)
    index = bm25.save(bm25.build(spark.createDataFrame(docs, "id string, contents string"), buckets=6), new_path(spark, "index"))
    queries = query_table(spark, ["w0 w150 w3", "w1", "w0 w1 w2 w3 w4", "w199 w0", "w180 w181 nowhere w0"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    wanted = rows(bm25.top_hits(index, queries, 10, prune_postings=1 << 60))
    # as if the documents in reach were many
    monkeypatch.setattr(bm25, "SMALL_BYTES", -1)
    for bounds in (bm25.MOST_BOUNDS, 30, 1):
        monkeypatch.setattr(bm25, "MOST_BOUNDS", bounds)
        assert rows(bm25.top_hits(index, queries, 10, prune_postings=0)) == wanted
    found = bm25.competitive_parts(index, *bm25._asked_words(index, queries), queries.schema["qid"].dataType, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(qid#" not in plan.split("ShuffledHashJoin")[0]


def test_words_are_added_up_in_as_many_tasks_as_buckets(spark):
    docs = spark.createDataFrame(some_documents(4, 400), "id string, contents string")
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    usual = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "false")
    try:
        path = new_path(spark, "index")
        index = bm25.save(bm25.build(docs, buckets=40), path)
        assert spark.conf.get(names[1]) == usual[names[1]] == "8"
        for part in ("tops", "terms"):
            files = spark.read.parquet(f"{path}/segment-00000001/{part}").inputFiles()
            assert len(files) > 8, part
    finally:
        spark.conf.set(names[0], usual[names[0]])
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, bm25.build(docs).terms.collect()))


@pytest.fixture
def alone(spark):
    """Settings of a test, taken back after it."""
    usual = {}

    def put(name, value):
        usual.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in usual.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_words_of_an_index_are_not_put_together_in_large_tasks(spark, monkeypatch, alone):
    from vouch import session

    docs = spark.createDataFrame(some_documents(5, 400), "id string, contents string")
    # at run time all would go to one task, within the usual bound of 64 MB
    alone("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    alone("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    bounds = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    usual = [spark.conf.get(name) for name in bounds]
    monkeypatch.setattr(session, "TASK_MOVES", 2_000, raising=False)
    monkeypatch.setattr(session, "TASK_READS", 4_000, raising=False)
    path = new_path(spark, "index")
    index = bm25.save(bm25.build(docs, buckets=6), path)
    files = lambda part: spark.read.parquet(f"{path}/segment-00000001/{part}").inputFiles()
    assert len(files("tops")) > 3 and len(files("terms")) > 1
    assert [spark.conf.get(name) for name in bounds] == usual
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, bm25.build(docs).terms.collect()))


def test_phrases_of_many_texts_are_looked_up_in_more_tasks(spark, monkeypatch, alone):
    from vouch.plans import recommend as plans

    rows = [(i, "p", "place", text) for i, text in some_documents(6, 300)]
    reviews = spark.createDataFrame(rows, "review_id string, place_id string, place_name string, text string")
    queries = with_variants(query_table(spark, ["w0 w1", ("w3", ["w1 w2"]), "!"]))
    alone("spark.sql.adaptive.enabled", "false")
    wanted = sorted(map(str, touched(reviews, queries, None, match="scan").drop("score").collect()))
    monkeypatch.setattr(plans, "TASK_TEXT", 200, raising=False)
    found = touched(reviews, queries, None, match="index")
    assert len(found.inputFiles()) > 8
    assert sorted(map(str, found.drop("score").collect())) == wanted


def test_sums_and_joins_of_an_appended_index_follow_all_postings(spark, monkeypatch, alone):
    docs = some_documents(7, 400)
    table = lambda rows: spark.createDataFrame(rows, "id string, contents string")
    alone("spark.sql.adaptive.enabled", "false")
    alone("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(bm25, "TASK_POSTINGS", 1_000, raising=False)
    path = new_path(spark, "index")
    bm25.save(bm25.build(table(docs[:20]), buckets=2), path)
    index = bm25.append(spark, path, table(docs[10:]))
    assert len(spark.read.parquet(f"{path}/segment-00000002/tops").inputFiles()) > 8
    joined = bm25.with_df(index)
    assert joined.rdd.getNumPartitions() > 8
    fresh = bm25.build(table(docs))
    wanted = fresh.postings.filter("term != ''").join(fresh.terms, "term").select(joined.columns)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, wanted.collect()))

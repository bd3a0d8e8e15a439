"""Near duplicates, spans and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.llm import near_dup
from vouch.llm.components import connected_components
from vouch.llm.near_dup import drop_near_duplicates, near_duplicates, shared_items
from vouch.llm.sketch import EMPTY, Shingler, band_plan, overlap, sketch
from vouch.llm.spans import Spans, remove_repeated_spans

SCHEMA = "doc_id bigint, text string, kept string, n int, component_id int, rep int"


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in data], SCHEMA)


def family(seed, size=40, words=120, changes=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=words)
    out = [base]
    for _ in range(size - 1):
        text = list(rng.choice(out[:3]))
        for at in rng.sample(range(words), rng.randint(0, changes)):
            text[at] = rng.choice(vocabulary)
        out.append(text)
    return [" ".join(t) for t in out]


def shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute(data, n, percent):
    sets = [shingles(t, n) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(data):
        if doc_id is not None:
            ids[find(i)] = min(doc_id, ids.get(find(i), doc_id))
    return sorted((str(d), len(sets[i]), str(ids.get(find(i), d))) for i, (d, _) in enumerate(data))


def rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "two one"), (None, "one two")]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_find_every_link(spark, n, percent):
    texts = family(1) + family(2, changes=9) + family(3, size=10, changes=0) + ["a" * 100_000 + " b c " * 20]
    data = list(enumerate(texts)) + ODD + [(5, texts[5]), (7, texts[90])]
    found = near_duplicates(frame(spark, data).repartition(3), n=n, percent=percent)
    assert rows(found) == brute(data, n, percent)


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    data = list(enumerate(family(4, size=60, changes=7)))
    assert rows(near_duplicates(frame(spark, data), n=3, percent=85)) == brute(data, 3, 85)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_kept_is_the_component_itself(spark):
    found = near_duplicates(frame(spark, list(enumerate(family(5, size=8, changes=0))))).collect()
    assert sorted((r.doc_id, r.kept) for r in found) == [(i, i == 0) for i in range(8)]


def test_sketch_estimates_similarity_and_fills_every_bin():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(items[:2000]), np.unique(items[1000:])  # a third in common
    s = sketch([a, b, a[:1], np.zeros(0, np.uint64)], 128)
    assert (s[:3] != EMPTY).all() and (s[3] == EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.15
    assert overlap(a, b) == 1000


def test_band_plan_keeps_the_bound():
    for threshold in (0.8, 0.85, 0.95):
        bands, length = band_plan(threshold, 125)
        assert bands * length <= 125 and (1 - threshold**length) ** bands <= 1e-6


def test_shared_items_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    assert (shared_items(sets[:10], sets[10:], width=64) == [[overlap(a, b) for b in sets[10:]] for a in sets[:10]]).all()


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(12)
    words = lambda: [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(60)]
    a, b = words(), words()
    near_b = " ".join([*b, "more"])
    a, b = " ".join(a), " ".join(b)
    data = [(1, a), (7, b), (7, a), (9, near_b), (None, a), (None, None), (None, None), (3, ""), (3, ""), (11, "x")]
    data += [(None, b + " two"), (20, " ".join(words()))] + [(None, "only without id " * 5)] * 3
    docs = spark.createDataFrame(
        [(i, t, 1, 2, "x", 4.0) for i, t in data],
        "doc_id bigint, text string, ids int, lost_id int, number string, component_id double",
    )
    out = drop_near_duplicates(docs.repartition(3))
    assert out.columns == docs.columns
    got = sorted(((r[0], r[1]) for r in out.collect()), key=str)
    wanted = [(1, a), (7, b), (None, None), (None, None), (3, ""), (3, ""), (11, "x"), data[11], data[12]]
    assert got == sorted(wanted, key=str)
    assert drop_near_duplicates(docs.limit(0)).collect() == []


def test_shingles_of_short_texts():
    one = Shingler(3)
    assert len(one(b"a b c d")) == 2 and len(one(b"A b")) == 1 and len(one(b" \x0b")) == len(one(None)) == 0
    assert one(b"A b").tolist() == one(b"a\tB").tolist()


def test_components_of_paths_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (70, 70), (None, 3), (80, 81), (81, 80)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40, 80: 80, 81: 80}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- spans ---------------------------------------------------------------------------


def sentence(rng, k=12):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k)) + ". "


def brute_spans(data, sentences=2, words=20):
    """Every run of so many sentences and words, however long, against all earlier places."""
    seen, out = set(), []
    for doc_id, text in sorted(data):
        found = re.findall(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*", text)
        plain = [p.lower().split() for p in found]
        gone = set()
        for i in range(len(found)):
            for j in range(i + sentences, len(found) + 1):
                run = tuple(map(tuple, plain[i:j]))
                if sum(map(len, run)) >= words:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out.append((doc_id, "".join(p for k, p in enumerate(found) if k not in gone)))
    return sorted(out)


def test_every_sentence_of_a_passage_goes(spark):
    rng = random.Random(9)
    parts = lambda *sizes: "".join(sentence(rng, k) for k in sizes)
    tails, short, data = parts(10, 30, 5, 5), parts(9, 9), []
    for i in range(6):
        data.append((i, parts(7, 8) + (tails if i < 3 else short) + parts(25)))
    for i in range(6, 30):  # sentences out of a small stock, in runs of all lengths
        rng2 = random.Random(i % 10)
        data.append((i, "".join(sentence(random.Random(rng2.randrange(12)), 1 + rng2.randrange(15)) for _ in range(9))))
    out = {r.doc_id: r.text for r in remove_repeated_spans(frame(spark, data)).collect()}
    assert sorted(out.items()) == brute_spans(data)
    assert tails in out[0] and tails.split(". ")[3] not in out[1]
    assert all(short in out[i] for i in (3, 4, 5))  # 18 words: no run


def test_repeated_passages_stay_once(spark):
    rng = random.Random(3)
    passage = "".join(sentence(rng) for _ in range(5))
    data = [(i, sentence(rng) + (passage if i % 3 == 0 else "") + sentence(rng) + sentence(rng)) for i in range(40)]
    data += [(100, passage.upper().replace(" ", "  ")), (101, passage + passage)]
    out = remove_repeated_spans(frame(spark, data).repartition(4)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == brute_spans(data)
    assert sum(passage in r.text for r in out) == 1 and out[0].kept == "x"
    assert all(r.text == dict(data)[r.doc_id] for r in out if r.doc_id % 3 and r.doc_id < 100)


def test_spans_of_odd_texts(spark):
    data = [(1, None), (2, ""), (3, "..."), (None, "no end"), (4, "a" * 200_000), (5, "One. " * 100), (5, "Two.")]
    out = remove_repeated_spans(frame(spark, data), counts=True)
    got = {(r.doc_id, r.text if r.text is None else r.text[:10]) for r in out.collect()}
    assert got == {(1, None), (2, ""), (3, "..."), (None, "no end"), (4, "a" * 10), (5, "One. "), (5, "Two.")}
    assert out.columns[:2] == ["doc_id", "text"]
    assert remove_repeated_spans(frame(spark, [])).collect() == []


def test_pieces_join_to_the_text():
    for text in ("A b. C!\n\nD", "...", " x", "\n", "a.b.c?! d\n "):
        assert "".join(Spans()(text)[0]) == text

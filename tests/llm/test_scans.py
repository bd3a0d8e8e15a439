"""Licence scans, ranked lexical search and periodic runs against SQL and brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from vouch.llm import lexical
from vouch.llm.lexical import rank_documents
from vouch.llm.licences import scan_licences
from vouch.llm.queries import ORACLES
from vouch.llm.runs import WaveletTree, find_runs, periodic_runs, repeat_words

SCHEMA = "doc_id bigint, text string, n int, word string, tid int, row int, item_id int, hits int"


def frame(spark, data):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5) for i, t in data], SCHEMA)


def from_sql(name, **tables):
    connection = duckdb.connect()
    for table, rows in tables.items():
        key = "item_id" if table == "benchmark" else "doc_id"
        connection.execute(f"CREATE TABLE {table} ({key} bigint, text varchar)")
        if rows:
            connection.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)
    return sorted(connection.execute(ORACLES[name]).fetchall(), key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


# --- licences ------------------------------------------------------------------------------

NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"
LICENCE_DOCS = [
    (1, "Released under the MIT License."),
    (2, f"before {NOTICE} after"),
    (3, NOTICE.replace("free of charge", "at no cost")),  # key phrase altered
    (4, "Licensed under CC BY-NC 4.0. cc-by-nc CC/BY/NC"),
    (5, "licensed under the GNU General Public License, version 3; Apache License, Version 2"),
    (6, "version 3 license general public gnu the under licensed"),  # the words in another order
    (7, "the license of the public " * 300 + "under the mit license"),
    (8, "under the under the mit license mitlicense mit License"),
    (9, None),
    (10, ""),
    (11, " .,- \n"),
    (None, "under the MIT license"),
    (1, "Released under the MIT License."),
    (12, "Lizenz ÜNDER the mit license é under the mit\x00license"),
    (13, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    (14, "word " * 300 + "apache license version 2 0"),
]


def test_licences_equal_sql(spark):
    got = rows_of(scan_licences(frame(spark, LICENCE_DOCS)))
    wanted = from_sql("op11_licence_scan", documents=LICENCE_DOCS)
    assert got == wanted
    labels = {r[0]: r[6] for r in got}
    assert labels[2] == "mit" and labels[3] == "" and labels[6] == "" and labels[13] == "bsd"
    assert labels[5] == "apache-2,gpl-3"
    assert {r[0]: r[3:5] for r in got}[8] == (2, 2)


def test_licences_of_a_very_long_text(spark):
    docs = [(1, "word " * 200_000 + "Apache License, Version 2.0 " * 1_000)]
    row = scan_licences(frame(spark, docs)).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (205_000, 1_000, 200_000, 204_995)


def test_licences_of_an_empty_table(spark):
    assert scan_licences(frame(spark, [])).collect() == []


# --- lexical search ------------------------------------------------------------------------


def lexical_docs(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Straße", "日本"]
    some = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(63)], k=rng.randint(0, 40)))
    return [(i, some()) for i in range(n)]


@pytest.mark.parametrize("bucket", [4, 64, 4096])
def test_search_equals_sql(spark, monkeypatch, bucket):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    docs = lexical_docs(1, 700)
    docs += [(9_000 + i, docs[5][1]) for i in range(40)] + [(None, docs[5][1]), (7, docs[5][1]), (8, None), (9, "")]
    docs += [(8_000, "w3 " * 50_000 + "w61"), (8_001, "W1-w2_w3.É")]
    items = [(i, t) for i, t in lexical_docs(2, 30)] + [(40, None), (41, ""), (42, "nowhere"), (None, "w1"), (3, "w3 w3 w9")]
    got = rank_documents(
        frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=2_000
    )
    assert rows_of(got) == from_sql("op12_lexical_search", documents=docs, benchmark=items)


def test_search_without_rows(spark):
    none, one = frame(spark, []), frame(spark, [(1, "w1")])
    items = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert rank_documents(none, items).collect() == []
    assert rank_documents(one, items.limit(0)).collect() == []
    assert rank_documents(frame(spark, [(1, None)]), items).collect() == []


def test_buckets_are_pruned():
    # vectors that share no heavy coordinate with the query are never rescored
    rng = np.random.default_rng(3)
    ends = np.arange(1, 2_001) * 5
    tid = np.concatenate([np.sort(rng.choice(200, 5, replace=False)) for _ in range(2_000)]).astype(np.int32)
    bucket = lexical.Bucket(np.arange(2_000), ends, tid, rng.integers(1, 1_000, len(tid)).astype(np.int32))
    own, q = np.array([1, 2, 3, 4]), np.array([9_000, 8_000, 10, 5])
    dense = np.zeros(200, np.int64)
    dense[own] = q
    exact = bucket.rescore(np.arange(2_000), dense)
    floor = int(np.sort(exact)[-10])
    at, scores = bucket.search(own, q, dense, 10, floor)
    assert len(at) < 200 and set(np.flatnonzero(exact >= floor)) <= set(at.tolist())
    assert (exact[at] == scores).all()


# --- periodic runs -------------------------------------------------------------------------


def brute_runs(words, least=24):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def sequences(count):
    rng = random.Random(11)
    for trial in range(count):
        kind = trial % 4
        if kind == 0:
            yield [rng.randrange(2) for _ in range(rng.randrange(140))]
        elif kind == 1:
            words = []
            while len(words) < 160:
                unit = [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
                words += (unit * rng.randrange(1, 8))[: rng.randrange(1, 100)]
            yield words
        elif kind == 2:  # runs whose period holds a run
            unit = [0] * rng.randrange(1, 40) + [1] + [0] * rng.randrange(40)
            yield [3] + unit * rng.randrange(2, 6) + unit[: rng.randrange(len(unit) + 1)]
        else:
            short = [rng.randrange(2) for _ in range(rng.randrange(1, 4))]
            yield [9] * rng.randrange(3) + (short * rng.randrange(1, 12) + [5]) * rng.randrange(2, 6) + short * 4


def test_runs_equal_brute_force():
    total = 0
    for words in sequences(600):
        wanted = brute_runs(words)
        assert [tuple(r) for r in find_runs(np.array(words, np.int64)).tolist()] == wanted
        total += len(wanted)
    assert total > 300


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    values = rng.permutation(300)[:200]
    tree = WaveletTree(values)
    for _ in range(50):
        lo, hi = sorted(rng.integers(0, 201, 2).tolist())
        x, part = int(rng.integers(0, 600)), np.sort(values[lo:hi])
        one = lambda v: np.array([v])
        assert tree.below(one(lo), one(hi), one(x))[0] == (part < x).sum()
        if hi > lo:
            k = int(rng.integers(0, hi - lo))
            assert tree.smallest(one(lo), one(hi), one(k))[0] == part[k]


def plain_row(doc_id, text):
    words = text.encode().split() if text else []
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha(told.encode()), sha(b" ".join(kept))


def test_rows_equal_brute_force(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choices(["a", "b\tc", "d e", "ü", "F\x0b", "x"], k=rng.randrange(150)))
    docs = [(i, text()) for i in range(300)] + [(None, "a b " * 40), (7, None), (8, ""), (9, " \n "), (7, "z " * 30)]
    docs += [(5_000, "long " * 3_000), (5_001, "long " * 20 + "end"), (-4, "a b c " * 9)]
    got = rows_of(periodic_runs(frame(spark, docs), change=repeat_words))
    assert got == sorted((plain_row(*d) for d in docs), key=str)
    assert periodic_runs(frame(spark, [])).collect() == []


def test_collapsed_text_and_a_very_long_one(spark):
    docs = [(1, "go " + "a b " * 20 + "stop"), (2, "w " * 200_000)]
    rows = {r["doc_id"]: r for r in periodic_runs(frame(spark, docs), keep_text=True).collect()}
    assert rows[1]["collapsed"] == "go a b stop" and rows[2]["collapsed"] == "w"
    assert (rows[2]["start"], rows[2]["length"], rows[2]["period"]) == (0, 200_000, 1)

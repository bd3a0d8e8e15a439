"""Vector searches against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.llm.ann import approximate_top_k, hilbert_keys
from vouch.llm import impact_search
from vouch.llm.impact_search import Block, Strip, exact_top_k
from vouch.llm.queries import ORACLES

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int, x int"
ODD = [
    (None, [0.1, 0.2, 0.3]),
    (900, None),
    (901, []),
    (902, [0.1, None, 0.3]),
    (903, [0.1, float("nan"), 0.3]),
    (904, [0.1, float("inf"), 0.3]),
]


def rows(n, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    # few distinct values, so that scores tie
    return [(i, [float(v) for v in rng.integers(-4, 5, dims) / 8]) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, "s", 1, 2) for i, v in data], SCHEMA)


def brute(data, queries, k, change):
    fine = [(i, change(v)) for i, v in data if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for q, a in fine:
        if q in queries:
            scored = sorted((-float(np.dot(a, b)), j) for j, b in fine if j != q and len(a) == len(b))
            out |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def whole(v):
    return [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]


def test_exact_top_k_with_ties_odd_rows_and_other_lengths(spark):
    data = rows(60) + ODD + [(700, [0.5, 0.5]), (701, [0.25, 0.5])]
    df = frame(spark, data)
    found = exact_top_k(df, df.where(F.col("vec_id") % 5 == 0), k=4).collect()
    queries = {i for i, _ in data if i is not None and i % 5 == 0}
    assert {(r.query_id, r.rank, r.vec_id, float(r.score)) for r in found} == brute(data, queries, 4, whole)


def test_large_components_count(spark):
    rng = np.random.default_rng(8)
    data = rows(120, seed=3) + [(200 + i, [float(rng.choice([1e7, -1e7, 3.0])), *[float(v) for v in rng.choice([-4e4, 5e4, 0.25], 2)]]) for i in range(60)]
    data += [(300, [40_000.0, 50_000.0, 0.0]), (305, [3e6, -3e6, 1e6])]
    df = frame(spark, data + data[:9])
    found = exact_top_k(df, df.where(F.col("vec_id") % 5 == 0), k=4)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE embeddings (vec_id bigint, embedding float[])")
    connection.executemany("INSERT INTO embeddings VALUES (?, ?)", data + data[:9])
    sql = ORACLES["op1_exact_top_k"].replace("vec_id % 50 = 0", "vec_id % 5 = 0").replace("<= 5", "<= 4").replace(
        "SELECT vec_id, list_transform", "SELECT rowid AS r, vec_id, list_transform").replace(
        "v q JOIN v c", "(SELECT vec_id, min(x) AS x FROM v GROUP BY 1) q JOIN v c")
    assert sorted(tuple(r) for r in found.collect()) == sorted(connection.execute(sql).fetchall())


@pytest.mark.parametrize("size", [3e12, 3e25])
def test_scores_beyond_a_long_raise(spark, size):
    df = frame(spark, [(0, [size, size, 1.0]), (1, [size, size, 1.0])])
    with pytest.raises(Exception, match="too large"):
        exact_top_k(df, df, k=1).collect()


def test_exact_top_k_without_rows_and_with_fewer_candidates_than_k(spark):
    df = frame(spark, rows(3))
    assert exact_top_k(df.limit(0), df.limit(0), k=5).collect() == []
    assert exact_top_k(df, df.where("vec_id = 0"), k=5).count() == 2


def test_block_search_is_exact_and_can_stop_early():
    rng = np.random.default_rng(1)
    x = rng.integers(-128, 128, (700, 16))
    x[5] = x[6] = 120  # far ahead of the rest
    block = Block(np.arange(700), x)
    for q in (*rng.integers(-128, 128, (20, 16)), np.full(16, 100), np.zeros(16, int)):
        at, scores = block.search(3, q, 5)
        want = sorted((-int(s), i) for i, s in enumerate(x @ q) if i != 3)[:5]
        assert [(-int(s), int(i)) for i, s in zip(at, scores)] == want


def test_queries_and_blocks_meet_without_copies_for_each_pair(spark):
    df = frame(spark, rows(60))
    found = exact_top_k(df, df.where(F.col("vec_id") % 5 == 0), k=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan  # queries for all blocks were broadcast


def test_exact_top_k_over_many_groups_and_strips(spark, monkeypatch):
    for name, small in (("BLOCK", 8), ("PACK", 12), ("STRIP", 20), ("GROUP", 60)):
        monkeypatch.setattr(impact_search, name, small)
    data = rows(200, seed=4) + ODD + [(700 + i, [0.5, i / 8]) for i in range(30)]
    df = frame(spark, data)
    found = exact_top_k(df, df.where(F.col("vec_id") % 5 == 0), k=4).collect()
    queries = {i for i, _ in data if i is not None and i % 5 == 0}
    assert {(r.query_id, r.rank, r.vec_id, float(r.score)) for r in found} == brute(data, queries, 4, whole)
    assert len(found) == 4 * len(queries - {900})  # 900 has no vector


@pytest.mark.parametrize("kind", ["even", "falling", "sparse", "ties", "same", "double", "long"])
def test_blocks_fill_a_strip_like_brute_force(kind, monkeypatch):
    monkeypatch.setattr(impact_search, "PAIRS", 4096)
    monkeypatch.setattr(impact_search, "BATCH", 70)
    rng = np.random.default_rng(6)
    n, dims = 900, 12
    x = rng.integers(-128, 128, (n, dims))
    if kind == "falling":
        x = (x * 0.4 ** np.arange(dims)).astype(np.int64)
    elif kind == "sparse":
        x *= rng.random((n, dims)) < 0.15
    elif kind == "ties":
        x = x // 100 * 30
    elif kind == "same":
        x[:] = 7
    elif kind in ("double", "long"):
        x *= {"double": 1 << 13, "long": 1 << 21}[kind]
    ids = rng.permutation(n)
    ids[-40:] = ids[:40]  # some come twice
    at = rng.choice(n - 40, 300, replace=False)
    strip = Strip(ids[at], x[at], 5)
    for start in range(0, n, 290):
        Block(ids[start : start + 290], x[start : start + 290]).fill(strip)
    for i, own in enumerate(at):
        scores = x @ x[own]
        best = sorted((-int(s), int(j)) for s, j in zip(scores, ids) if j != ids[own])[:5]
        assert [(-int(s), int(j)) for s, j in zip(strip.scores[i], strip.found[i])] == best


def test_leading_segments_prove_what_they_can(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (2000, 16))
    x[:, :2] = rng.integers(-1000, 1001, (2000, 2))  # two dimensions have all the impact
    read = []
    gains = impact_search.Read.gains
    counted = lambda self, block: read.append(len(self.columns)) or gains(self, block)
    monkeypatch.setattr(impact_search.Read, "gains", counted)
    strip = Strip(np.arange(0, 2000, 20), x[::20], 5)
    for start in range(0, 2000, 500):
        Block(np.arange(start, start + 500), x[start : start + 500]).fill(strip)
    assert read and max(read) <= 4
    for i, own in enumerate(range(0, 2000, 20)):
        best = sorted((-int(s), j) for j, s in enumerate(x @ x[own]) if j != own)[:5]
        assert [(-int(s), int(j)) for s, j in zip(strip.scores[i], strip.found[i])] == best


def test_hilbert_keys_step_to_neighbours():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    order = np.argsort(hilbert_keys(cells, 3))
    assert sorted(hilbert_keys(cells, 3)) == list(range(side**3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_nearest_neighbours_in_reach_are_exact(spark):
    data = [(i, v) for i, v in rows(80, seed=3)] + ODD + [(905, [0.0, 0.0, 0.0]), (700, [0.5, 0.5]), (720, [0.25, 0.5])]
    df = frame(spark, data)
    found = approximate_top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()
    fine = [(i, v) for i, v in data if not v or any(v)]
    queries = {i for i, _ in fine if i is not None and i % 20 == 0}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == brute(fine, queries, 7, lambda v: v)


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 32)) * rng.uniform(0.5, 2, (6000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = approximate_top_k(df, F.col("vec_id") % 100 == 0, k=10, reach=256)
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    hits = 0
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hits += sum((q, int(j)) in got for j in np.argsort(-s)[:10])
    assert hits / 600 > 0.7  # a short reach; production parameters reach further


def test_nearest_neighbours_without_rows(spark):
    df = frame(spark, [])
    assert approximate_top_k(df, F.col("vec_id") % 20 == 0, k=3).collect() == []


def test_nearest_neighbours_of_many_copies_are_the_smallest_ids(spark):
    rng = np.random.default_rng(7)
    hot = [0.5, -0.25, 0.125]
    data = [(i, hot if i % 3 == 0 else [float(c) for c in rng.integers(-8, 9, 3) / 8]) for i in range(900)]
    data += [(40, [0.25, 0.25, 0.25]), (40, hot), (60, hot), (3, hot)]  # ids repeated
    found = approximate_top_k(frame(spark, data), F.col("vec_id") % 20 == 0, k=7, reach=100).collect()
    copies = sorted(i for i, v in data if v == hot)
    for q in (60, 120, 300, 600, 840):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        better = sorted((-float(np.dot(hot, v)), i) for i, v in data if i != q)[:7]
        assert [(-r.score, r.vec_id) for r in mine] == better
    assert len({(r.query_id, r.rank) for r in found}) == len(found) == 45 * 7
    assert copies[0] == 0 and all(r.vec_id != 40 for r in found if r.query_id == 40)


def test_nearest_neighbours_recall_holds_as_rows_grow(spark, monkeypatch):
    # production setting, scaled down: a least reach and blocks that cover a small table only
    from vouch.llm import ann

    monkeypatch.setattr(ann, "REACH", 64)
    monkeypatch.setattr(ann, "BLOCK", 256)
    monkeypatch.setattr(ann, "WIDEST", 1024)
    rng = np.random.default_rng(11)
    for n in (1500, 12000):
        x = rng.standard_normal((n, 48))
        x /= np.linalg.norm(x, axis=1)[:, None]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        found = approximate_top_k(df, F.col("vec_id") % 100 == 0, k=10).collect()
        got = {(r.query_id, r.vec_id) for r in found}
        s = x[::100] @ x.T
        s[np.arange(len(s)), np.arange(0, n, 100)] = -np.inf
        true = {(100 * i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i])[:10]}
        assert len(found) == len(true) and len(got & true) / len(true) >= 0.9

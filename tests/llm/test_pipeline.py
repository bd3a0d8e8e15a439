"""The pipeline, stage by stage, on the smallest tables."""

import os
import random

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_and_the_pipeline_are_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(oracle_sql()) <= set(names)


def test_stages_on_planted_documents(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    sentence = lambda: " ".join(word() for _ in range(12)) + ". "
    text = lambda n: "".join(sentence() for _ in range(n))
    given = spark.read.parquet(f"{SF}/documents.parquet")
    base, passage = text(20), text(5)
    planted = [
        (10_000, base), (10_001, base), (10_002, base + "one more. "), (10_003, text(4) + passage + text(4)),
        (10_004, text(4) + passage + text(4)), (10_005, None), (10_006, ""), (10_007, text(6)),
    ]
    new = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], given.schema)
    docs = given.unionByName(new)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, before, SF), name)
        kept[name] = {r.doc_id: r.text for r in docs.where("doc_id >= 10000").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == given.columns
    assert set(kept["toxicity"]) == {i for i, _ in planted}
    assert set(kept["minhash_near_dedup"]) == {i for i, _ in planted} - {10_001, 10_002}
    cleaned = kept["substring_dedup"]
    assert passage in cleaned[10_003] and passage not in cleaned[10_004] and cleaned[10_000] == base
    assert cleaned[10_007] == dict(planted)[10_007] and cleaned[10_005] is None and cleaned[10_006] == ""
    assert kept["mixing"] == cleaned == kept["sentencepiece"]
    rows = docs.collect()
    assert all(r.round_trip for r in rows if "▁" not in (r.text or ""))
    assert all((r.ids is None) == (r.text is None) for r in rows)


ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, lost_id string, tokens int, c0 int"


def test_rows_without_id_shared_ids_and_clashing_columns(spark):
    rng = random.Random(4)
    text = lambda: "".join(" ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(12)) + ". " for _ in range(6))
    a, b, c = text(), text(), text()
    data = [(1, a), (7, b), (7, a), (9, b + "one more."), (None, a), (None, c), (None, c), (None, None), (3, "")]
    wanted = [(1, a), (7, b), (None, c), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, 3) for i, t in data], ODD_SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        rows = docs.collect()
        if name in ("minhash_near_dedup", "substring_dedup"):
            assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(wanted, key=str)
    assert {(r.doc_id, r.text) for r in rows} == set(wanted)  # mixing may repeat rows
    assert docs.columns[-3:] == ["ids_2", "round_trip", "n_tokens"]
    assert all(r.lost_id == "x" and r.ids == 1 and (r.text is None or r.round_trip) for r in rows)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []

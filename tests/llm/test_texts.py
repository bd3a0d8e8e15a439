"""Tokens, toxicity and mixing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.llm.grams import GramHasher
from vouch.llm.mixing import Classifier, document_rates, fit_mix, mix_documents
from vouch.llm.pieces import Decoder, Encoder, PieceModel
from vouch.llm.queries import TOKENIZERS, piece_model
from vouch.llm.sentencepiece import decode, encode
from vouch.llm import toxicity
from vouch.llm.toxicity import PackedSlots, fit, keep_clean, score, train

SCHEMA = "doc_id bigint, text string, ids string, c0 int, tokens int, score int"
ODD = [(None, "some text here"), (801, None), (802, ""), (803, " \n\t "), (804, "long " * 40_000), (805, "▁<s></s>\x00 é")]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in data], SCHEMA)


# --- SentencePiece -----------------------------------------------------------------------


def raw_model():
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        return f.read()


def texts():
    rng = random.Random(8)
    parts = ["ing", "tion", "the", "er", "ß", "日本", "😀", " ", "  ", "   ", "\n", "\t", "!!", "$$$", "0", "12", "Ab", "'s", "​", "ｈ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)] + ["", " ", "x" * 300, " " * 40]


def test_ids_equal_those_of_the_library():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=raw_model())
    model = PieceModel.load(raw_model())
    encoder, decoder, given = Encoder(model, most_words=50, chunk=7), Decoder(model), texts()
    for start in range(0, len(given), 37):
        some = given[start : start + 37]
        ids, at = encoder(some)
        for i, text in enumerate(some):
            own = ids[at[i] : at[i + 1]]
            assert own.tolist() == library.encode(text)
            assert decoder(own) == library.decode(own.tolist()) == text


def test_very_long_words_and_runs_of_spaces():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=raw_model())
    encoder = Encoder(PieceModel.load(raw_model()))
    rng = random.Random(3)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300_000))
    mixed = "".join(rng.choices(["日本語", "テスト", "ß", "  ", "abc", "漢字", "😀"], k=2_000))
    given = [" " * 1_000_000, "a" + " " * 70_001 + "b" + " " * 33, cjk, mixed, "".join(rng.choices("etaoin", k=700))]
    ids, at = encoder(given)
    for i, text in enumerate(given):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text), i


def best_score(model, word):
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - model.longest), end):
            n = model.number.get(word[start:end], model.unk_number if end - start == 1 else None)
            if n is not None:
                best[end] = max(best[end], best[start] + model.score_of[n])
    return best[-1]


def test_unigram_paths_have_the_largest_score():
    rng = random.Random(1)
    pieces = ["<unk>", *"▁abc", "ab", "bc", "abc", "▁a", "ca", "cab", "▁▁"]
    model = PieceModel(pieces, [0.0] + [rng.uniform(-9, -1) for _ in pieces[1:]], [2] + [1] * (len(pieces) - 1), True)
    encoder = Encoder(model)
    for _ in range(200):
        text = "".join(rng.choices("abcd ", k=rng.randint(1, 14)))
        ids, _ = encoder([text])
        own = sum(model.score_of[model.unk_number] if i == 0 else model.scores[i] for i in ids.tolist())
        assert own == pytest.approx(best_score(model, "▁" + text.replace(" ", "▁")))


def test_encode_and_decode_columns(spark):
    data = [(i, t) for i, t in enumerate(texts()[:60])] + ODD
    model = piece_model(spark)
    out = decode(encode(frame(spark, data), model, ids_col="numbers", check_col="same"), model, "numbers", "back")
    assert out.columns == [*frame(spark, []).columns, "numbers", "same", "back"]
    for r in out.collect():
        if r.text is None:
            assert r.numbers is None and r.back is None and r.same
        else:
            assert r.back == r.text.replace("▁", " ") and r.same == ("▁" not in r.text)
    assert encode(frame(spark, []), model).collect() == []
    bad = spark.createDataFrame([([99999, -1, None, 1],), (None,)], "ids array<int>")
    assert {r.decoded for r in decode(bad, model).collect()} == {None, "⁇  ⁇  ⁇ "}


# --- toxicity ----------------------------------------------------------------------------


def labelled(n=240):
    rng = random.Random(2)
    words = ["".join(rng.choices("abdeghilmnorstu", k=rng.randint(2, 7))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 60))
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["scumbag", "blockhead", "dimwit"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0), 1))
    return docs, labels


def test_toxic_texts_are_told_apart_on_held_out_rows(spark):
    docs, labels = labelled()
    df = frame(spark, docs + ODD + [(0, docs[0][1])])
    marks = spark.createDataFrame(labels + [(None, 1, 1), (801, 1, 1), (7, None, 1), (9, 5, 1)], "doc_id bigint, toxic int, x int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(df, marks.where(~held))
    scores = {r.doc_id: r.score for r in score(df, model).collect()}
    assert len(scores) == len(docs) + len(ODD) and all(0 <= s <= 1 for s in scores.values())
    test = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scores[i] >= 0.5) == (i % 4 == 0) for i in test)
    assert len(test) > 30 and right >= 0.95 * len(test)
    kept = keep_clean(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 0").count() in (0, 2)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}


def test_models_without_both_classes(spark):
    df, none = frame(spark, ODD), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score > 0.5 for r in score(df, train(df, none)).collect()} == {False}
    one = spark.createDataFrame([(805, 1)], "doc_id bigint, toxic int")
    assert {r.score > 0.5 for r in score(df, train(df, one)).collect()} == {True}
    assert score(df.limit(0), fit([], [], (3,), 10)).collect() == []


def plain_fit(examples, size, steps=60):
    """The same classifier on dense rows."""
    x = np.zeros((len(examples), size))
    for i, (_, slots) in enumerate(examples):
        x[i, slots] = 1
    y = np.array([label for label, _ in examples], float)
    ratio = np.log((x[y == 1].sum(0) + 1) / ((y == 1).sum() + 2)) - np.log((x[y == 0].sum(0) + 1) / ((y == 0).sum() + 2))
    x = x * ratio
    x /= np.sqrt((x**2).sum(1, keepdims=True)) + 1e-9
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, b, dw, db = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        dw, db = 0.9 * dw - 4 * (x.T @ error + 1e-4 * w), 0.9 * db - 4 * error.sum()
        w, b = w + dw, b + db
    return ratio, w, b


@pytest.mark.parametrize("at_once", [50, 8_000_000])
def test_fit_equals_a_plain_one(at_once):
    rng = np.random.default_rng(5)
    examples = [(int(i % 3 == 0), rng.choice(256, rng.integers(1, 60), replace=False)) for i in range(80)]
    packed = PackedSlots([PackedSlots.pack(s, 8) for _, s in examples], 8)
    assert all(sorted(a) == sorted(b) for a, (_, b) in zip(packed, examples, strict=True))
    model = fit([label for label, _ in examples], packed, (3,), 8, at_once=at_once)
    ratio, weight, bias = plain_fit(examples, 256)
    assert np.allclose(model.ratio, ratio, atol=1e-5) and np.allclose(model.weight, weight, atol=1e-4)
    assert model.bias == pytest.approx(bias, abs=1e-6)


def test_one_row_of_each_sampled_id_is_fitted_on(spark, monkeypatch):
    docs = [(i % 2, f"text {i} " + ("scumbag" if i % 2 else "fine")) for i in range(20_000)]
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda labels, slots, *rest: seen.extend(labels))
    train(frame(spark, docs), spark.createDataFrame([(0, 0), (1, 1)], "doc_id bigint, toxic int"))
    assert seen == [0, 1]


def test_slots_are_distinct_and_the_same_in_every_run():
    hasher = GramHasher((3, 5), 12)
    first = hasher.slots("An Example an example")
    assert len(set(first.tolist())) == len(first)
    assert sorted(first) == sorted(GramHasher((3, 5), 12).slots("an example AN\texample"))
    assert len(hasher.slots("")) == len(hasher.slots(None)) == 0 and len(hasher.slots("a")) > 0


# --- mixing ------------------------------------------------------------------------------


def two_kinds(n=300):
    rng = random.Random(4)
    plain = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40)) + "."
    loud = lambda: "!! ".join("".join(rng.choices("ABCDEFGHIJ", k=5)) for _ in range(30)) + "#1"
    docs = [(i, loud() if i % 5 == 0 else plain()) for i in range(n)]
    labels = [(i, "poor" if i % 5 == 0 else "good") for i in range(0, n, 2)]
    return docs, labels + [(None, "good"), (3, None), (5, "unheard of")]


@pytest.mark.parametrize("min_rate", [0.0, 1.0])
def test_rates_meet_the_targets(spark, min_rate):
    docs, labels = two_kinds()
    df, marks = frame(spark, docs + ODD[:4]), spark.createDataFrame(labels, "id bigint, domain string")
    out = document_rates(df, marks, {"good": 0.5, "poor": 0.5}, min_rate=min_rate).collect()
    assert len(out) == len(docs) + 4 and all(r.rate >= min_rate for r in out)
    given = [sum(r.tokens * r.rate * r.posteriors[d] for r in out) for d in (0, 1)]
    assert given[0] / sum(given) == pytest.approx(0.5, abs=0.01)
    if not min_rate:
        assert sum(given) == pytest.approx(sum(r.tokens for r in out), rel=1e-3)
    assert {r.tokens for r in out if r.doc_id in (801, 802, 803)} == {0}
    guess = {r.doc_id: r.domains[int(np.argmax(r.posteriors))] for r in out if r.doc_id is not None and r.doc_id < 300}
    assert all(d == ("poor" if i % 5 == 0 else "good") for i, d in guess.items())


def least_squares(tokens, p, target, weight):
    """Plain coordinate descent for rates of 0 or more: the smallest weighted square of what is missed."""
    low = np.linalg.cholesky(weight).T
    a, b = low @ (p * tokens[:, None]).T, low @ target
    rates = np.ones(len(tokens))
    miss = a @ rates - b
    for _ in range(2000):
        for j in range(len(tokens)):
            new = max(0.0, rates[j] - a[:, j] @ miss / (a[:, j] @ a[:, j]))
            miss += a[:, j] * (new - rates[j])
            rates[j] = new
    return miss @ miss


@pytest.mark.parametrize("weights, reached", [([0.5, 0.3, 0.2], True), ([0.96, 0.02, 0.02], False)])
def test_rates_against_a_plain_solver(spark, weights, reached):
    rng = np.random.default_rng(7)
    p = 0.1 + 0.7 * rng.dirichlet([0.6] * 3, size=80)
    tokens = rng.integers(1, 400, size=80).astype(float)
    rows = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p)], "tokens bigint, p array<double>")
    names = ["a", "b", "c"]
    mix = fit_mix(rows, Classifier(names, [], []), dict(zip(names, weights)))
    got = rows.select("tokens", "p", mix.rate(F.col("p")).alias("rate")).collect()
    assert all(r.rate >= 0 for r in got)
    totals = sum(r.rate * r.tokens * np.array(r.p) for r in got)
    assert totals == pytest.approx(np.array(mix.totals), rel=1e-6)
    target = np.array(weights) * (tokens[:, None] * p).sum()
    assert target == pytest.approx(np.array(mix.targets))
    matrix = (p * tokens[:, None]).T @ p
    weight = np.linalg.inv(matrix + np.eye(3) * 1e-3 * np.trace(matrix) / 3)
    missed, best = (totals - target) @ weight @ (totals - target), least_squares(tokens, p, target, weight)
    scale = target @ weight @ target
    # targets out of reach are approached slowly: the 40 steps end within 1 % of the squared target
    assert best - 1e-9 * scale <= missed <= best + (1e-9 if reached else 0.01) * scale
    assert (best < 1e-9 * scale) == reached


def test_mixed_documents(spark):
    docs, labels = two_kinds()
    df, marks = frame(spark, docs + ODD[:4]), spark.createDataFrame(labels, "id bigint, domain string")
    out = mix_documents(df, marks, {"good": 0.5, "poor": 0.5}, min_rate=1.0)
    assert out.columns == df.columns
    rows = out.collect()
    count = {i: sum(r.doc_id == i for r in rows) for i, _ in docs}
    assert min(count.values()) >= 1
    tokens = [sum(len(t.split()) * count[i] for i, t in docs if (i % 5 == 0) == poor) for poor in (True, False)]
    assert tokens[0] / sum(tokens) == pytest.approx(0.5, abs=0.05)
    assert mix_documents(frame(spark, []), marks, {"good": 1.0}).collect() == []
    assert mix_documents(df, marks.limit(0), {"good": 1.0, "poor": 0.0}).count() >= 0


def test_a_task_gives_free_memory_back_at_its_end(monkeypatch):
    from vouch.llm import batches

    calls = []
    monkeypatch.setattr(batches, "_release", lambda: calls.append(1))
    task = batches.released(lambda rows: (row + 1 for row in rows))([1, 2])
    assert next(task) == 2 and not calls
    assert list(task) == [3] and calls == [1]

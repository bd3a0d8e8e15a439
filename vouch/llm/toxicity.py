"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouch.llm.batches import bound_batches, values
from vouch.llm.grams import GramHasher

# Labelled rows of each class that the classifier is fitted on.
SAMPLE_PER_CLASS = 768


@dataclass(frozen=True)
class Model:
    """``ratio`` scales a feature, ``weight`` is its weight; both have one value per slot."""

    orders: tuple[int, ...]
    bits: int
    ratio: np.ndarray
    weight: np.ndarray
    bias: float


_SLOTS_AT_ONCE = 8_000_000  # slots of examples that the fit holds as numbers


class PackedSlots(Sequence):
    """Slots of examples, each as a list or, where that is longer, as a bitmap of all slots."""

    def __init__(self, packed: list[bytes], bits: int):
        self._packed, self._bitmap = packed, (1 << bits) // 8

    @staticmethod
    def pack(slots: np.ndarray, bits: int) -> bytes:
        if 4 * len(slots) < (1 << bits) // 8:
            return slots.astype(np.int32).tobytes()
        held = np.zeros(1 << bits, np.uint8)
        held[slots] = 1
        return np.packbits(held).tobytes()

    def __len__(self) -> int:
        return len(self._packed)

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self._packed[i]
        if len(raw) < self._bitmap:
            return np.frombuffer(raw, np.int32).astype(np.int64)
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def _parts(slots: Sequence[np.ndarray], ratio: np.ndarray, most: int):
    """A function that gives the examples' features in parts: first row, rows, row and slot and value of each."""

    def made():
        first, held, size = 0, [], 0
        for i in range(len(slots)):
            held.append(slots[i])
            size += len(held[-1])
            if size > most or i + 1 == len(slots):
                row = np.repeat(np.arange(len(held)), [len(s) for s in held])
                flat = np.concatenate(held)
                value = ratio[flat]
                value /= (np.sqrt(np.bincount(row, value**2, len(held))) + 1e-9)[row]
                yield first, len(held), row, flat, value
                first, held, size = i + 1, [], 0

    if sum(len(s) for s in slots) <= most:
        once = list(made())
        return lambda: once
    return made


def fit(
    labels: list[int], slots: Sequence[np.ndarray], orders: tuple[int, ...], bits: int, steps: int = 60, at_once: int = _SLOTS_AT_ONCE
) -> Model:
    """Naive Bayes log-count ratios, then logistic regression on the scaled features.

    The feature vector of a text holds the ratio of each n-gram it contains and is scaled
    to length 1.  Classes weigh the same.  Without texts of both classes the
    model scores 1 (only toxic ones) or 0.  Features are held ``at_once`` slots at a time.
    """
    size = 1 << bits
    y = np.asarray(labels, dtype=np.float64)
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    if not n_pos or not n_neg:
        none = np.zeros(size, np.float32)
        return Model(orders, bits, none, none, 40.0 if n_pos else -40.0)
    counts = np.ones((2, size))
    for label, s in zip(labels, slots, strict=True):
        counts[label, s] += 1
    ratio = np.log(counts[1] / (n_pos + 2)) - np.log(counts[0] / (n_neg + 2))
    parts = _parts(slots, ratio, at_once)
    weight, speed = np.zeros(size), np.zeros(size)
    bias = bias_speed = 0.0
    share = np.where(y == 1, 0.5 / n_pos, 0.5 / n_neg)
    for _ in range(steps):  # gradient steps with momentum
        slope, bias_slope = np.zeros(size), 0.0
        for first, rows, row, flat, value in parts():
            z = np.bincount(row, value * weight[flat], rows) + bias
            error = (1 / (1 + np.exp(-z)) - y[first : first + rows]) * share[first : first + rows]
            slope += np.bincount(flat, value * error[row], size)
            bias_slope += error.sum()
        speed = 0.9 * speed - 4.0 * (slope + 1e-4 * weight)
        bias_speed = 0.9 * bias_speed - 4.0 * bias_slope
        weight += speed
        bias += bias_speed
    return Model(orders, bits, ratio.astype(np.float32), weight.astype(np.float32), float(bias))


def _slot_rows(orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = GramHasher(orders, bits)
        for batch in batches:
            for i, text in enumerate(values(batch.column("text"))):
                slots = PackedSlots.pack(hasher.slots(text), bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(i, 1), pa.array([slots], pa.binary())],
                    names=["label", "slots"],
                )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_per_class: int = SAMPLE_PER_CLASS,
    orders: tuple[int, ...] = (3, 5),
    bits: int = 17,
) -> Model:
    """Fit on at most ``sample_per_class`` labelled rows of each class, whole texts.

    The sample is the ids with the smallest hash, the same for every layout of the tables, and one row
    of each: that with the smallest hash of its text.  Rows without id, text or a label 0 or 1 are no examples; an id labelled
    twice counts as toxic if it is so once.  Only the bounded list of sampled ids is
    broadcast, and only their texts are shuffled, one per id and task.  The driver gets
    ``2 * sample_per_class`` rows of ``2 ** bits / 8`` bytes at most.
    """
    one = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    spark = docs.sparkSession
    bound_batches(spark)
    picked = [
        row
        for label in (0, 1)
        for row in one.where(F.col("label") == label)
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_per_class)
        .collect()
    ]
    if not picked:
        return fit([], [], orders, bits)
    chosen = F.broadcast(spark.createDataFrame(picked, one.schema))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = (
        texts.join(chosen, "id")
        .groupBy("id", "label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
        .select("label", F.col("one.text").alias("text"))
        .mapInArrow(_slot_rows(orders, bits), "label int, slots binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["label"], r["slots"]))  # one order, so that sums end in the same bits
    return fit([r["label"] for r in rows], PackedSlots([bytes(r["slots"]) for r in rows], bits), orders, bits)


class Scorer:
    """Scores of the texts of a column."""

    def __init__(self, model: Model):
        self._hasher = GramHasher(model.orders, model.bits)
        self._ratio, self._product, self._bias = model.ratio, model.ratio * model.weight, model.bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self._bias)
        for i, text in enumerate(values(texts)):
            slots = self._hasher.slots(text)
            if len(slots):
                length = np.sqrt(np.square(self._ratio[slots], dtype=np.float64).sum()) + 1e-9
                z[i] += self._product[slots].sum(dtype=np.float64) / length
        return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``: the probability of label 1 of each whole text, row by row.

    Null and empty texts have no features and get the score of the bias.  Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits slots, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {id_type}, score double")
        .withColumnRenamed("id", id_col)
    )


def keep_clean(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` scoring below ``threshold``, all their columns unchanged.

    Scores in the same pass: no join back, so repeated rows and rows without id keep their own verdict.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer(batch.column(at))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)

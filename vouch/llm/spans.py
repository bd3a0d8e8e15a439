"""Substring dedup on sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vouch.llm.batches import bound_batches, released
from vouch.session import materialize

# A sentence with the marks and white space that end it; all of them joined give the text.
_PIECE = re.compile(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*")
_ROWS_AT_ONCE = 200_000


class Spans:
    """Runs of consecutive sentences of a text.

    Of all runs of ``min_sentences`` sentences and ``min_words`` words or more, those that hold no smaller one at their end
    or at their start are taken: the shortest from each sentence on, and the shortest up to each sentence.
    A longer run is covered by them, so a repeated passage is marked from its first to its last sentence if it holds
    any run whole.  Passages of fewer words or sentences are no runs.  Case and the amount of white space don't count.
    """

    def __init__(self, min_sentences: int = 2, min_words: int = 20):
        if min_sentences < 1 or min_words < 0:
            raise ValueError("a span needs one sentence at least")
        self.min_sentences, self.min_words = min_sentences, min_words

    def __call__(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The sentences; for each run its start, end and 128-bit hash as two signed columns."""
        found = _PIECE.findall(text) if text else []
        plain = [" ".join(p.split()) for p in found] if len(found) < self.min_sentences else None
        if plain is not None:
            none = np.zeros(0, np.int64)
            return found, none, none, np.zeros((0, 2), np.int64)
        plain = [" ".join(p.lower().split()) for p in found]
        words = np.concatenate([[0], np.cumsum([p.count(" ") + 1 if p else 0 for p in plain])])
        start = np.arange(len(plain) - self.min_sentences + 1)
        end = np.maximum(np.searchsorted(words, words[start] + self.min_words), start + self.min_sentences)
        inside = end <= len(plain)
        start, end = start[inside], end[inside]
        last = np.arange(self.min_sentences, len(plain) + 1)
        first = np.minimum(
            np.searchsorted(words, words[last] - self.min_words, side="right") - 1, last - self.min_sentences
        )
        last, first = last[words[last] >= self.min_words], first[words[last] >= self.min_words]
        both = np.unique(np.append(start, first) * (len(plain) + 1) + np.append(end, last))
        start, end = np.divmod(both, len(plain) + 1)
        hashes = b"".join(
            xxhash.xxh3_128_digest("\n".join(plain[i:j]).encode("utf-8", "replace"))
            for i, j in zip(start.tolist(), end.tolist(), strict=True)
        )
        return found, start, end, np.frombuffer(hashes, np.int64).reshape(-1, 2)


def _span_rows(spans: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list, parts: list) -> pa.RecordBatch:
            h = np.concatenate(parts)
            key = np.repeat(np.array(keys, np.int64), [len(p) for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["key", "h1", "h2"]
            )

        for batch in batches:
            keys, parts, rows = [], [], 0
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                h = spans(text.as_py())[3]
                if len(h):
                    keys.append(key)
                    parts.append(h[np.unique(h[:, 0], return_index=True)[1]])
                    rows += len(parts[-1])
                if rows > _ROWS_AT_ONCE:
                    yield out(keys, parts)
                    keys, parts, rows = [], [], 0
            if parts:
                yield out(keys, parts)

    return run


def _cleaner(spans: Spans, at: int, columns: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, lost = [], [], []
            for text, later in zip(batch.column(at), batch.column(columns), strict=True):
                text = text.as_py()
                found, start, end, h = spans(text)
                hit = np.zeros(len(found) + 1, np.int64)
                if len(start):
                    repeated = np.ones(len(start), bool)
                    repeated[np.unique(h[:, 0], return_index=True)[1]] = False
                    if later.is_valid:
                        repeated |= np.isin(h[:, 0], later.values.to_numpy())
                    np.add.at(hit, start[repeated], 1)
                    np.add.at(hit, end[repeated], -1)
                gone = np.cumsum(hit)[: len(found)] > 0
                total.append(len(found))
                lost.append(int(gone.sum()))
                texts.append("".join(p for p, g in zip(found, gone, strict=True) if not g) if lost[-1] else text)
            out = [batch.column(i) for i in range(columns)]
            out[at] = pa.array(texts, out[at].type)
            names = batch.schema.names[:columns]
            if counts:
                out += [pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
                names = [*names, "n_sentences", "n_removed"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _key(id_col: Column, text: Column) -> Column:
    """A document's place in the order: its id; without one, after the others by its text's hash."""
    late = F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    return F.coalesce(id_col.cast("bigint"), late)


def remove_repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_sentences: int = 2,
    min_words: int = 20,
    counts: bool = False,
) -> DataFrame:
    """``docs`` with the sentences taken out that lie in a repeated span, save its first occurrence.

    The first occurrence of a span (see ``Spans``) is in the document with the smallest id,
    and there at the first place.  A sentence that goes has a copy at an earlier place,
    so one copy always stays; in a text that only repeats itself that is the first sentences of the first span.
    Rows and other columns stay as they are, whatever they are called; a text may become
    empty; null and empty texts have no spans.  Rows that share an id count as one
    document, rows without id as one for each text.  With ``counts`` the columns
    ``n_sentences`` and ``n_removed`` follow.

    Spans are joined by 128-bit hashes.  The first pass finds repeated ones by an
    aggregate that keeps two ids of each; the second lists, per document, those that
    another document has first.
    """
    bound_batches(docs.sparkSession)
    spans = Spans(min_sentences, min_words)
    at, n = docs.columns.index(text_col), len(docs.columns)
    # columns by position, as their names may be anything
    own = docs.toDF(*[f"c{i}" for i in range(n)])
    own = own.withColumn("key", _key(F.col(f"c{docs.columns.index(id_col)}"), F.col(f"c{at}")))
    rows = own.select("key", F.col(f"c{at}").alias("text")).mapInArrow(
        released(_span_rows(spans)), "key bigint, h1 bigint, h2 bigint"
    )
    repeats = rows.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    repeats = materialize(repeats.where("first < last").drop("last"), "repeats")
    later = rows.join(repeats, ["h1", "h2"]).where("key <> first").groupBy("key").agg(
        F.collect_list("h1").alias("later")  # at most the spans of one document
    )
    later = materialize(later, "later").withColumnRenamed("key", "k")
    joined = own.join(later, F.col("key") == F.col("k"), "left").drop("key", "k")
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    if counts:
        schema += ", n_sentences bigint, n_removed bigint"
    names = docs.columns + (["n_sentences", "n_removed"] if counts else [])
    return joined.mapInArrow(released(_cleaner(spans, at, n, counts)), schema).toDF(*names)

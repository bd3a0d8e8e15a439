"""SentencePiece encoding and decoding of text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vouch.llm.batches import bound_batches
from vouch.llm.pieces import Decoder, Encoder, PieceModel

TEXTS_AT_ONCE = 1024
_CHARS_AT_ONCE = 1_500_000


def load_model(spark, path: str) -> PieceModel:
    """The model file at ``path``, which any store that Spark reads may hold."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    return PieceModel.load(bytes(content["content"]))


def _plan(docs: DataFrame, column: str, added: str, kind: str) -> tuple[DataFrame, str, int, list[str]]:
    """Columns by position, as their names may clash, and the schema with ``added`` at the end."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return own, f"{schema}, added {kind}", docs.columns.index(column), [*docs.columns, added]


def encode(
    docs: DataFrame, model: PieceModel, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None
) -> DataFrame:
    """``docs`` and, as the last column, the ids of each whole text.

    Ids equal those of the ``sentencepiece`` library for the same model file; in a
    unigram model another path of the same total may be taken.  A null text has null ids, an empty one none.
    Characters without a piece become their UTF-8 bytes if the model has byte pieces.  With ``check_col`` a
    column follows that tells whether decoding the ids gives the text back (nulls do).
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, chars = [], 0
                for value in batch.column(at).slice(start, TEXTS_AT_ONCE):
                    texts.append(value.as_py())
                    chars += len(texts[-1] or "")
                    if chars > _CHARS_AT_ONCE:
                        break
                ids, offsets = encoder(texts)
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()), mask=null)
                part = batch.slice(start, len(texts))
                added = {"added": lists}
                if check_col:
                    same = [t is None or decoder(ids[a:b]) == t for t, a, b in zip(texts, offsets, offsets[1:], strict=False)]
                    added["same"] = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *added.values()], names=[*part.schema.names, *added]
                )
                start += len(texts)

    own, schema, at, names = _plan(docs, text_col, ids_col, "array<int>")
    if check_col:
        schema, names = f"{schema}, same boolean", [*names, check_col]
    return own.mapInArrow(run, schema).toDF(*names)


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` and, as the last column, the text of each list of ids.

    Encoding and decoding give a text back as it was, save that U+2581 in it becomes a space.
    Null lists have null texts; null ids in a list count as unknown.
    """
    bound_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = []
            for value in batch.column(at):
                if value.is_valid:
                    ids = value.values.fill_null(-1).to_numpy(zero_copy_only=False)
                    texts.append(decoder(ids))
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "added"]
            )

    own, schema, at, names = _plan(encoded, ids_col, text_col, "string")
    return own.mapInArrow(run, schema).toDF(*names)

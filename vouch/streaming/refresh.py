"""Import of new result files with Structured Streaming.

Result files dropped into a folder are read once each; every batch is upserted into the
store, so that a re-run of the import is an increment instead of a full reload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from vouch.plans.ingest import import_into
from vouch.sources.entries import entries_from_lines
from vouch.sources.tables import TableStore


def refresh(store: TableStore, folder: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Import the files in ``folder`` (one JSON object per line) not imported yet, then stop.

    A batch repeated after a failure replaces the same rows, as the store is keyed.
    """
    lines = (
        store.spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(
            "value",
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        # of equal keys the newer file counts, however the files were packed into tasks
        seq = F.struct("modified", "file", "block", F.monotonically_increasing_id().alias("row"))
        numbered = batch.select(seq.alias("seq"), F.col("value").alias("line"))
        import_into(store, entries_from_lines(numbered))

    return (
        lines.writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

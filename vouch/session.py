"""Session settings, the shared work folder and written intermediate tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows that may be collected to the driver or hinted for broadcast.  Outside `llm`, whose
# operators state their own bounds, broadcast hints follow from a check of rows or of bytes.
SMALL_ROWS = 20_000
# The same for written tables of any number of rows: bytes of their files.
SMALL_BYTES = 32 << 20
# Within `least_partitions`: bytes of files that a task reads, and of shuffled data up to which partitions are put together.
# Words counted in memory take ten to twenty times as much as shuffled.
TASK_READS, TASK_MOVES = 16 << 20, 8 << 20


def session(app: str = "vouch", **conf: str) -> SparkSession:
    """A session with the settings the jobs here were planned for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # long IN lists reach the Parquet reader value by value, not as min..max
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
        # texts can be long, so Arrow batches hold fewer of them
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        # a repeated key in a JSON object keeps its last value
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/work").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true
    size of the table, so that a small one is broadcast and a large one is not.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def setting_bytes(spark: SparkSession, name: str) -> int:
    """A setting that is a number of bytes with or without a unit; -1 where it turns something off."""
    value = spark.conf.get(name)
    if value.lstrip("-").isdigit():
        return int(value)
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


@contextmanager
def least_partitions(spark: SparkSession, parts: int):
    """Tasks of the jobs run within follow ``parts`` and fixed bounds, not the table and the cores.

    Shuffles have ``parts`` partitions or more; as they run, small ones are put together up to ``TASK_MOVES`` bytes, and
    scans up to ``TASK_READS``, where the usual bounds are far larger and reached as tables grow.
    """
    shuffles = "spark.sql.shuffle.partitions"
    moves, reads = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    usual = {name: spark.conf.get(name) for name in (shuffles, moves, reads)}
    spark.conf.set(shuffles, str(max(int(usual[shuffles]), parts)))
    spark.conf.set(moves, f"{min(setting_bytes(spark, moves), TASK_MOVES)}b")
    spark.conf.set(reads, f"{min(setting_bytes(spark, reads), TASK_READS)}b")
    try:
        yield
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def file_bytes(df: DataFrame) -> int:
    """Bytes in the folders of the files that ``df`` is read from."""
    spark = df.sparkSession
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    folders = [path(folder) for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}]
    return sum(f.getFileSystem(conf).getContentSummary(f).getLength() for f in folders)

"""Keyed tables as Parquet snapshots under one root folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vouch.operators.upsert import replace_rows
from vouch.schemas import KEYS, SCHEMAS, conform, empty
from vouch.session import file_bytes

SHARD_BYTES = 1 << 30
LEAST_SHARDS = 8
# bytes of files whose rows a task sorts; a larger shard is written by several tasks, a file each
TASK_BYTES = 16 << 20

# one row per shard folder of a snapshot, so at most as many as there are shards
FOLDERS = "commit string, shard int"


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class TableStore:
    """``places`` and ``reviews`` below ``root``.

    Rows are spread over shards by a hash of their key and sorted by key inside, so that a
    join from a few keys reads only their folders (dynamic partition pruning) and only the
    pages holding them.  A snapshot is a list of shard folders: an upsert writes the
    shards of its keys anew and takes the other folders over as they are.  A reader keeps
    its snapshot while a writer commits the next one.

    ``shards`` is the number for a new table or a full commit; None derives it from the
    size of the files that the rows come from, about 1 GB each.
    """

    spark: SparkSession
    root: str
    shards: int | None = None

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        if not files.exists(path):
            return []
        return sorted(status.getPath().toString() for status in files.listStatus(path))

    def snapshots(self, name: str) -> list[str]:
        """Finished snapshots, oldest first."""
        files = self._files()
        lists = self._children(f"{self.root}/{name}/snapshots")
        return [path for path in lists if files.exists(self._path(f"{path}/_SUCCESS"))]

    def _folders(self, snapshot: str) -> list[tuple[str, int]]:
        rows = self.spark.read.schema(FOLDERS).parquet(snapshot).collect()
        return [(row["commit"], row["shard"]) for row in rows]

    def read(self, name: str) -> DataFrame:
        """The newest snapshot; an empty table when there is none."""
        existing = self.snapshots(name)
        if not existing:
            return empty(self.spark, SCHEMAS[name])
        schema = StructType([*SCHEMAS[name].fields, StructField("shard", IntegerType())])
        data = f"{self.root}/{name}/data"
        paths = [f"{data}/commit={c}/shard={s}" for c, s in self._folders(existing[-1])]
        if paths:
            table = self.spark.read.schema(schema).option("basePath", data).parquet(*paths)
        else:
            table = empty(self.spark, schema)
        table = table.select(*schema.fieldNames())
        return table.withMetadata("shard", {"shards": _shards_in(existing[-1])})

    def _write(
        self, name: str, df: DataFrame, shards: int, others: list[tuple[str, int]], size: int
    ) -> DataFrame:
        commit = uuid.uuid4().hex
        target = f"{self.root}/{name}/data/commit={commit}"
        # rows of about `size` bytes fall into the shards that are written, all but `others`
        parts = -(-size // (max(1, shards - len({shard for _, shard in others})) * TASK_BYTES))
        write_sharded(df, KEYS[name], shards, target, parts)
        written = [path.rsplit("=", 1)[1] for path in self._children(target) if "/shard=" in path]
        folders = [*others, *[(commit, int(shard)) for shard in written]]
        every = self._children(f"{self.root}/{name}/snapshots")
        number = int(every[-1].rsplit("/", 1)[1].split("-")[1]) + 1 if every else 1
        snapshot = f"{self.root}/{name}/snapshots/snapshot-{number:08d}-shards-{shards}"
        # the list comes last: a commit that fails before it leaves the table as it was
        self.spark.createDataFrame(folders, FOLDERS).coalesce(1).write.parquet(snapshot)
        return self.read(name)

    def commit(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as the whole table and return it; also the way to change ``shards``."""
        size = file_bytes(df)
        shards = self.shards or max(LEAST_SHARDS, -(-size // SHARD_BYTES))
        return self._write(name, conform(df, SCHEMAS[name]), shards, [], size)

    def upsert(self, name: str, fresh: DataFrame) -> DataFrame:
        """Replace or add the rows ``fresh``, one per key, and return the table.

        Reads and writes only the shards of their keys.  ``fresh`` is evaluated twice: give a
        written table.
        """
        table, key = self.read(name), KEYS[name]
        shards = shard_count(table)
        if not shards:
            return self.commit(name, fresh)
        rows = conform(fresh, SCHEMAS[name])
        touched = {
            row["shard"] for row in rows.select(shard_of(F.col(key), shards).alias("shard")).distinct().collect()
        }
        if not touched:
            return table
        others = [(c, s) for c, s in self._folders(self.snapshots(name)[-1]) if s not in touched]
        stored = table.filter(F.col("shard").isin(sorted(touched)))
        size = file_bytes(fresh) + file_bytes(stored)
        return self._write(name, replace_rows(stored, rows, key), shards, others, size)

    def expire(self, name: str, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` snapshots, and the shards only they hold.

        Call it when no reader uses them any more.
        """
        if keep < 1:
            raise ValueError("keep must be at least 1")
        files, existing = self._files(), self.snapshots(name)
        used = {folder for path in existing[-keep:] for folder in self._folders(path)}
        old = {folder for path in existing[:-keep] for folder in self._folders(path)}
        for path in existing[:-keep]:
            files.delete(self._path(path), True)
        for commit, shard in old - used:
            files.delete(self._path(f"{self.root}/{name}/data/commit={commit}/shard={shard}"), True)

    def lookup(self, name: str, key: str) -> DataFrame:
        """The row with this key, if any; reads one shard."""
        column = KEYS[name]
        table = self.read(name)
        found = table.filter(F.col(column) == key)
        shards = shard_count(table)
        if shards:
            found = found.filter(F.col("shard") == shard_of(F.lit(key), shards))
        return found.drop("shard")


def _shards_in(path: str) -> int:
    return int(path.rsplit("-", 1)[1])


def write_sharded(df: DataFrame, key: str, shards: int, path: str, parts: int = 1) -> None:
    """Rows in a folder per shard, each written by ``parts`` tasks as files sorted by key."""
    parts = max(1, parts)
    part = F.pmod(F.hash(key), F.lit(parts))
    (
        df.withColumn("shard", shard_of(F.col(key), shards))
        .repartitionById(shards * parts, F.col("shard") * parts + part)
        .sortWithinPartitions("shard", key)
        .write.partitionBy("shard")
        .option("maxRecordsPerFile", 5_000_000)
        .parquet(path)
    )


def shard_count(table: DataFrame) -> int:
    """Number of shards of a table read from a store, 0 for any other table."""
    if "shard" not in table.columns:
        return 0
    return table.schema["shard"].metadata.get("shards", 0)


def keyed_join(left: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to a keyed table; the shard joins too, so that few keys read few shards."""
    shards = shard_count(table)
    if not shards:
        return left.join(table, key, how)
    located = left.withColumn("shard", shard_of(F.col(key), shards))
    return located.join(table, ["shard", key], how).drop("shard")

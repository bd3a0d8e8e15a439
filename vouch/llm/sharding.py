"""Minimax contiguous partition of atomic groups into shards."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window, functions as F

from vouch.session import materialize

TRIES = 128  # capacities tested at once

_LAST = 2**63 - 1


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """Written in order over ranges: ``range`` numbers them, rows inside are sorted."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _few_rows(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of whole numbers given by the driver, as literals of a query."""
    if not rows:
        return spark.sql(f"SELECT * FROM VALUES ({', '.join('0L' for _ in columns.split(','))}) AS t({columns}) WHERE false")
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})"))


class _Sizes:
    """Running sums of ordered groups: totals of the ranges here, the rest in a table."""

    def __init__(self, groups: DataFrame):
        ordered = materialize(
            _ranges(groups, "first", "first_row").withColumn("range", F.spark_partition_id()), "ordered"
        )
        # a row for each range: as many as there are shuffle partitions
        sums = ordered.groupBy("range").agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m")).orderBy("range").collect()
        self.ranges = [r["range"] for r in sums]
        self.ends, before, total = [], [], 0
        for r in sums:
            before.append((r["range"], total))
            total += r["b"]
            self.ends.append(total)
        self.total, self.largest = total, max([0, *(r["m"] for r in sums)])
        spark = groups.sparkSession
        offsets = _few_rows(spark, "range, offset", before)
        so_far = F.sum("bytes").over(Window.partitionBy("range").orderBy("first", "first_row"))
        self.table = materialize(
            ordered.join(offsets, "range").select("g1", "g2", "g3", "range", (so_far + F.col("offset")).alias("upto")),
            "prefix",
        )

    def last_below(self, limits: list[int]) -> list[int]:
        """For each limit the largest running sum that doesn't exceed it, or 0."""
        out = [0] * len(limits)
        asked = []
        for i, limit in enumerate(limits):
            at = bisect_left(self.ends, limit + 1)
            out[i] = self.ends[at - 1] if at else 0
            if at < len(self.ends):
                asked.append((i, self.ranges[at], limit))
        if not asked:
            return out
        spark = self.table.sparkSession
        wanted = _few_rows(spark, "i, range, most", asked)  # TRIES rows at most
        some = self.table.where(F.col("range").isin(sorted({r for _, r, _ in asked})))
        rows = some.join(wanted, "range").where("upto <= most").groupBy("i").agg(F.max("upto").alias("upto"))
        for row in rows.collect():
            out[row["i"]] = max(out[row["i"]], row["upto"])
        return out

    def cuts(self, capacities: list[int], shards: int) -> list[list[int] | None]:
        """Greedy cuts for each capacity: every shard takes all groups that fit; None if some are left."""
        found = [[] for _ in capacities]
        for _ in range(shards):
            open_ = [i for i, c in enumerate(found) if not c or c[-1] < self.total]
            if not open_:
                break
            limits = [(found[i][-1] if found[i] else 0) + capacities[i] for i in open_]
            for i, cut in zip(open_, self.last_below(limits), strict=True):
                found[i].append(cut)
        return [c if c and c[-1] >= self.total else None for c in found]


def smallest_capacity(sizes: _Sizes, shards: int) -> list[int]:
    """The cuts of the smallest capacity with which greedy filling needs at most ``shards`` shards.

    A search by halving, ``TRIES`` capacities at a time as each test costs a pass per shard.  No capacity below
    the mean or the largest group can do; their mean plus the largest group always does.
    """
    low = max(-(-sizes.total // shards), sizes.largest) - 1
    high = -(-sizes.total // shards) + sizes.largest
    best = None
    while high - low > 1 or best is None:
        width = high - low
        tries = sorted({low + max(1, width * k // TRIES) for k in range(1, TRIES + 1)})
        results = sizes.cuts(tries, shards)
        first = next(i for i, r in enumerate(results) if r is not None)  # the last one is feasible
        best, high = results[first], tries[first]
        low = tries[first - 1] if first else low
    return best


def balanced_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``: one row per row of ``docs``, sizes near equal.

    Size: UTF-8 bytes of the text plus 1.  Rows of equal text are one group that is never cut; null texts are
    groups of their own, of size 1, with a null checksum.  Groups are ordered by their smallest id (null last)
    and cut where the largest shard is as small as any contiguous partition can make it, so a
    group larger than the mean decides it alone and later shards may stay empty.  ``slot`` numbers a shard's
    rows from 0 in order of their ids; rows of equal ids by their place in the input.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.col("text")
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = own.withColumn("row", F.monotonically_increasing_id())
    bare = text.isNull()
    rows = materialize(
        rows.select(
            "id",
            "row",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
            F.crc32(text).alias("crc"),
            F.when(bare, F.col("row")).otherwise(F.xxhash64(text)).alias("g1"),
            F.when(bare, F.lit(-1)).otherwise(F.crc32(text)).cast("bigint").alias("g2"),
            F.when(bare, F.lit(-1)).otherwise(F.xxhash64(F.lit(1), text)).cast("bigint").alias("g3"),
        ),
        "sizes",
    )
    groups = rows.groupBy("g1", "g2", "g3").agg(
        F.sum("size").alias("bytes"),
        F.min(F.coalesce("id", F.lit(_LAST))).alias("first"),
        F.min("row").alias("first_row"),
    )
    sizes = _Sizes(groups)
    cuts = smallest_capacity(sizes, shards) if sizes.total else [0]
    upto = F.col("upto")
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + F.when(upto > cut, 1).otherwise(0)
    placed = rows.join(sizes.table.drop("range"), ["g1", "g2", "g3"]).select(
        "id", "row", "size", "crc", shard.cast("int").alias("shard"), F.coalesce("id", F.lit(_LAST)).alias("by")
    )
    at = F.monotonically_increasing_id()
    placed = materialize(
        _ranges(placed, "shard", "by", "row")
        .withColumn("at", at)
        .withColumn("range", F.shiftright("at", 33).cast("int"))
        .withColumn("at", F.col("at").bitwiseAND(F.lit(2**33 - 1))),
        "placed",
    )
    counts = placed.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    offsets, seen = [], {}
    for c in counts.orderBy("range", "shard").collect():  # ranges plus shards at most
        offsets.append((c["range"], c["shard"], seen.get(c["shard"], 0) - c["start"]))
        seen[c["shard"]] = seen.get(c["shard"], 0) + c["n"]
    known = _few_rows(docs.sparkSession, "range, shard, offset", offsets)
    return placed.join(known, ["range", "shard"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") + F.col("offset")).alias("slot"),
    )

"""Exact ranked lexical search over impact vectors in buckets of falling length (LEMP)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from vouch.llm.batches import bound_batches
from vouch.session import materialize

BUCKET = 4096  # vectors of a bucket at most
ENTRIES = 1 << 20  # and their coordinates, unless one vector has more
ITEM_BYTES = 4 << 20  # text of the items that are searched for together
UNIT, SCALE, FLAT, SLOPE = 1_000_000_000, 1000, 8, 75  # fixed values of the score
_SEED = 4  # heaviest coordinates of a query that give its first threshold

# UTF-8 bytes: A-Z lower-cased, letters, digits and all bytes of other characters kept, the rest is space
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(_BYTES).split()


def _ragged(parts: list, kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *[len(p) for p in parts]]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def _count_rows(shared):
    """Per document: its id, number of terms, and the query terms it holds with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for start in range(0, len(texts), 256):
                n, tids, tfs = [], [], []
                for raw in texts.slice(start, 256):
                    words = terms_of(raw.as_py()) if raw.is_valid else []
                    held = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                    n.append(len(words))
                    tids.append(np.array([t for t, _ in held], np.int64))
                    tfs.append(np.array([c for _, c in held], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, 256),
                        pa.array(n, pa.int64()),
                        _ragged(tids, pa.int32()),
                        _ragged(tfs, pa.int64()),
                    ],
                    names=["doc_id", "n", "tid", "tf"],
                )

    return run


_BUCKETS = "longest double, ids binary, ends binary, tid binary, impact binary"


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of vectors in the order they come, the longest first."""
    ids, tids, impacts, size, longest = [], [], [], 0, 0.0

    def out() -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in tids])
        columns = [ids, ends, np.concatenate(tids), np.concatenate(impacts)]
        kinds = [np.int64, np.int64, np.int32, np.int32]
        packed = [pa.array([np.asarray(c, k).tobytes()], pa.binary()) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([longest]), *packed], names=["longest", "ids", "ends", "tid", "impact"]
        )

    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "tid", "impact", "length")]
        for doc_id, tid, impact, length in zip(*columns, strict=True):
            tid, impact = tid.values.to_numpy(), impact.values.to_numpy()
            if ids and (len(ids) == BUCKET or size + len(tid) > ENTRIES):
                yield out()
                ids, tids, impacts, size, longest = [], [], [], 0, 0.0
            ids.append(doc_id.as_py())
            tids.append(tid)
            impacts.append(impact)
            size += len(tid)
            longest = max(longest, length.as_py())
    if ids:
        yield out()


class Bucket:
    """Impact vectors of similar length, by row and by coordinate."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, tid: np.ndarray, impact: np.ndarray):
        self.ids, self.tid, self.impact = ids, tid, impact.astype(np.int64)
        self.start, self.end = np.append(0, ends[:-1]), ends
        self.square = np.add.reduceat(self.impact.astype(np.float64) ** 2, self.start)
        row = np.repeat(np.arange(len(ids)), self.end - self.start)
        order = np.argsort(tid, kind="stable")
        self.coords, first = np.unique(tid[order], return_index=True)
        self.first, self.last = first, np.append(first[1:], len(tid))
        self.row, self.value = row[order], self.impact[order]
        self.most = np.maximum.reduceat(self.value, first)  # per coordinate

    def search(self, tid: np.ndarray, q: np.ndarray, dense: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the vectors that may be among the best ``k``: scores of ``floor`` at least.

        ``tid, q`` are the query's coordinates and weights, ``dense`` the same over all coordinates.
        """
        at = np.searchsorted(self.coords, tid)
        at[at == len(self.coords)] = 0
        here = self.coords[at] == tid
        at, q = at[here], q[here]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(q):
            return none
        # heaviest coordinates first: by the most that they can add
        order = np.argsort(-(q * self.most[at]), kind="stable")
        at, q = at[order], q[order]
        longest = math.sqrt(self.square.max())
        left_q = np.sqrt(np.append(np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1], 0.0))
        left_most = np.append(np.cumsum((q * self.most[at])[::-1])[::-1], 0)
        if floor < 1:
            floor = 1
        # Cauchy-Schwarz over the whole bucket; then the fewest coordinates without which no vector reaches the floor
        bound = np.minimum(left_q * longest * (1 + 1e-9), left_most)
        if bound[0] < floor:
            return none
        focus = int(np.argmax(bound < floor)) if (bound < floor).any() else len(q)
        partial, seen = self._read(at[:focus], q[:focus])
        # coordinate bound of each vector met: what it has, and at most so much in the other coordinates
        rest = np.sqrt(np.maximum(self.square - seen, 0.0)) * left_q[focus] * (1 + 1e-9) + 1
        reach = partial + np.minimum(rest, left_most[focus])
        possible = np.flatnonzero((partial > 0) & (reach >= floor))
        if len(possible) > 4 * k:  # the best of them by what is known raise the floor for the others
            best = possible[np.argpartition(-partial[possible], 2 * k)[: 2 * k]]
            exact = self.rescore(best, dense)
            floor = max(floor, int(np.partition(exact, len(exact) - k)[len(exact) - k]))
            possible = possible[reach[possible] >= floor]
        return possible, self.rescore(possible, dense)

    def seed(self, tid: np.ndarray, q: np.ndarray, dense: np.ndarray, k: int) -> np.ndarray:
        """Exact scores of the vectors that look best by the query's heaviest coordinates, ``k`` at most."""
        heavy = np.argsort(-q, kind="stable")[:_SEED]
        at = np.searchsorted(self.coords, tid[heavy])
        at[at == len(self.coords)] = 0
        here = self.coords[at] == tid[heavy]
        partial, _ = self._read(at[here], q[heavy][here])
        met = np.flatnonzero(partial)
        if len(met) > k:
            met = met[np.argpartition(-partial[met], k - 1)[:k]]
        return self.rescore(met, dense)

    def _read(self, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weighted impacts over some coordinates, and of their squares, per vector."""
        size = self.last[at] - self.first[at]
        where = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        row, value = self.row[where], self.value[where]
        partial = np.bincount(row, value * np.repeat(q, size), len(self.ids))
        return partial, np.bincount(row, value.astype(np.float64) ** 2, len(self.ids))

    def rescore(self, at: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.int64)
        size = self.end[at] - self.start[at]
        offset = np.cumsum(size) - size
        where = np.repeat(self.start[at] - offset, size) + np.arange(size.sum())
        return np.add.reduceat(self.impact[where] * dense[self.tid[where]], offset)


def _search_rows(shared, k: int, seeding: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors, size = shared.value
        floors = dict(floors)
        dense = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, tid, impact = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), t)
                    for c, t in (("ids", np.int64), ("ends", np.int64), ("tid", np.int32), ("impact", np.int32))
                )
                bucket, found, longest = Bucket(ids, ends, tid, impact), [], batch.column("longest")[i].as_py()
                for item, (own, q, norm) in items.items():
                    floor = floors.get(item, 0)
                    if not seeding and norm * longest * (1 + 1e-9) < floor:
                        continue
                    dense[own] = q
                    if seeding:
                        scores = bucket.seed(own, q, dense, k)
                        at = np.arange(len(scores))
                    else:
                        at, scores = bucket.search(own, q, dense, k, floor)
                    dense[own] = 0
                    best = np.lexsort((bucket.ids[at], -scores))[:k]
                    best = best[scores[best] > 0]
                    if len(best) == k:  # holds for the buckets that follow in this task
                        floors[item] = max(floor, int(scores[best[-1]]))
                    found.append((item, bucket.ids[at[best]], scores[best]))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                            pa.array(np.concatenate([f[1] for f in found])),
                            pa.array(np.concatenate([f[2] for f in found])),
                        ],
                        names=["item_id", "doc_id", "score"],
                    )

    return run


def _item_blocks(items: DataFrame, most: int) -> list[list[tuple[int, dict[bytes, int]]]]:
    """The items with the counts of their terms, in blocks of at most ``most`` bytes of text where no item has more."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(1, -(-2 * total // most))
    block = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    blocks = []
    for number in range(parts):
        rows = items.where(block == number).orderBy("item_id").collect()
        blocks.append([(r["item_id"], Counter(terms_of((r["text"] or "").encode()))) for r in rows])
    return blocks


def _search_block(spark: SparkSession, docs: DataFrame, items: list, k: int) -> DataFrame | None:
    terms = sorted({t for _, counts in items for t in counts})
    if not terms:
        return None
    context = spark.sparkContext
    number = {t: i for i, t in enumerate(terms)}
    counted = materialize(
        docs.mapInArrow(_count_rows(context.broadcast(number)), "doc_id bigint, n bigint, tid array<int>, tf array<bigint>"),
        "counted",
    )
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    if not n_terms:
        return None
    # as many values as the block has terms
    held = counted.select(F.explode("tid").alias("tid")).groupBy("tid").count().collect()
    df = np.zeros(len(terms), np.int64)
    for row in held:
        df[row["tid"]] = row["count"]
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
    asked = {}
    for item, counts in items:
        own = np.array(sorted(number[t] for t in counts), np.int64)
        q = np.array([counts[terms[i]] * weight[i] for i in own], np.int64)
        own, q = own[q > 0], q[q > 0]
        if len(q):
            asked[item] = (own, q, float(np.sqrt((q.astype(np.float64) ** 2).sum())))

    m = F.expr(f"{100 - SLOPE} + ({SLOPE} * n * {n_docs}L) div {n_terms}L")
    vectors = (
        counted.where((F.size("tid") > 0) & F.col("doc_id").isNotNull())
        .select("doc_id", "tid", "tf", m.alias("m"))
        .withColumn("impact", F.expr(f"transform(tf, t -> ({UNIT}L * t) div ({SCALE} * t + {FLAT} * m))"))
        .withColumn("length", F.sqrt(F.aggregate("impact", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
        .select("doc_id", "tid", "impact", "length")
    )
    buckets = materialize(
        vectors.repartitionByRange(F.desc("length"), F.xxhash64("doc_id"))
        .sortWithinPartitions(F.desc("length"))
        .mapInArrow(_pack_rows, _BUCKETS),
        "buckets",
    )
    found = "item_id bigint, doc_id bigint, score bigint"
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    first = context.broadcast((asked, {}, len(terms)))
    seeds = buckets.mapInArrow(_search_rows(first, k, True), found).withColumn("rank", F.row_number().over(best))
    # one value per item of the block: the k-th best of some documents, so a bound for the k-th best of all
    floors = {r["item_id"]: r["score"] for r in seeds.where(F.col("rank") == k).collect()}
    shared = context.broadcast((asked, floors, len(terms)))
    return buckets.mapInArrow(_search_rows(shared, k, False), found)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for each item.

    A document is a vector of integer impacts ``(10**9 * tf) div (1000 * tf + 8 * m)``, an item one of counts times
    ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; the score is their product, equal ones by ascending id.

    Null and empty texts have no terms; such items and documents give no rows.  Documents without id count in the
    statistics and are not returned; repeated rows each take a rank.  Items without id are left out; of items that share an id
    the smallest text counts.  Other columns are ignored.  Empty tables give no rows.

    The items are taken in blocks of ``block_bytes`` of text, which the driver holds.  For each block the documents
    are read once; the vectors of the block's terms are dealt by length into buckets.  A first round scores the documents that hold the
    heaviest terms and gives each item a floor.  In the second a bucket is skipped if item length times vector length
    (Cauchy-Schwarz) stays below the floor; inside, only the coordinates without which the floor is out of
    reach are read, vectors are filtered by their own bound, and the others scored exactly.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    asked = (
        items.select(items[item_col].cast("bigint").alias("item_id"), items[item_text_col].cast("string").alias("text"))
        .where("item_id is not null")
        .groupBy("item_id")
        .agg(F.min("text").alias("text"))
    )
    found = [_search_block(spark, own, block, k) for block in _item_blocks(asked, block_bytes)]
    found = [f for f in found if f is not None]
    schema = "item_id bigint, doc_id bigint, score bigint"
    rows = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        rows = rows.unionByName(more)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

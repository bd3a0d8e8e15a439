"""Approximate nearest neighbours by inner product along shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vouch.session import materialize

CURVES = 24
CURVE_DIMS = 6  # projected dimensions of a curve
BITS = 10  # of each
REACH = 1024  # positions looked at on either side at least
RECALL = 0.95  # share of the sampled queries' true neighbours that the reach must cover
SAMPLE = 64  # queries of each length of vectors that are answered in full for it
BLOCK = 4096  # positions of a block at least
WIDEST = 32768  # and at most


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (integers below ``2 ** bits``) along the Hilbert curve.

    Skilling, *Programming the Hilbert curve* (2004), for all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(points: np.ndarray, curve: int) -> np.ndarray:
    """Keys of points of the unit ball on one curve: a random projection and a random shift, the same for all."""
    dims = points.shape[1]
    used = min(CURVE_DIMS, dims)
    rng = np.random.default_rng([dims, curve])
    axes, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    shift = rng.random(used)
    at = points @ axes[:, :used] * np.sqrt(dims)  # about normal with deviation 1
    cells = np.clip((at + 4 + shift) / 9 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


def _keys(longest: dict[int, float], curves: int):
    """Keys of every vector, and of queries apart: inner products become distances on a larger sphere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, asked, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "asked", "dims"))
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                flat = pa.concat_arrays([batch.column("v")[int(i)].values for i in mine])
                x = flat.to_numpy().reshape(-1, d) / longest[int(d)]
                norm = np.minimum(np.sqrt((x * x).sum(axis=1)), 1.0)
                points = np.column_stack([x, np.sqrt(1 - norm**2)])
                q = np.flatnonzero(asked[mine])
                targets = np.column_stack([x[q] / norm[q][:, None], np.zeros(len(q))])
                for c in range(curves):
                    keys = curve_keys(np.concatenate([points, targets]), c)
                    rows = np.concatenate([row[mine], row[mine][q]])
                    query = np.arange(len(keys)) >= len(points)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), d, np.int32)),
                            pa.array(np.full(len(keys), c, np.int32)),
                            pa.array(keys),
                            pa.array(rows),
                            pa.array(query),
                        ],
                        names=["dims", "curve", "key", "row", "query"],
                    )

    return run


def nearest(ids: np.ndarray, x: np.ndarray, barred: np.ndarray, q: np.ndarray, k: int, rough: np.ndarray):
    """Positions and scores of the best ``k``; ``rough`` scores only choose what is scored again, row by row."""
    fine = np.flatnonzero(~barred)
    if len(fine) > k:
        edge = np.partition(rough[fine], len(fine) - k)[len(fine) - k]
        fine = fine[rough[fine] >= edge - 1e-9 * (1 + abs(edge))]
    scores = (x[fine] * q).sum(axis=1)
    best = np.lexsort((ids[fine], -scores))[:k]
    return fine[best], scores[best]


def _windows(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        reach = key[2].as_py()
        query = table.column("query").to_numpy(zero_copy_only=False)
        at, rows = (table.column(c).to_numpy() for c in ("at", "row"))
        least = table.column("least").to_numpy()
        second, barred = (table.column(c).combine_chunks() for c in ("second", "barred"))
        lone, free = (c.is_null().to_numpy(zero_copy_only=False) for c in (second, barred))
        second, out_id = (c.fill_null(0).to_numpy() for c in (second, barred))
        x = table.column("v").combine_chunks()
        x = x.values.slice(x.offsets[0].as_py(), x.offsets[len(x)].as_py() - x.offsets[0].as_py())
        x = x.to_numpy().reshape(len(at), -1)
        order = np.argsort(at, kind="stable")
        cand, ask = order[~query[order]], order[query[order]]
        out = [[], [], [], [], [], []]
        places = at[cand]
        for start in range(0, len(ask), 64):
            some = ask[start : start + 64]
            lo, hi = np.searchsorted(places, [at[some[0]] - reach, at[some[-1]] + reach + 1])
            near = cand[lo:hi]
            slab = x[near]
            rough = x[some] @ slab.T
            rough[np.abs(at[some][:, None] - at[near][None, :]) > reach] = -np.inf
            for i, j in enumerate(some):
                inside = np.flatnonzero(rough[i] > -np.inf)
                these = near[inside]
                own = (least[these] == out_id[j]) & ~free[j]
                ids = np.where(own, second[these], least[these])
                found, scores = nearest(ids, slab[inside], own & lone[these], x[j], k, rough[i][inside])
                hit = these[found]
                out[0].append(np.full(len(hit), rows[j]))
                out[1].append(np.full(len(hit), out_id[j]))
                out[2].append(np.full(len(hit), free[j]))
                out[3].append(rows[hit])
                out[4].append(ids[found])
                out[5].append(scores)
        names = ["query_row", "barred", "free", "row", "first_id", "score"]
        types = [np.int64, np.int64, np.bool_, np.int64, np.int64, np.float64]
        return pa.table({n: np.concatenate([np.zeros(0, t), *o]).astype(t) for n, t, o in zip(names, types, out, strict=True)})

    return run


def _distinct(own: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct vectors, the rows that stand for each, and the queries.

    A vector's number is the ``row`` of its first member by id.  Members are as many as any query can need: its ``k + 1``
    smallest ids, of each ``k`` rows.  A query whose id has several vectors bars that id (``barred``); all others
    of one vector share one search.  Vectors are the same if their 128-bit hashes are.
    """
    same = ["dims", "h1", "h2"]
    rows = own.select("row", "vec_id", *same)
    copy = F.row_number().over(Window.partitionBy(*same, "vec_id").orderBy("row"))
    place = F.dense_rank().over(Window.partitionBy(*same).orderBy("vec_id"))
    members = rows.withColumn("copy", copy).where(F.col("copy") <= k).withColumn("place", place)
    members = materialize(members.where(F.col("place") <= k + 1), "members")
    first = (F.col("place") == 1) & (F.col("copy") == 1)
    # one row per vector: at most k (k + 1) members of each are read
    stands = members.groupBy(*same).agg(
        F.min(F.when(first, F.col("row"))).alias("rep"),
        F.min("vec_id").alias("least"),
        F.min(F.when(F.col("place") == 2, F.col("vec_id"))).alias("second"),
    )
    stands = materialize(stands, "stands")
    members = members.join(stands.select(*same, "rep"), same).select("rep", "vec_id", "row")
    once = F.row_number().over(Window.partitionBy("vec_id").orderBy("row"))
    asked = own.where("asked").select("vec_id", "row", *same)
    several = asked.groupBy("vec_id").agg((F.min(F.struct(*same)) != F.max(F.struct(*same))).alias("several"))
    queries = asked.withColumn("n", once).where("n = 1").join(several, "vec_id").join(stands.select(*same, "rep"), same)
    queries = materialize(
        queries.select(F.col("vec_id").alias("query_id"), "rep", F.when(F.col("several"), F.col("vec_id")).alias("barred")),
        "queries",
    )
    reps = stands.select(F.col("rep").alias("row"), "least", "second").join(own.select("row", "dims", "v"), "row")
    reps = reps.join(queries.select(F.col("rep").alias("row"), F.lit(True).alias("asked")).distinct(), "row", "left")
    return materialize(reps.withColumn("asked", F.coalesce("asked", F.lit(False))), "reps"), members, queries


def _true_neighbours(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The best ``k`` of a partition's rows for each sampled query, itself apart: all rows are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {}
        for batch in batches:
            row, dims = (batch.column(c).to_numpy() for c in ("row", "dims"))
            for d in np.unique(dims):
                if int(d) not in sample:
                    continue
                asked, q = sample[int(d)]
                mine = np.flatnonzero(dims == d)
                flat = pa.concat_arrays([batch.column("v")[int(i)].values for i in mine])
                scores = q @ flat.to_numpy().reshape(-1, d).T
                scores[asked[:, None] == row[mine][None, :]] = -np.inf
                rows = np.broadcast_to(row[mine], scores.shape)
                if d in kept:
                    scores, rows = np.hstack([kept[d][0], scores]), np.hstack([kept[d][1], rows])
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                kept[d] = np.take_along_axis(scores, best, 1), np.take_along_axis(rows, best, 1)
        for d, (scores, rows) in kept.items():
            asked = np.repeat(sample[int(d)][0], scores.shape[1])
            real = scores.ravel() > -np.inf
            columns = [np.full(len(asked), d, np.int32), asked, rows.ravel(), scores.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in columns], names=["dims", "asked_row", "row", "score"])

    return run


def _reaches(reps: DataFrame, placed: DataFrame, k: int) -> dict[int, int]:
    """For each length of vectors the reach that covers ``RECALL`` of the true neighbours of a sample of its queries.

    A neighbour is covered if it is in reach on one of the curves.  ``REACH`` at least; lengths with
    no more vectors than that are not sampled.
    """
    many = reps.groupBy("dims").agg(F.count("*").alias("n")).where(F.col("n") > REACH)
    some = F.row_number().over(Window.partitionBy("dims").orderBy(F.xxhash64("v"), "row"))
    picked = reps.where("asked").withColumn("n", some).where(F.col("n") <= SAMPLE).drop("n")
    picked = picked.join(many, "dims", "left_semi").select("dims", "row", "v").collect()
    sample = {
        d: (np.array([r["row"] for r in picked if r["dims"] == d]), np.array([r["v"] for r in picked if r["dims"] == d]))
        for d in {r["dims"] for r in picked}
    }
    if not sample:
        return {}
    best = F.row_number().over(Window.partitionBy("asked_row").orderBy(F.desc("score"), "row"))
    pairs = reps.select("row", "dims", "v").mapInArrow(
        _true_neighbours(sample, k), "dims int, asked_row bigint, row bigint, score double"
    )
    pairs = materialize(pairs.withColumn("n", best).where(F.col("n") <= k).select("dims", "asked_row", "row"), "pairs")
    asked = placed.where("query").select("dims", "curve", F.col("row").alias("asked_row"), F.col("at").alias("asked_at"))
    near = placed.where("not query").select("dims", "curve", "row", "at")
    apart = pairs.join(asked, ["dims", "asked_row"]).join(near, ["dims", "curve", "row"])
    apart = apart.groupBy("dims", "asked_row", "row").agg(F.min(F.abs(F.col("at") - F.col("asked_at"))).alias("apart"))
    found = apart.groupBy("dims").agg(F.expr(f"percentile(apart, {RECALL}D)").alias("reach")).collect()  # a row per length
    return {r["dims"]: max(REACH, int(np.ceil(r["reach"]))) for r in found}


def approximate_top_k(
    vectors: DataFrame,
    is_query,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    reach: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: near rows by inner product for the rows where ``is_query`` (a condition on ``id_col``) holds.

    Every distinct vector is put on ``curves`` Hilbert curves of random projections.  Keys are range-partitioned and
    numbered; blocks of positions, with ``reach`` more on either side, score their queries against the
    positions within reach; the best of all curves and the query's own vector are merged by exact double scores, and each
    vector is replaced by its rows of the smallest ids.  Work per query is ``curves * 2 * reach`` products.

    Where no ``reach`` is given it follows the data: ``SAMPLE`` queries are held against all vectors, and the reach is what
    covers ``RECALL`` of their neighbours (``_reaches``).  On vectors without any structure it grows with their
    number, and so does the work per query; on clustered ones it hardly does.

    Rows without id and vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors
    of the query's length are its candidates.  Rows with the query's own id are no candidates; a query id that is
    repeated is searched once, by its first row.  A repeated candidate row takes a place each time.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), is_query.alias("asked"), F.col(vector_col).alias("v"))
    own = own.withColumn("v", F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))))  # no -0.0
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    own = own.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0))
    own = materialize(
        own.select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            F.coalesce("asked", F.lit(False)).alias("asked"),
            F.size("v").alias("dims"),
            F.sqrt(square).alias("norm"),
            F.xxhash64("v").alias("h1"),
            F.xxhash64(F.lit(1), "v").alias("h2"),
            "v",
        ),
        "vectors",
    )
    lengths = own.groupBy("dims").agg(F.max("norm").alias("norm")).collect()  # a row per length of vectors
    longest = {r["dims"]: r["norm"] or 1.0 for r in lengths}
    reps, members, queries = _distinct(own, k)
    ranges = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dims", "curve", "key", "row", "query"]
    at = F.monotonically_increasing_id()
    keyed = reps.select("row", "asked", "dims", "v").mapInArrow(
        _keys(longest, curves), "dims int, curve int, key bigint, row bigint, query boolean"
    )
    placed = materialize(
        keyed.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", at)
        .withColumn("range", F.shiftright("at", 33).cast("int"))
        .withColumn("at", F.col("at").bitwiseAND(F.lit(2**33 - 1))),
        "placed",
    )
    counts = placed.groupBy("range", "dims", "curve").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    offsets, seen = [], {}
    for c in counts.orderBy("range", "dims", "curve").collect():  # ranges plus curves at most
        key = (c["dims"], c["curve"])
        offsets.append((c["range"], *key, seen.get(key, 0) - c["start"]))
        seen[key] = seen.get(key, 0) + c["n"]
    if not offsets:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    spark = vectors.sparkSession
    known = F.broadcast(spark.createDataFrame(offsets, "range int, dims int, curve int, offset bigint"))
    numbered = placed.join(known, ["range", "dims", "curve"]).withColumn("at", F.col("at") + F.col("offset"))
    reaches = _reaches(reps, numbered, k) if reach is None else {}
    sizes = []
    for d in longest:
        r = reaches.get(d, REACH if reach is None else reach)
        sizes.append((d, r, min(max(2 * r, BLOCK), WIDEST)))
    sizes = F.broadcast(spark.createDataFrame(sizes, "dims int, reach bigint, side bigint"))
    placed = numbered.join(sizes, "dims")
    block = lambda p: F.floor(p / F.col("side"))
    mine = block(F.col("at"))
    others = F.sequence(F.greatest(F.lit(0), block(F.col("at") - F.col("reach"))), block(F.col("at") + F.col("reach")))
    # a query meets the blocks in its reach one by one, so that a group never holds more than two blocks
    spread = placed.select("dims", "curve", "reach", "row", "query", "at", mine.alias("mine"), F.explode(others).alias("other"))
    spread = spread.withColumn("block", F.when(F.col("query"), F.col("mine")).otherwise(F.col("other")))
    spread = spread.withColumn("met", F.when(F.col("query"), F.col("other")).otherwise(F.col("mine"))).drop("mine", "other")
    searches = queries.select(F.col("rep").alias("row"), "barred", F.lit(True).alias("query")).distinct()
    spread = spread.join(searches, ["row", "query"], "left")  # a candidate stays one row
    rows = spread.join(reps.select("row", "least", "second", "v"), "row")
    found = rows.groupBy("dims", "curve", "reach", "block", "met").applyInArrow(
        _windows(k + 1), "query_row bigint, barred bigint, free boolean, row bigint, first_id bigint, score double"
    )
    asked = reps.where("asked").select(F.col("row").alias("rep"), "least", "second", F.aggregate(
        F.zip_with("v", "v", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c).alias("score"))
    own_id = F.col("least").eqNullSafe(F.col("barred"))
    itself = searches.withColumnRenamed("row", "rep").join(asked, "rep").select(
        F.col("rep").alias("query_row"),
        F.coalesce("barred", F.lit(0)).alias("barred"),
        F.col("barred").isNull().alias("free"),
        F.col("rep").alias("row"),
        F.when(own_id, F.col("second")).otherwise(F.col("least")).alias("first_id"),
        "score",
    ).where("first_id is not null")
    search = ["query_row", "barred", "free"]
    merged = found.unionByName(itself).groupBy(*search, "row", "first_id").agg(F.min("score").alias("score"))
    best = F.row_number().over(Window.partitionBy(*search).orderBy(F.desc("score"), "first_id", "row"))
    merged = merged.withColumn("n", best).where(F.col("n") <= k + 1).drop("n", "first_id")
    merged = merged.withColumnRenamed("row", "rep").join(members, "rep").drop("rep")
    queries = queries.select(
        "query_id", F.col("rep").alias("query_row"), F.coalesce("barred", F.lit(0)).alias("barred"), F.col("barred").isNull().alias("free")
    )
    merged = queries.join(merged, search).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k by inner product over impact-ordered, score-at-a-time postings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vouch.llm.batches import bound_batches, released
from vouch.session import new_path

BLOCK, BATCH = 4096, 256  # vectors of an index block, queries that are scored together
PACK, NUMBERS = 1 << 15, 1 << 20  # components of vectors that travel together, and of a block, at most
STRIP, GROUP = 8 << 20, 16 << 20  # components of the queries that a task holds, of the vectors read for them, about
PAIRS = 1 << 22  # components of the vectors that are scored exactly at once
ROWS_MB = 16  # of a row group of packed vectors, which a reader holds whole
STEP = 4  # width of an impact level
LONG = 1 << 62  # sums that stay below are exact in 64 bits
NONE = -(1 << 63)  # below every score
_CHECKS = (0.5, 0.7, 0.8, 0.9, 0.96, 1.0)  # shares of the segments after which a proof is tried
_FIRST = (0.25, 0.05)  # shares of the greatest impact: with many queries, segments down to these are read first


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x``: components turned into ``floor(scale * component)``.

    Rows without id, null vectors, empty ones and those with null or non-finite components are left out.  One
    that becomes 2**62 or more in size raises.
    """
    whole = lambda c: F.floor(
        F.when(F.abs(c.cast("double") * scale) < 2.0**62, c.cast("double") * scale).otherwise(
            F.raise_error(F.lit("a vector component is too large for a whole number"))
        )
    )
    x = F.transform(F.col("v"), whole)
    fine = F.forall(
        F.col("v"),
        lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")),
    )
    own = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    return own.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine).select("vec_id", x.alias("x"))


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of the rows of ``x`` with ``q``; one that leaves a long raises."""
    if not len(x):
        return np.zeros(0, np.int64)
    if float(np.abs(x.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) * len(q) < LONG:
        return x @ q
    out = x.astype(object) @ q.astype(object)  # integers of any size
    if max(map(abs, out)) >= 1 << 63:
        raise OverflowError("a score is too large for a long")
    return out.astype(np.int64)


class Strip:
    """Queries of one length with the best ``k`` rows found for each so far, best first, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.size = max(int(q.max()), -int(q.min()))
        self.order = np.argsort(ids)
        self.rising = ids[self.order]
        self.scores = np.full((len(ids), k), NONE, np.int64)
        self.found = np.zeros((len(ids), k), np.int64)
        self.up, self.down = np.maximum(q, 0).mean(axis=0), -np.minimum(q, 0).mean(axis=0)  # mean weights

    def floor(self, at: np.ndarray) -> np.ndarray:
        """What a row has to reach, as doubles."""
        last = self.scores[at, -1]
        return np.where(last == NONE, -np.inf, last.astype(np.float64))

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries, in rising order, and the positions of their own ids."""
        spot = np.minimum(np.searchsorted(self.rising, ids), len(self.rising) - 1)
        at = np.flatnonzero(self.rising[spot] == ids)
        query = self.order[spot[at]]
        rising = np.argsort(query, kind="stable")
        return query[rising], at[rising]

    def take(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put rows, each given once, among the best of the queries ``at``."""
        last = self.scores[at, -1]
        better = (scores > last) | ((scores == last) & (ids < self.found[at, -1])) & (last != NONE)
        at, ids, scores = at[better], ids[better], scores[better]
        if not len(at):
            return
        met = np.unique(at)
        at = np.concatenate([np.repeat(met, self.k), at])
        ids = np.concatenate([self.found[met].reshape(-1), ids])
        scores = np.concatenate([self.scores[met].reshape(-1), scores])
        order = np.lexsort((ids, ~scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        best = place < self.k
        self.found[at[best], place[best]] = ids[best]
        self.scores[at[best], place[best]] = scores[best]

    def batch(self) -> pa.RecordBatch:
        at, place = np.nonzero(self.scores != NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[at]), pa.array(self.found[at, place]), pa.array(self.scores[at, place])],
            names=["query_id", "vec_id", "score"],
        )


def _under(bound: np.ndarray, kind: np.dtype) -> np.ndarray:
    """``bound`` in another type, rounded down."""
    near = bound.astype(kind)
    return np.where(near > bound, np.nextafter(near, kind.type(-np.inf)), near)


def _owned(now: np.ndarray, mine: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs ``mine`` in an array with a row for each of ``now``, in rising order."""
    spot = np.searchsorted(now, mine[0])
    here = np.append(now, -1)[spot] == mine[0]
    return spot[here], mine[1][here]


class Block:
    """Postings of some vectors: per dimension and level of quantised value, the vectors that have it.

    A segment read from above serves positive query weights, from below negative ones.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, dims = x.shape
        order = np.argsort(x, axis=0, kind="stable").T
        level = np.take_along_axis(x.T, order, axis=1) // STEP
        first = np.ones((dims, n), bool)
        first[:, 1:] = level[:, 1:] != level[:, :-1]
        self.postings = order.reshape(-1)
        self.start = np.flatnonzero(first.reshape(-1))
        self.end = np.append(self.start[1:], n * dims)
        self.dim = self.start // n
        low, high = x.min(axis=0), x.max(axis=0)
        value = level.reshape(-1)[self.start] * STEP
        self.low, self.high = low, high
        self.least = np.maximum(value, low[self.dim])  # bounds of the values in a segment
        self.most = np.minimum(value + (STEP - 1), high[self.dim])

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the best ``k``, ties to smaller ids."""
        n = len(self.ids)
        weight = np.abs(q.astype(np.float64))
        up = (q > 0)[self.dim]
        # impacts count from the end of a dimension's range at which the query gains nothing
        low, high = self.low.astype(np.float64), self.high.astype(np.float64)
        least, most = self.least.astype(np.float64), self.most.astype(np.float64)
        ends = q * np.where(q > 0, low, high)
        base = float(ends.sum())
        lower = np.where(up, least - low[self.dim], high[self.dim] - most) * weight[self.dim]
        upper = np.where(up, most - low[self.dim], high[self.dim] - least) * weight[self.dim]
        # sums in doubles are short by at most this; where they are whole numbers, by nothing
        sure = 1e-12 * float((np.abs(ends) + (high - low) * weight).sum())
        use = np.flatnonzero(weight[self.dim] > 0)
        order = use[np.argsort(-upper[use], kind="stable")]
        slack = np.zeros(len(q))
        np.maximum.at(slack, self.dim, upper - lower)  # what a level hides
        total = np.zeros(n, np.float64)
        other = self.ids != query_id
        floor, done = -np.inf, 0
        for share in _CHECKS:
            upto = max(done, int(len(order) * share))
            part = order[done:upto]
            if len(part):
                size = self.end[part] - self.start[part]
                at = np.repeat(self.start[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
                total += np.bincount(self.postings[at], np.repeat(lower[part], size), n)
            done = upto
            # a vector lacks at most, per dimension, the best segment not yet read, or what a level hides
            missing = slack.copy()
            rest = order[done:]
            np.maximum.at(missing, self.dim[rest], upper[rest])
            reach = total + base + float(missing[weight > 0].sum()) + sure
            seen = np.flatnonzero(other)
            if len(seen) > 8 * k:
                seen = seen[np.argpartition(-total[seen], 8 * k)[: 8 * k]]
            scores = inner_products(self.x[seen], q)
            if len(scores) >= k:
                floor = max(floor, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
            possible = np.flatnonzero(other & (reach >= floor))
            if len(possible) <= max(16 * k, n // 16) or done == len(order):
                break
        scores = inner_products(self.x[possible], q)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return possible[best], scores[best]

    def fill(self, strip: Strip) -> None:
        """Let the rows of the block into the best of all queries of ``strip``.

        For each query the same search, with sums for many queries at a time: the gains of segments, laid out by their
        postings, times the weights.  Leading segments, by the mean weights of the strip, are read for queries that
        most vectors could then no longer reach, by mean and variance of the gains; all segments for the others.
        """
        size = max(int(self.x.max()), -int(self.x.min())) + STEP
        wide = 2 * size * strip.size * self.x.shape[1]
        if wide >= 1 << 53:  # sums beyond whole doubles: one query at a time
            for i, q in enumerate(strip.q.astype(np.int64)):
                at, scores = self.search(int(strip.ids[i]), q, strip.k)
                strip.take(np.full(len(at), i), self.ids[at], scores)
            return
        kind = np.dtype(np.float32 if wide < 1 << 24 else np.float64)  # whole numbers in it are exact
        n, dims = self.x.shape
        x = self.x.astype(kind)
        coarse = np.empty((dims, n), kind)
        coarse.reshape(-1)[np.repeat(self.dim * n, self.end - self.start) + self.postings] = np.repeat(
            self.least, self.end - self.start
        )
        low, high = self.low.astype(np.float64), self.high.astype(np.float64)
        hidden = np.zeros(dims)  # what a level hides
        np.maximum.at(hidden, self.dim, (self.most - self.least).astype(np.float64))
        none = np.zeros(dims)
        rounds = self._rounds(strip, kind) if (strip.scores[:, -1] != NONE).any() else []
        bounds = [np.append(low, -high), np.tile(high - low, 2), np.append(hidden, none), np.append(none, hidden)]
        bounds = np.stack([*bounds, *(r.unread for r in rounds), *(r.mean for r in rounds)], axis=1).astype(kind)
        own_at, own = strip.own(self.ids)
        few, width = max(16 * strip.k, n // 64), max(1, n // max(64, 8 * strip.k))
        for start in range(0, len(strip.ids), BATCH):
            q = strip.q[start : start + BATCH].astype(kind)
            weight = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1)
            base, span, more, less, *sums = (weight @ bounds).T.astype(np.float64)
            floor = strip.floor(slice(start, start + len(q)))
            some = slice(*np.searchsorted(own_at, [start, start + len(q)]))
            mine = own_at[some] - start, own[some]
            use = base + span >= floor  # the block as a whole
            for read, missing, mean in zip(rounds, sums[: len(rounds)], sums[len(rounds) :], strict=True):
                usual = mean + 2 * np.sqrt(weight * weight @ read.spread)
                now = np.flatnonzero(use & (base + usual + missing < floor))
                if len(now):
                    least = _under(floor - base - missing, kind)[now, None]
                    possible = weight[np.ix_(now, read.columns)] @ read.gains(self) >= least
                    done = np.count_nonzero(possible, axis=1) <= few
                    self._settle(strip, start, now[done], q[now[done]], possible[done], x, mine)
                    use[now[done]] = False
            now = np.flatnonzero(use)
            if not len(now):
                continue
            q, floor = q[now], floor[now]
            total = q @ coarse
            new = np.flatnonzero(floor == -np.inf)
            if len(new) and n // width >= strip.k:  # best lower bounds of parts of the block
                total[_owned(now, mine)] = -np.inf
                part = total[new, : n // width * width].reshape(len(new), -1, width).max(axis=2)
                last = part.shape[1] - strip.k
                floor[new] = np.partition(part, last, axis=1)[:, last] - less[now[new]]
            self._settle(strip, start, now, q, total >= _under(floor - more[now], kind)[:, None], x, mine)

    def _rounds(self, strip: Strip, kind: np.dtype) -> list[Read]:
        """Leading segments by falling impact on the mean weights of the strip, both sides."""
        n, dims = self.x.shape
        column = np.concatenate([self.dim, self.dim + dims])
        low, high = self.low.astype(np.float64)[self.dim], self.high.astype(np.float64)[self.dim]
        lower = np.concatenate([self.least - low, high - self.most])
        upper = np.concatenate([self.most - low, high - self.least])
        size = np.tile(self.end - self.start, 2)
        impact = upper * np.concatenate([strip.up, strip.down])[column]
        reads = [Read(column, lower, upper, size, np.flatnonzero(impact >= s * impact.max()), n, kind) for s in _FIRST]
        return [r for r in reads if len(r.columns) <= dims // 2]  # more take longer than to read all segments

    def _settle(self, strip: Strip, start: int, now, q, possible, x, mine) -> None:
        """Exact scores of the possible rows of the queries ``start + now``, all but their own."""
        possible[_owned(now, mine)] = False
        pairs, scores = np.flatnonzero(possible), None
        if len(pairs) > possible.size // 16:
            scores = q @ x.T
            last, floor = strip.scores[start + now, -1], strip.floor(start + now)[:, None]
            ties = np.where(last == NONE, np.iinfo(np.int64).max, strip.found[start + now, -1])
            possible &= (scores > floor) | ((scores == floor) & (self.ids < ties[:, None]))
            pairs = np.flatnonzero(possible)
        some = max(1, PAIRS // x.shape[1])
        for first in range(0, len(pairs), some):
            i, j = np.divmod(pairs[first : first + some], len(self.ids))
            exact = np.einsum("ij,ij->i", q[i], x[j]) if scores is None else scores[i, j]
            strip.take(start + now[i], self.ids[j], exact.astype(np.int64))


class Read:
    """Some segments that are read: best gain not read, mean and variance of those read, all by dimension and side."""

    def __init__(self, column, lower, upper, size, read, n: int, kind: np.dtype):
        self.gain, self.segment, self.n, self.kind = lower[read], read % (len(lower) // 2), n, kind
        self.columns, self.row = np.unique(column[read], return_inverse=True)
        best = upper.copy()
        best[read] -= lower[read]
        self.unread = np.zeros(int(column.max()) + 1)
        np.maximum.at(self.unread, column, best)
        self.mean = np.bincount(column[read], (lower * size)[read], len(self.unread)) / n
        square = np.bincount(column[read], (lower * lower * size)[read], len(self.unread)) / n
        self.spread = np.maximum(square - self.mean * self.mean, 0)
        self.laid: np.ndarray | None = None

    def gains(self, block: Block) -> np.ndarray:
        """The gains of the segments at their postings, for ``columns``, laid out when first asked for."""
        if self.laid is None:
            self.laid = np.zeros((len(self.columns), self.n), self.kind)
            for row, gain, segment in zip(self.row, self.gain, self.segment, strict=True):
                self.laid[row, block.postings[block.start[segment] : block.end[segment]]] = gain
        return self.laid


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest of three types that holds them."""
    most = max(int(x.max()), -int(x.min()))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _packed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x.shape[1]], pa.int32()),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([uuid.uuid4().int >> 65], pa.int64()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([_narrow(x).tobytes()], pa.binary()),
                ],
                names=["dims", "n", "key", "ids", "rows"],
            )

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("x")
            size, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            first = np.cumsum(size, dtype=np.int64) - size
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                parts = held.setdefault(dims, [])
                parts.append((ids[at], values[first[at][:, None] + np.arange(dims)]))
                full = max(1, most // dims)
                if sum(len(i) for i, _ in parts) >= full:
                    own, x = (np.concatenate(part) for part in zip(*parts, strict=True))
                    whole = len(own) // full * full
                    for start in range(0, whole, full):
                        yield out(own[start : start + full], x[start : start + full])
                    parts[:] = [(own[whole:].copy(), x[whole:].copy())] if whole < len(own) else []
        for parts in held.values():
            if parts:
                yield out(*(np.concatenate(part) for part in zip(*parts, strict=True)))

    return run


_PACKED = "dims int, n int, key bigint, ids binary, rows binary"


def _written(packed: DataFrame, label: str) -> DataFrame:
    """As ``materialize``, in small row groups, since their rows are long."""
    path = new_path(packed.sparkSession, label)
    packed.write.option("parquet.block.size", ROWS_MB << 20).parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
    rows, dims = batch.column("rows")[i].as_buffer(), batch.column("dims")[i].as_py()
    return ids, np.frombuffer(rows, f"i{rows.size // (len(ids) * dims)}").reshape(-1, dims)


def _search(k: int, most: int):
    """Cells one after the other: for each length the queries, then the blocks, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked, held, strip = None, [], [], None
        joined = lambda parts: (np.concatenate(part) for part in zip(*parts, strict=True))
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column("cell")[i].as_py(), batch.column("dims")[i].as_py()
                if cell != known:
                    if strip is not None:
                        if held:
                            Block(*joined(held)).fill(strip)
                        yield strip.batch()
                    known, asked, held, strip = cell, [], [], None
                if not batch.column("block")[i].as_py():
                    asked.append(_unpack(batch, i))
                    continue
                if asked:
                    strip, asked = Strip(*joined(asked), k), []
                if strip is not None:
                    ids, x = _unpack(batch, i)
                    held.append((ids.copy(), x.copy()))
                    if sum(len(ids) for ids, _ in held) + len(ids) > min(most, NUMBERS // x.shape[1]):
                        Block(*joined(held)).fill(strip)
                        held = []
        if strip is not None:
            if held:
                Block(*joined(held)).fill(strip)
            yield strip.batch()

    return run


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Components become ``floor(scale * x)`` (see ``whole_vectors``); a score is the integer inner product with a
    vector of the same length, exact whatever its size; one that leaves a long raises.  Rows with the query's own id
    are no candidates; of query rows with one id the smallest vector counts; a repeated candidate row takes a place
    each time.  Ties go to smaller ids.  No queries or no candidates give no rows.

    Vectors and queries are packed as they are read, in the smallest whole numbers that hold them, and written.  Every
    query meets every vector, which a search of given queries against all rows needs: packs of vectors are dealt into
    groups, packs of queries into strips, and each pair of a group and a strip is a task that holds the strip, reads
    one block at a time and returns ``k`` rows per query.  Groups and strips have bounded sizes at any size of tables.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    blocks = whole_vectors(vectors, id_col, vector_col, scale)
    blocks = _written(blocks.mapInArrow(released(_packed(PACK)), _PACKED), "blocks")
    asked = whole_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = _written(asked.mapInArrow(released(_packed(PACK)), _PACKED), "asked")
    total = F.coalesce(F.sum(F.col("n").cast("bigint") * F.col("dims")), F.lit(0))
    numbers, rows = blocks.agg(total, F.coalesce(F.sum("n"), F.lit(0))).first()
    strips = max(1, -(-asked.agg(total).first()[0] // STRIP))
    groups = max(-(-numbers // GROUP), -(-4 * spark.sparkContext.defaultParallelism // strips))
    groups = max(1, min(groups, -(-rows // BLOCK)))
    own = lambda parts: F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    met = blocks.select("*", F.lit(True).alias("block"), own(groups).alias("group"), each(strips).alias("strip")).union(
        asked.select("*", F.lit(False).alias("block"), each(groups).alias("group"), own(strips).alias("strip"))
    )
    met = met.withColumn("cell", F.col("group") * strips + F.col("strip")).drop("group", "strip", "key", "n")
    met = met.repartitionById(groups * strips, "cell").sortWithinPartitions("cell", "dims", "block")
    found = met.mapInArrow(released(_search(k, BLOCK)), "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

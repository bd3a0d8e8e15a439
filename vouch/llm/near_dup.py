"""Near duplicates: similarity sketches, banding, exact checks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouch.llm.batches import bound_batches, released, values
from vouch.llm.components import connected_components
from vouch.llm.sketch import Shingler, band_keys, band_plan, overlap, sketch
from vouch.session import materialize

BINS = 125  # bins of a sketch
FILTER_BITS = 26  # bits of the filter on the second pass: 8 MB, whatever the data
BLOCK = 512  # members of a bucket on each side of one grid cell
_WORDS_AT_ONCE = 400_000


def _binary(column: pa.Array) -> Iterator:
    return values(column.cast(pa.binary()))


def _features(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(n)

        def flush(first: int, sets: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
            part = batch.slice(first, len(sets))
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            signed = np.array([[d >> 64, d & (2**64 - 1)] for d in digests], dtype=np.uint64).view(np.int64)
            keys = band_keys(sketch(sets, bands * rows), bands, rows)
            return pa.RecordBatch.from_arrays(
                [
                    part.column("rid"),
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signed[:, 0]),
                    pa.array(signed[:, 1]),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))
                    ),
                ],
                names=["rid", "doc_id", "text_key", "n", "h1", "h2", "bands"],
            )

        for batch in batches:
            sets, first, words = [], 0, 0
            for text in _binary(batch.column("text")):
                sets.append(shingler(text))
                words += len(sets[-1])
                if words > _WORDS_AT_ONCE:
                    yield flush(first, sets, batch)
                    first, sets, words = first + len(sets), [], 0
            if sets:
                yield flush(first, sets, batch)

    return run


def _bitmap(keys: DataFrame) -> np.ndarray:
    """``2 ** FILTER_BITS`` bits, packed; those of the hashed ``key`` values are set."""
    spot = F.pmod("key", F.lit(1 << FILTER_BITS)) + 1
    rows = (
        keys.select(spot.alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in rows:
        bits = np.frombuffer(row["bits"], np.uint8)
        start = (row["part"] - 1) * len(bits)
        out[start : start + len(bits)] = bits
    return out


def _sets(n: int, wanted):
    """Sets of the texts whose key is set in the bitmap ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        bitmap = wanted.value
        for batch in batches:
            spot = np.mod(batch.column("text_key").to_numpy(), 1 << FILTER_BITS)
            batch = batch.filter(pa.array((bitmap[spot >> 3] >> (spot & 7)) & 1 == 1))
            first, sets, size = 0, [], 0

            def out() -> pa.RecordBatch:
                part = batch.slice(first, len(sets))
                return pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sets, pa.binary())],
                    names=["doc_id", "text_key", "items"],
                )

            for text in _binary(batch.column("text")):
                sets.append(shingler(text).tobytes())
                size += len(sets[-1])
                if size > 8 * _WORDS_AT_ONCE:
                    yield out()
                    first, sets, size = first + len(sets), [], 0
            if sets:
                yield out()

    return run


def linked(shared, a, b, percent: int):
    """Whether sets of ``a`` and ``b`` members that share ``shared`` reach the similarity."""
    return 100 * shared >= percent * (a + b - shared)


def _check_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(linked(overlap(p, q), len(p), len(q), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def shared_items(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact sizes of the intersections of all ``left`` with all ``right`` sets."""
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(flat_l, flat_r)  # items on one side only add nothing
    if not len(both):
        return counts.astype(np.int64)

    def cells(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        hit = both[at] == flat
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (row_l, at_l), (row_r, at_r) = cells(left, flat_l), cells(right, flat_r)
    for start in range(0, len(both), width):
        pair = []
        for row, at, size in ((row_l, at_l, len(left)), (row_r, at_r, len(right))):
            lo, hi = np.searchsorted(at, [start, start + width])
            dense = np.zeros((size, width), dtype=np.float32)
            dense[row[lo:hi], at[lo:hi] - start] = 1
            pair.append(dense)
        counts += pair[0] @ pair[1].T
    return counts.astype(np.int64)


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Edges that join what the given ones join, without circles."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def _check_cell(percent: int):
    """Links between the two sides of a cell; as a forest, so rows grow with members."""

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        side = table.column("side").to_numpy()
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        edges: list[tuple[int, int]] = []
        if len(rows) and len(cols):
            size = np.array([len(x) for x in items])
            shared = shared_items([items[i] for i in rows], [items[i] for i in cols])
            near = linked(shared, size[rows][:, None], size[cols][None, :], percent)
            near &= rep[rows][:, None] != rep[cols][None, :]
            i, j = np.nonzero(near)
            edges = _forest(rep[rows[i]].tolist(), rep[cols[j]].tolist())
        return pa.table(
            {"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())}
        )

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``: one row per row of ``docs``.

    A document's set holds its distinct ``n``-word shingles (see ``Shingler``).  Documents are
    linked if ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    that can be reached by links, the document's own included.

    1. One pass over the texts gives the set's size, a 128-bit digest of it, and the band
       keys of its sketch.  Equal sets form a class; only one row of each goes on.
    2. Classes that share a band key are candidates; ``band_plan`` keeps the chance to miss
       a pair at the threshold under one in a million.  Every member of a bucket is
       checked against the bucket's first one on their whole sets.
    3. Buckets whose other members are still in two or more components go through a grid
       of blocks: members outside the bucket's largest component against all members.
       A cell holds at most a block of each side, counts all intersections exactly and
       returns a forest of its links, so no pairs are written out.

    No bucket or component is cut, however large.  Texts without words and null texts
    have size 0 and are linked with nothing.  Rows without id take part; a component of
    such rows only has a null id.  Repeated rows are a class like any other.  ``kept`` is true where the id
    is the component's; of several rows with that id each is kept.  Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    bands, rows = band_plan(percent / 100, BINS)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "text_key", F.xxhash64("text")
    )
    features = materialize(
        own.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
            released(_features(n, bands, rows)),
            "rid bigint, doc_id bigint, text_key bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>",
        ),
        "features",
    )
    classes = materialize(
        features.where("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("rep")), "classes"
    )
    members = materialize(
        features.drop("text_key", "bands").join(classes, ["h1", "h2"], "left").drop("h1", "h2"), "members"
    )
    reps = features.join(classes.select(F.col("rep").alias("rid")), "rid")
    edges = _links(own, reps, n, percent)
    component = connected_components(edges)
    # classes that have no link are their own component
    smallest = (
        members.join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("root", F.coalesce("component", "rep"))
        .drop("component")
    )
    smallest = materialize(smallest, "roots")
    ids = materialize(
        smallest.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first_id")), "ids"
    )
    out = smallest.join(ids, "root", "left")
    component_id = F.coalesce("first_id", "doc_id")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component_id.alias("component_id"),
        component_id.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with exactly one row of each component of near copies (see ``near_duplicates``), columns unchanged.

    Rows are told apart by a number written beside them, not by id: the row that stays has the smallest id of its
    component, rows without id come last, and of several rows with that id one stays.  A text that shares
    its id with a copy of another text stays.  Rows without words are linked with nothing and all stay, repeated or
    not.  An empty table stays empty; columns may have any name.
    """
    width = len(docs.columns)
    own = docs.toDF(*[f"c{i}" for i in range(width)])
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    numbered = materialize(own.withColumn("number", F.monotonically_increasing_id()), "numbered")
    judged = near_duplicates(numbered, "number", text, n, percent).select(F.col("number"), "component_id")
    judged = materialize(judged, "judged")
    # components of one row need no choice
    several = judged.groupBy("component_id").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    members = judged.join(materialize(several, "several"), "component_id").join(
        numbered.select("number", F.col(key).cast("bigint").alias("id")), "number"
    )
    members = materialize(members, "near")
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"), F.col("number").alias("number"))
    chosen = members.groupBy("component_id").agg(F.min(order)["number"].alias("number"))
    lost = materialize(members.select("number").join(chosen.select("number"), "number", "left_anti"), "lost")
    return numbered.join(lost, "number", "left_anti").drop("number").toDF(*docs.columns)


def _links(own: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: links between classes that connect all that any link connects."""
    entries = materialize(reps.select(F.col("rid").alias("rep"), F.explode("bands").alias("bucket")), "entries")
    buckets = entries.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
    buckets = materialize(buckets.where("first < last").drop("last"), "buckets")
    candidates = materialize(entries.join(buckets, "bucket"), "candidates")

    needed = candidates.select("rep").distinct().join(
        reps.select(F.col("rid").alias("rep"), "doc_id", "text_key"), "rep"
    )
    needed = materialize(needed, "needed").withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    # a second pass over the texts: their sets move only where the bitmap, of a fixed size, lets them
    wanted = own.sparkSession.sparkContext.broadcast(_bitmap(needed))
    same = (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    sets = materialize(
        own.mapInArrow(released(_sets(n, wanted)), "doc_id bigint, text_key bigint, items binary")
        .join(needed, same)
        .select("rep", "items")
        .dropDuplicates(["rep"]),
        "sets",
    )

    pairs = materialize(
        candidates.where("rep <> first").select(F.col("rep").alias("b"), F.col("first").alias("a")).distinct(),
        "pairs",
    )
    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b")), "b")
    with_both = with_b.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a")), "a")
    star = materialize(
        with_both.select("a", "b", "items_a", "items_b").mapInArrow(released(_check_pairs(percent)), "a bigint, b bigint"),
        "star",
    )
    rest = _rest_of_buckets(candidates, sets, connected_components(star), percent)
    return star.unionByName(rest)


def _rest_of_buckets(candidates: DataFrame, sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Links between members that are not yet in one component, the first ones excepted."""
    others = candidates.where("rep <> first").drop("first")
    labelled = materialize(
        others.join(materialize(component, "component").withColumnRenamed("node", "rep"), "rep", "left").select(
            "bucket", "rep", F.coalesce("component", "rep").alias("label")
        ),
        "labelled",
    )
    count = labelled.groupBy("bucket", "label").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x")
    )
    buckets = count.groupBy("bucket").agg(
        F.max(F.struct("c", "label")).alias("top"),
        F.sum("c").alias("size"),
        F.count("*").alias("labels"),
        F.bit_xor("x").alias("x"),
    )
    # buckets of other bands with the same members need no second look
    buckets = (
        buckets.where("labels > 1")
        .groupBy("size", "x", F.col("top.label").alias("largest"), (F.col("size") - F.col("top.c")).alias("strays"))
        .agg(F.min("bucket").alias("bucket"))
        .select(
            "bucket",
            "largest",
            F.ceil(F.col("size") / BLOCK).cast("int").alias("n_cols"),
            F.ceil(F.col("strays") / BLOCK).cast("int").alias("n_rows"),
        )
    )
    placed = labelled.join(materialize(buckets, "open"), "bucket")
    spot = F.xxhash64("rep", "bucket")
    row, col = F.pmod(spot, "n_rows").cast("int"), F.pmod(spot, "n_cols").cast("int")
    left = placed.where("label <> largest").select(
        "bucket", "rep", F.lit(0).alias("side"), row.alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("j"),
    )
    right = placed.select(
        "bucket", "rep", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("i"), col.alias("j"),
    )
    cells = materialize(left.select("bucket", "rep", "side", "i", "j").unionByName(right), "cells").join(sets, "rep")
    return materialize(
        cells.groupBy("bucket", "i", "j").applyInArrow(_check_cell(percent), "a bigint, b bigint").distinct(), "rest"
    )

"""Periodic runs of words, found by internal pattern matching of dyadic blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouch.llm.batches import bound_batches

LEAST = 24  # words of a run, and three periods
BLOCK = 8  # words of the smallest block: a run of LEAST words holds one and its shift by any period below 16
WORDS_AT_ONCE = 1 << 17  # words of the texts that are searched together, unless one has more


class Ranks:
    """Suffixes of a sequence, sorted by doubling; ``level[k]`` numbers the blocks of ``2**k`` words, equal ones alike.

    A block's number is the place of its first suffix in ``order``, so equal blocks are a range of it.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.order = np.argsort(ids, kind="stable")
        rank = self._numbered(n, np.arange(n), self.order, ids[self.order], np.zeros(n, np.int64))
        self.level, length = [rank], 1
        while True:
            size = np.bincount(rank, minlength=n)
            open_at = np.flatnonzero(size[rank[self.order]] > 1)  # places of suffixes not yet told apart
            if not len(open_at):
                break
            who = self.order[open_at]
            after = np.where(who + length < n, rank[np.minimum(who + length, n - 1)] + 1, 0)
            key = rank[who] * (n + 1) + after
            by = np.argsort(key, kind="stable")
            self.order[open_at] = who[by]
            rank = self._numbered(n, open_at, who[by], key[by], rank)
            self.level.append(rank)
            length *= 2

    @staticmethod
    def _numbered(n, places, who, key, before) -> np.ndarray:
        out = before.copy()
        if len(who):
            new = np.append(True, key[1:] != key[:-1])
            out[who] = places[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        return out

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest common part that starts at ``i`` and ``j``; with ``back`` that ends before them."""
        n, total = len(self.order), np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            size = 1 << k
            a, b = (i - total - size, j - total - size) if back else (i + total, j + total)
            fits = (np.minimum(a, b) >= 0) & (np.maximum(a, b) + size <= n)
            same = fits & (self.level[k][np.where(fits, a, 0)] == self.level[k][np.where(fits, b, 0)])
            total += same * size
        return total


class WaveletTree:
    """Values by place, asked by ranges of places (the matrix form of the tree: one bit per level, highest first)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.sums = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            before = np.append(0, np.cumsum(1 - bit))
            self.sums.append(before)
            self.zeros.append(int(before[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in ``[lo, hi)`` are smaller than ``x``."""
        top = x >> self.bits > 0
        size, total = hi - lo, np.zeros(len(x), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            sums, zeros = self.sums[level], self.zeros[level]
            lo0, hi0 = sums[lo], sums[hi]
            one = (x >> b) & 1 == 1
            total += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, lo - lo0 + zeros, lo0), np.where(one, hi - hi0 + zeros, hi0)
        return np.where(top, size, total)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest value in ``[lo, hi)``, from 0."""
        out = np.zeros(len(k), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            sums, zeros = self.sums[level], self.zeros[level]
            lo0, hi0 = sums[lo], sums[hi]
            one = k >= hi0 - lo0
            k = np.where(one, k - (hi0 - lo0), k)
            lo, hi = np.where(one, lo - lo0 + zeros, lo0), np.where(one, hi - hi0 + zeros, hi0)
            out |= one.astype(np.int64) << b
        return out


def find_runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of every run of the sequence, by start, then period.

    A run is a stretch with smallest period ``q`` and a length of ``max(least, 3 * q)`` or more that neither
    neighbour extends; ``least`` is 24 or more.

    A run of period ``q`` in ``[b, 2 * b)`` holds an aligned block of ``b`` words and its copy ``q`` words on.
    Range successors among the places of equal blocks list the copies in that window.  Two at most are
    candidate periods as they are; three or more form a progression of the block's own period, and a longer period can only
    match the ends of the two stretches that the progression and the block lie in.  Candidates are
    confirmed by longest common extensions.
    """
    if least < 3 * BLOCK:
        raise ValueError(f"runs need {3 * BLOCK} words")
    n, none = len(ids), np.zeros((0, 3), np.int64)
    if n < least:
        return none
    ranks = Ranks(ids)
    first_level = BLOCK.bit_length() - 1
    if len(ranks.level) <= first_level:
        return none
    starts, periods = [], []

    def add(s: np.ndarray, d: np.ndarray) -> None:
        fine = (d > 0) & (s + d < n)
        starts.append(s[fine])
        periods.append(d[fine])

    # only suffixes whose first block occurs twice are ever asked for
    rank = ranks.level[first_level]
    size = np.bincount(rank, minlength=n)
    used = size[rank[ranks.order]] > 1
    place = np.append(0, np.cumsum(used))
    tree = WaveletTree(ranks.order[used])
    for k in range(first_level, len(ranks.level)):
        b, rank = 1 << k, ranks.level[k]
        size = np.bincount(rank, minlength=n)
        s = np.arange(0, n - b + 1, b)
        s = s[size[rank[s]] > 1]
        if not len(s):
            continue
        lo, hi = place[rank[s]], place[rank[s] + size[rank[s]]]
        for near, far in ([(1, b)] if k == first_level else []) + [(b, 2 * b)]:
            skip = tree.below(lo, hi, s + near)
            count = tree.below(lo, hi, s + far) - skip
            several = count >= (3 if near > 1 else b)
            for m in range(int(count[~several].max(initial=0))):
                on = ~several & (count > m)
                add(s[on], tree.smallest(lo[on], hi[on], skip[on] + m) - s[on])
            if several.any():
                t = s[several]
                f, g = (tree.smallest(lo[several], hi[several], skip[several] + m) for m in (0, 1))
                step = g - f
                add(t, step)
                right = f + ranks.common(f, g) - t - ranks.common(t, t + step)
                left = f - ranks.common(f, g, back=True) - t + ranks.common(t, t + step, back=True)
                add(t, right)
                add(t, left)
    if not starts:
        return none
    s, d = np.concatenate(starts), np.concatenate(periods)
    back = ranks.common(s, s + d, back=True)
    start, length = s - back, back + d + ranks.common(s, s + d)
    fine = length >= np.maximum(least, 3 * d)
    found = np.stack([start, length, d], axis=1)[fine]
    # the same stretch under a multiple of its period
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        new = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))
        found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeat_words(words: list, doc_id: int | None) -> list:
    """``words``, from some place on repeated with some period for one id in ten; both follow from a hash of the id."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _ids(texts: list[list[bytes]]) -> np.ndarray:
    """Words as numbers, those of different texts different."""
    flat = pa.array([w for words in texts for w in words], pa.binary())
    word = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    return np.unique(text * (int(word.max()) + 1) + word, return_inverse=True)[1]


def _rows(texts: list[list[bytes]]) -> list[tuple]:
    ends = np.cumsum([len(words) for words in texts])
    total = int(ends[-1]) if len(ends) else 0
    found = find_runs(_ids(texts)) if total else np.zeros((0, 3), np.int64)
    owner = np.searchsorted(ends, found[:, 0], side="right")
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    rows = []
    for i, words in enumerate(texts):
        own = found[bounds[i] : bounds[i + 1]].copy()
        own[:, 0] -= ends[i] - len(words)
        listed = own.tolist()
        told = "".join(f"{s},{length},{q}\n" for s, length, q in listed)
        best = (None, None, None, None)
        if listed:
            s, length, q = listed[0]
            for run in listed[1:]:  # by start, then period: a later one must be truly greater
                if run[1] * q > length * run[2]:
                    s, length, q = run
            best = (s, length, q, 1000 * length // q)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, own[:, 0] + own[:, 2], 1)
            np.add.at(step, own[:, 0] + own[:, 1], -1)
            words = [w for w, inside in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not inside]
        rows.append((len(listed), *best, _digest(told.encode()), _digest(b" ".join(words)), b" ".join(words)))
    return rows


_OUT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,"
    " runs_sha256 string, collapsed_sha256 string"
)


def _scan(change, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list) -> pa.RecordBatch:
            columns = list(zip(*_rows(texts), strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:7]]
            names = [f.split()[0] for f in _OUT.split(", ")]
            if keep_text:
                arrays.append(pa.array(columns[7], pa.binary()).cast(pa.string()))
                names.append("collapsed")
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            column = batch.column("text").cast(pa.large_binary())
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), column, strict=True):
                words = raw.as_py().split() if raw.is_valid else []  # bytes split at exactly the six ASCII signs
                if ids and size + len(words) > WORDS_AT_ONCE:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(change(words, doc_id) if change else words)
                size += len(words)
            if ids:
                yield out(ids, texts)

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None, keep_text: bool = False
) -> DataFrame:
    """The periodic runs of the words of each text (see ``find_runs``), one row per row of ``docs``.

    ``doc_id, n_runs``, then ``start, length, period, exponent_milli`` of the run with the greatest length per
    period (ties: smallest start, then period; null without a run), ``runs_sha256`` of all runs as lines
    ``start,length,period``, and ``collapsed_sha256`` of the text whose runs keep their first period only, words joined by
    one space; with ``keep_text`` that text follows as ``collapsed``.  ``change(words, doc_id)`` may alter the words first.

    Words are runs of characters other than space and the ASCII signs 9 to 13.  Null and empty texts have none, so
    no run.  Rows without id, repeated rows and texts of any length are treated alike, each for
    itself; other columns are ignored.  An empty table gives no rows.
    Nothing is shuffled: texts are searched together in groups of ``WORDS_AT_ONCE`` words, a longer one alone.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = _OUT + (", collapsed string" if keep_text else "")
    return own.mapInArrow(_scan(change, keep_text), schema).withColumnRenamed("doc_id", id_col)

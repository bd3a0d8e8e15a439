"""SentencePiece models and a batched Viterbi over equal-length words, in numpy.

A word is cut by the usual forward pass: the best path to a character's end goes through a
piece that ends there.  Words of equal length advance together; the hash of every
substring probes the sorted keys of the pieces; the best predecessor is kept as a backpointer.

What counts as best follows from the kind of the model.  In a unigram model it is the largest sum of
scores.  In a BPE model a path is right if no merge would have taken place across a
cut: exactly one piece ends a prefix's encoding, namely the one that forms a stable pair with the
last piece of the prefix before it.  Stable pairs have score 0 and others minus infinity, so the
maximum is the encoding that merging by rank gives, without merging.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

SPACE = "▁"
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_NONE = -1
_MEMO_BITS = 20
_PART_BITS = 17


def _powers(n: int) -> np.ndarray:
    return np.array([pow(int(_BASE), i, 2**64) for i in range(n + 1)], np.uint64)


class _Table:
    """Values by 64-bit key, probed as arrays; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self._shift))
        self._mask = size - 1
        self._keys = np.zeros(size, np.uint64)
        self._values = np.full(size, _NONE, np.int64)
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            at = ((k * int(_MIX)) & (2**64 - 1)) >> int(self._shift)
            while self._values[at] != _NONE:
                at = (at + 1) & self._mask
            self._keys[at], self._values[at] = k, v

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * _MIX) >> self._shift).astype(np.int64)
        value = self._values[at]
        wrong = np.flatnonzero((value != _NONE) & (self._keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self._mask
            value[wrong] = self._values[at[wrong]]
            wrong = wrong[(value[wrong] != _NONE) & (self._keys[at[wrong]] != keys[wrong])]
        return value


@dataclass
class PieceModel:
    """A vocabulary: ``pieces``, their ``scores`` and ``kinds``, and how texts are prepared."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    dummy_prefix: bool = True
    longest: int = field(init=False)

    @classmethod
    def load(cls, content: bytes) -> PieceModel:
        """From the bytes of a ``.model`` file; texts must need no normalising beyond spaces."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(content)
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        kinds = [p.type for p in model.pieces]
        if _USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        return cls(
            [p.piece for p in model.pieces],
            [p.score for p in model.pieces],
            kinds,
            model.trainer_spec.model_type == 1,
            rules.add_dummy_prefix,
        )

    def __post_init__(self):
        usable = [i for i, k in enumerate(self.kinds) if k == _NORMAL and self.pieces[i]]
        self.unknown = self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == _BYTE}
        # numbers: single characters first, then the unknown one, then longer pieces, best score first
        single = [i for i in usable if len(self.pieces[i]) == 1]
        longer = sorted((i for i in usable if len(self.pieces[i]) > 1), key=lambda i: (-self.scores[i], i))
        self.unk_number = len(single)
        self.id_of = np.array([*single, self.unknown, *longer], np.int64)
        text_of = [self.pieces[i] for i in self.id_of]
        self.number = {t: n for n, t in enumerate(text_of) if n != self.unk_number}
        self.longest = max([1, *(len(t) for t in self.number)])
        least = min([self.scores[i] for i in usable], default=0.0)
        self.score_of = np.array([self.scores[i] for i in self.id_of])
        self.score_of[self.unk_number] = least - 10.0
        self._power = _powers(self.longest)
        if not self.unigram:
            self._prepare_merges(text_of)
        keys = np.array([self._hash(t) for t in self.number], np.uint64)
        numbers = np.array(list(self.number.values()), np.int64)
        keys = keys * _MIX
        order = np.argsort(keys)
        self._keys, self._numbers = keys[order], numbers[order]
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # where the sorted keys of each leading part begin; the sentinel at the end matches nothing
        leading = (self._keys >> np.uint64(64 - _PART_BITS)).astype(np.int64)
        self._begin = np.searchsorted(leading, np.arange((1 << _PART_BITS) + 1)).astype(np.int32)
        self._crowd = int(np.diff(self._begin).max(initial=0))
        codes = np.array([ord(text_of[n]) for n in range(len(single))], np.int64)
        by_code = np.argsort(codes)
        self._codes, self._code_numbers = codes[by_code], by_code

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or ``_NONE``, by probing the sorted keys."""
        h = (h * _MIX).reshape(-1)
        part = (h >> np.uint64(64 - _PART_BITS)).astype(np.int64)
        out = np.full(len(h), _NONE, np.int32)
        begin, end = self._begin[part], self._begin[part + 1]
        left = np.flatnonzero(begin < end)
        begin, end, h = begin[left], end[left], h[left]
        for _ in range(self._crowd):
            hit = self._keys[begin] == h
            out[left[hit]] = self._numbers[begin[hit]]
            begin = begin + 1
            more = ~hit & (begin < end)
            if not more.any():
                break
            left, begin, end, h = left[more], begin[more], end[more], h[more]
        return out

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    # --- merging, one word at a time: for tables, odd words and tests -----------------

    def merge(self, word: str) -> list[int]:
        """Numbers of a word by merging the best adjacent pair, the leftmost of equal ones."""
        parts, after = list(word), list(range(1, len(word) + 1))
        before, end = list(range(-1, len(word) - 1)), len(word)
        waiting = []  # pairs by falling score, then place; those whose parts have changed since are passed over

        def offer(i: int) -> None:
            j = after[i]
            if j < end:
                text = parts[i] + parts[j]
                n = self.number.get(text)
                if n is not None:
                    heapq.heappush(waiting, (-self.score_of[n], i, j, text))

        for i in range(end - 1):
            offer(i)
        while waiting:
            _, i, j, text = heapq.heappop(waiting)
            if parts[i] is None or after[i] != j or parts[i] + parts[j] != text:
                continue
            parts[i], parts[j], after[i] = text, None, after[j]
            if after[i] < end:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.number.get(p, self.unk_number) for p in parts if p is not None]

    def _prepare_merges(self, text_of: list[str]) -> None:
        size = len(text_of)
        self._left, self._right = np.arange(size), np.arange(size)
        self._memo_keys = np.zeros(1 << _MEMO_BITS, np.uint64)
        self._memo = np.zeros(1 << _MEMO_BITS, bool)
        pairs, merged, lost = [], [], []
        for n in range(self.unk_number + 1, size):
            text = text_of[n]
            for cut in range(1, len(text)):
                a, b = self.number.get(text[:cut]), self.number.get(text[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(n)
            # the piece made from its letters: the last merge joins what is left without it
            own = self.number.pop(text)
            halves = self.merge(text)
            self.number[text] = own
            if len(halves) == 2:
                self._left[n], self._right[n] = halves
            else:
                lost.append(text)  # no merging ever makes it
        self._pairs = _Table(np.array(pairs, np.uint64), np.array(merged, np.int64))
        for text in lost:
            del self.number[text]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stable``, with the answers for pairs met lately kept in a table of fixed size."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) + np.uint64(1))
        at = ((key * _MIX) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        good = self._memo[at]
        new = np.flatnonzero(self._memo_keys[at] != key)
        if len(new):
            good[new] = self._stable(a[new], b[new])
            self._memo_keys[at[new]], self._memo[at[new]] = key[new], good[new]
        return good

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between pieces ``a`` and ``b``.

        Takes both apart again, the later merge first, and looks whether the two pieces at the border would have
        been joined before that merge.
        """
        a, b = a.copy(), b.copy()
        good = np.zeros(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        open_ = np.arange(len(a))
        while len(open_):
            x, y, top = a[open_], b[open_], limit[open_]
            joined = self._pairs((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            alive = (joined == _NONE) | (joined >= top)
            open_, x, y = open_[alive], x[alive], y[alive]
            inner_x, inner_y = self._right[x], self._left[y]
            can_x, can_y = inner_x != x, inner_y != y
            take_x = can_x & ((x > y) | ~can_y)
            take_y = can_y & ~take_x
            limit[open_] = np.where(take_x, x, y + 1)
            a[open_] = np.where(take_x, inner_x, x)
            b[open_] = np.where(take_y, inner_y, y)
            done = ~(take_x | take_y)
            good[open_[done]] = True
            open_ = open_[~done]
        return good

    # --- words of one length -----------------------------------------------------------

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and piece lengths of words of equal length, right-aligned, ``_NONE`` before them."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes.reshape(n, size).astype(np.int64)
        at = np.minimum(np.searchsorted(self._codes, codes), max(0, len(self._codes) - 1))
        letters = np.where(self._codes[at] == codes, self._code_numbers[at], self.unk_number) if len(
            self._codes
        ) else np.full_like(codes, self.unk_number)
        prefix = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        found = {1: letters}
        for length in range(2, min(size, self.longest) + 1):
            h = prefix[:, length:] - prefix[:, :-length] * self._power[length]
            found[length] = self.find(h).reshape(h.shape)
        last = np.full((n, size + 1), _NONE, np.int64)
        back = np.zeros((n, size + 1), np.int32)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, size + 1):
            for length in range(min(end, self.longest), 0, -1):  # of equal scores the longer last piece
                piece = found[length][:, end - length]
                rows = np.flatnonzero((piece != _NONE) & (best[:, end - length] > -np.inf))
                if not len(rows):
                    continue
                piece = piece[rows]
                score = best[rows, end - length]
                if self.unigram:
                    score = score + self.score_of[piece]
                elif end > length:
                    score = np.where(self.stable(last[rows, end - length], piece), score, -np.inf)
                better = score > best[rows, end]
                rows = rows[better]
                best[rows, end], last[rows, end], back[rows, end] = score[better], piece[better], length
        numbers = np.full((n, size), _NONE, np.int64)
        lengths = np.zeros((n, size), np.int64)
        at, rows = np.full(n, size), np.arange(n)
        for column in range(size - 1, -1, -1):
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
            numbers[rows, column] = last[rows, at[rows]]
            lengths[rows, column] = back[rows, at[rows]]
            at[rows] -= back[rows, at[rows]]
        return numbers, lengths


_LONG = 48  # characters of a word that is worth looking for cuts in


class Encoder:
    """Ids of texts; remembers the words it has cut, up to ``most_words`` of them."""

    # A line break is a word of its own as no piece crosses it; a space belongs to what follows.
    _words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

    def __init__(self, model: PieceModel, most_words: int = 150_000, chunk: int = 20_000):
        self.model, self._most, self._chunk = model, most_words, chunk
        # two signs that no piece has side by side: words may be cut between them
        self._inner = {p[i : i + 2] for p in model.number for i in range(len(p) - 1)}
        self._whole = any("\n" in p or SPACE in p.lstrip(SPACE) for p in model.number)
        self._forget()

    def _forget(self) -> None:
        self._index: dict[str, int] = {}
        self._flat = np.zeros(0, np.int32)
        self._start = np.zeros(1, np.int64)

    def _split(self, text: str) -> list[str]:
        text = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        words = [text] if self._whole else self._words.findall(text)
        if max(map(len, words), default=0) <= _LONG:
            return words
        return list(chain.from_iterable([w] if len(w) <= _LONG else self._cuts(w) for w in words))

    def _cuts(self, word: str) -> list[str]:
        """A long word in parts that no piece reaches over, so that these are cut together with words of their length."""
        at = [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self._inner], len(word)]
        return [word[i:j] for i, j in zip(at, at[1:])]

    def _ids(self, word: str, numbers: list[int], lengths: list[int]) -> list[int]:
        out, at = [], 0
        for number, length in zip(numbers, lengths, strict=True):
            if number == self.model.unk_number and self.model.byte_ids:
                out += [self.model.byte_ids[b] for b in word[at].encode("utf-8", "replace")]
            else:
                out.append(int(self.model.id_of[number]))
            at += length
        return out

    def _learn(self, new: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        odd = []
        for word in new:
            # several spaces in a row: their pieces may tie in score, which only merging settles
            if not self.model.unigram and word[:2] == SPACE * 2:
                odd.append(word)
            else:
                by_length.setdefault(len(word), []).append(word)
        flats, counts = [self._flat], [np.diff(self._start)]
        for word in odd:
            numbers = self.model.merge(word)
            text_of = [1 if n == self.model.unk_number else len(self.model.pieces[self.model.id_of[n]]) for n in numbers]
            ids = self._ids(word, numbers, text_of)
            self._index[word] = len(self._index)
            flats.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)]))
        for length, words in by_length.items():
            step = max(1, self._chunk * 8 // max(8, length))
            for start in range(0, len(words), step):
                some = words[start : start + step]
                numbers, lengths = self.model.cut(some)
                used = numbers != _NONE
                count = used.sum(axis=1)
                ids = self.model.id_of[np.where(used, numbers, 0)].astype(np.int32)
                unknown = (numbers == self.model.unk_number).any(axis=1)
                if unknown.any() and self.model.byte_ids:
                    rows = []
                    for i, word in enumerate(some):
                        row = ids[i][used[i]]
                        if unknown[i]:
                            row = np.array(self._ids(word, numbers[i][used[i]], lengths[i][used[i]]), np.int32)
                        rows.append(row)
                    count = np.array([len(r) for r in rows])
                    flats.append(np.concatenate(rows))
                else:
                    flats.append(ids[used])
                counts.append(count)
                for word in some:
                    self._index[word] = len(self._index)
        self._flat = np.concatenate(flats)
        self._start = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offset at which each text's begin."""
        if len(self._index) > self._most:
            self._forget()
        split = [self._split(t) if t else [] for t in texts]
        index = self._index
        new = list(set(chain.from_iterable(split)).difference(index))
        if new:
            self._learn(new)
        total = sum(map(len, split))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, total)
        count = self._start[at + 1] - self._start[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self._flat[np.repeat(self._start[at] - ends[:-1], count) + np.arange(ends[-1])]
        words = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        return ids, ends[words]


class Decoder:
    """Texts of ids.  Unknown ids and ids outside the vocabulary become the library's sign for them."""

    def __init__(self, model: PieceModel):
        self._bytes = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == _BYTE:
                self._bytes.append(bytes([int(piece[1:-1], 16)]))
            elif kind == _CONTROL:
                self._bytes.append(b"")
            elif kind == _UNKNOWN:
                self._bytes.append(" ⁇ ".encode())
            else:
                self._bytes.append(piece.replace(SPACE, " ").encode())
        self._prefix = model.dummy_prefix

    def __call__(self, ids: np.ndarray) -> str:
        size = len(self._bytes)
        if len(ids) and (ids.min() < 0 or ids.max() >= size):
            sign = " ⁇ ".encode()
            raw = b"".join(self._bytes[i] if 0 <= i < size else sign for i in ids.tolist())
        else:
            raw = b"".join(map(self._bytes.__getitem__, ids.tolist()))
        if self._prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

"""Ids of texts by their segments, each distinct segment tokenised once.

A segment is a run of white space and what follows up to the next white space.
The byte-level pattern never has a piece that goes from another character into
white space, and neither has a sentencepiece vocabulary, so the ids of a text
are those of its segments, one after the other. (Such a vocabulary may go into
a carriage return, so no segment begins at one.) Segments are found, hashed and
looked up as arrays, for many texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from zonestats.llm import textkernel as tk
from zonestats.llm.byte_bpe import byte_chars

HELD_BYTES = 128 << 20  # bytes of ids and of table entries (``PER_SEGMENT`` each) that a worker's table holds
PER_SEGMENT = 160
JOINED = 4096  # segments that make one text
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: White beyond ASCII. A text that has some is not cut: a run of white space may hold both kinds.
_WIDE_WHITE = re.compile("[\x85\xa0  -     　]").search
_U = np.uint64
_CHARS = [tk.stream(256, seed) | _U(1) for seed in (31, 37)]
_STEP = _U(0xD1342543DE82EF95)
_SHOWN = dict(enumerate(byte_chars())) | {255: "\n"}  # no UTF-8 text has the byte 255


def can_cut(text: str) -> bool:
    return text.isascii() or _WIDE_WHITE(text) is None


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the segments of texts that lie end to end in ``data``."""
    white = _WHITE[data]
    begins = white & (data != 13)
    begins[1:] &= ~white[:-1]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begins)


def segment_hashes(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each segment."""
    lengths = np.diff(np.append(starts, len(data)))
    powers = np.full(int(lengths.max()), _STEP)
    powers[0] = 1
    with np.errstate(over="ignore"):
        power = np.cumprod(powers)[np.arange(len(data)) - np.repeat(starts, lengths)]
        return [tk.mix(np.add.reduceat(chars[data] * power, starts) + lengths.astype(np.uint64)) for chars in _CHARS]


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each of many ranges."""
    total = np.cumsum(counts)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - counts), counts)


def encode_segments(encode: Callable[[list[str]], list[np.ndarray]], sizes: np.ndarray, raw: np.ndarray,
                    lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each segment) of distinct segments that lie end to end in
    ``raw``. ``encode`` gives the ids of texts, ``sizes`` the bytes of each id.
    Segments that begin with white space and end otherwise make texts of
    ``JOINED`` of them, whose ids are cut at the segments' last bytes; ids of
    which one goes across such a place raise."""
    begin = np.cumsum(lengths) - lengths
    chained = _WHITE[raw[begin]] & ~_WHITE[raw[begin + lengths - 1]]
    chain = np.flatnonzero(chained)
    groups = [chain[i:i + JOINED] for i in range(0, len(chain), JOINED)] + [np.array([k]) for k in np.flatnonzero(~chained)]
    places = [spread(begin[g], lengths[g]) for g in groups]
    counts, found = np.zeros(len(lengths), np.int64), encode([raw[p].tobytes().decode() for p in places])
    for g, ids in zip(groups, found):
        ends, last = np.cumsum(sizes[ids]), np.cumsum(lengths[g])
        cuts = np.searchsorted(ends, last) + 1
        if cuts[-1] != len(ids) or not np.array_equal(ends[cuts - 1], last):
            raise ValueError("a token goes across the beginning of a segment")
        counts[g] = np.diff(cuts, prepend=0)
    flat, at = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
    for g, ids in zip(groups, found):
        flat[spread(at[g], counts[g])] = ids
    return flat, counts


class _Pool:
    """Ids of the segments learnt so far, by segment number."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.begin = np.append(self.begin, self.used + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.used += len(ids)


class _Numbers(dict):
    """Numbers of strings in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class PieceTable:
    """Ids of texts by the pieces of the byte-level pattern. Each distinct piece
    goes through a model of the tokenizers library once: the new ones of a call
    as one text, in byte characters, with line feeds between (which no byte
    character is). ``sizes`` are the bytes of each id. ``whole`` encodes the
    texts that ``cut`` does not cut."""

    def __init__(self, model, sizes: np.ndarray, cut: Callable[[str], list[str] | None], whole: Callable[[str], list[int]],
                 limit: int = HELD_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.sizes, self.cut, self.whole, self.limit = sizes, cut, whole, limit
        self.numbers, self.pool = _Numbers(), _Pool()

    def _learn(self, parts: list[str]) -> None:
        raw = [p.encode() for p in parts]
        shown = b"\xff".join(raw).decode("latin-1").translate(_SHOWN)
        ids = np.array(self.tokenizer.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(list(map(len, raw)))) + 1
        self.pool.add(ids, np.diff(cuts, prepend=0))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) * PER_SEGMENT + 4 * self.pool.used > self.limit:
            self.numbers, self.pool = _Numbers(), _Pool()
        get, cut = self.numbers.__getitem__, [self.cut(t) for t in texts]
        found = [c and np.array(list(map(get, c)), np.int64) for c in cut]
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        pool, out = self.pool, []
        for text, which in zip(texts, found):
            if which is None:
                out.append(np.array(self.whole(text), np.int32))
            else:
                out.append(pool.ids[spread(pool.begin[which], pool.count[which])])
        return out


class SegmentTable:
    """Tokenises texts. ``learn`` takes new distinct segments (bytes end to end,
    lengths) and returns (ids, ids of each) for each of ``pools`` tokenizers.
    Segments are known by two hashes of 64 bits together. A table that holds
    too much is emptied between calls."""

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]], pools: int = 1,
                 limit: int = HELD_BYTES):
        self.learn, self.n, self.limit = learn, pools, limit
        self._empty()

    def _empty(self) -> None:
        self.number: dict[int, int] = {}
        self.check = np.zeros(0, np.uint64)
        self.pools = [_Pool() for _ in range(self.n)]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer (ids of all texts, ids of each text)."""
        if len(self.number) * PER_SEGMENT + sum(4 * p.used for p in self.pools) > self.limit:
            self._empty()
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        if not len(data):
            return [(np.zeros(0, np.int32), np.zeros(len(texts), np.int64)) for _ in range(self.n)]
        starts = segment_starts(data, offsets)
        one, two = segment_hashes(data, starts)
        keys, at, inverse = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(two, two[at][inverse]):
            raise RuntimeError("two segments share a 64-bit hash")
        numbers = list(map(self.number.get, keys.tolist()))
        new = [i for i, v in enumerate(numbers) if v is None]
        if new:
            first, lengths = starts[at[new]], np.diff(np.append(starts, len(data)))[at[new]]
            for pool, (ids, counts) in zip(self.pools, self.learn(data[spread(first, lengths)], lengths)):
                pool.add(ids, counts)
            for i, k, v in zip(new, keys[new].tolist(), range(len(self.number), len(self.number) + len(new))):
                numbers[i] = self.number[k] = v
            self.check = np.append(self.check, two[at[new]])
        numbers = np.array(numbers, np.int64)
        if not np.array_equal(self.check[numbers], two[at]):
            raise RuntimeError("two segments share a 64-bit hash")
        which = numbers[inverse]
        bounds = np.searchsorted(starts, offsets)
        out = []
        for pool in self.pools:
            counts = pool.count[which]
            total = np.concatenate([[0], np.cumsum(counts)])
            out.append((pool.ids[spread(pool.begin[which], counts)], np.diff(total[bounds])))
        return out

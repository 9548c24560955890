"""A bounded memory of encoded text segments, and gathering of their ids for many texts at once.

Segments are spans of code points. They are found, told apart by two 64-bit hashes and looked up in arrays; only a
segment that is not remembered becomes a string of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Characters of text taken at once: it bounds what the segments of a block need, whatever a batch holds.
BLOCK_CHARS = 400_000
#: Characters hashed at once.
HASH_CHARS = 1 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _scale(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse; grown as needed."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = int(_ODD[which])
        bases = (_ODD[which], np.uint64(pow(base, -1, 1 << 64)))
        _powers[which] = tuple(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b))).cumprod(dtype=np.uint64) for b in bases)
    return _powers[which]


def _hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span, in order; spans do not overlap."""
    out = np.zeros((2, len(starts)), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(ends.searchsorted(starts[first] + HASH_CHARS, "right")))
        low = starts[first]
        part = code[low : ends[last - 1]].astype(np.uint64) + np.uint64(1)
        a, b = starts[first:last] - low, ends[first:last] - low
        for which in (0, 1):
            up, down = _scale(which, len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            x = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD[1 - which]
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out[which, first:last] = x ^ x >> np.uint64(32)
        first = last
    return out[0], out[1]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    ends = lengths.cumsum()
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class SegmentCache:
    """ids of segments, each encoded once while it is held.

    When it holds ``limit`` segments, or 8 * limit ids, it forgets those that were not asked for again, and of the others
    all but limit / 2. encode gives the ids of a list of segments in order, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and where each is held
        self.checks, self.again = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, bool)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.values = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _hold(self, keys: np.ndarray, checks: np.ndarray, found: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Remembers segments, keys in order; returns where."""
        have, need = len(self.keys), self.used + len(found)
        while len(self.starts) < have + len(keys):
            self.starts, self.lengths, self.checks, self.again = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths, self.checks, self.again))
        while len(self.values) < need:
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        at = np.arange(have, have + len(keys))
        self.lengths[at], self.checks[at], self.again[at] = lengths, checks, False
        self.starts[at] = self.used + lengths.cumsum() - lengths
        self.values[self.used : need] = found
        self.used = need
        where = self.keys.searchsorted(keys)
        self.keys, self.places = np.insert(self.keys, where, keys), np.insert(self.places, where, at)
        return at

    def _trim(self) -> None:
        keep = self.again[self.places]
        if keep.sum() > self.limit // 2:  # the latest of them
            keep &= self.places >= np.sort(self.places[keep])[-(self.limit // 2)]
        keys, at = self.keys[keep], self.places[keep]
        checks, lengths, held = self.checks[at], self.lengths[at], self.values[spans(self.starts[at], self.lengths[at])]
        self.clear()
        self._hold(keys, checks, held, lengths)

    def gather(self, text: str, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments of a text in order, how many each has)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.keys) > self.limit or self.used > 8 * self.limit:
            self._trim()
        all_keys, all_checks = _hashes(code, starts, ends)
        keys, first, inverse = np.unique(all_keys, return_index=True, return_inverse=True)
        checks = all_checks[first]
        near = np.minimum(self.keys.searchsorted(keys), max(0, len(self.keys) - 1))
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        at = np.zeros(len(keys), np.int64)
        at[known] = self.places[near[known]]
        if (checks[inverse] != all_checks).any() or (self.checks[at[known]] != checks[known]).any():
            # two segments with one hash: nothing is looked up or remembered
            return self.encode([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        self.again[at[known]] = True
        new = ~known
        if new.any():
            found, lengths = self.encode([text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at[new] = self._hold(keys[new], checks[new], found, lengths)
        at = at[inverse]
        lengths = self.lengths[at]
        return self.values[spans(self.starts[at], lengths)], lengths


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in order, how many each list has)."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for x in found for i in x), np.int32, lengths.sum()), lengths


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, null as empty, of about ``most`` characters together; a longer text is a block of its own."""
    block: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def encode_block(
    cache: SegmentCache, texts: list[str], cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], same: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, how many each text has).

    cut gives the starts and ends of the segments of code points; its other argument is True where a text begins. same
    maps each code point to one that means the same to encode.
    """
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    code = code if same is None else same[code]
    begins = np.concatenate(([0], np.fromiter(map(len, texts), np.int64, len(texts)).cumsum()))
    fresh = np.zeros(len(code), bool)
    fresh[begins[:-1][begins[:-1] < len(code)]] = True
    starts, ends = cut(code, fresh)
    ids, lengths = cache.gather(joined, code, starts, ends)
    ends = np.concatenate(([0], lengths.cumsum()))
    return ids, np.diff(ends[starts.searchsorted(begins)])

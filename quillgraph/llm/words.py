"""Vectorised words of whole batches of texts: words are runs of bytes other than x20 and x09 to x0D."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillgraph.llm.common import mix64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: One random 64-bit value for each byte and an odd multiplier: word codes are sums of value x multiplier**place.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """MULTIPLIER**0 to MULTIPLIER**(n-1), modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024), MULTIPLIER, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


@dataclass
class Words:
    """start and end of each word in the bytes; first: for each text the index of its first word, and the total."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of each text; a word never crosses the border between two texts. space: the bytes between words."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    solid = ~space[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    begins[borders] |= solid[borders]
    ends[borders - 1] |= solid[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def word_codes(words: Words, data: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """A cheap 64-bit code of each word's bytes, for features: where codes may collide without harm to a result."""
    length = words.end - words.start
    out = np.zeros(len(length), np.uint64)
    ends, low = np.cumsum(length), 0
    while low < len(length):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        own = length[low:high]
        begin = np.cumsum(own) - own
        place = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(begin, own)
        value = BYTE_VALUE[data[place + np.repeat(words.start[low:high], own)]]
        value *= powers(int(own.max()))[place]
        out[low:high] = np.add.reduceat(value, begin)
        low = high
    out += length.astype(np.uint64)
    return mix64(out)


#: Keys of independent word hashes, and odd multipliers of what is combined.
KEYS = tuple(int(k) for k in mix64(np.array([11, 13], np.uint64)))
LEFT, RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes, in this order; not linear in either, so that no pattern of words cancels out."""
    out = a * LEFT
    out ^= out >> np.uint64(29)
    out += b * RIGHT
    return mix64(out)


def word_hashes(words: Words, data: np.ndarray, key: int = 0) -> np.ndarray:
    """A keyed 64-bit hash of each word's bytes: eight bytes at a time are mixed into what the ones before them gave."""
    length = words.end - words.start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    out = mix64(length.astype(np.uint64) ^ np.uint64(KEYS[key]))
    at, left, open_ = words.start, length, None
    while len(at):
        chunk = eight[at] & KEEP[np.minimum(left, 8)]
        if open_ is None:
            out = joined(out, chunk)
            open_ = np.flatnonzero(left > 8)
        else:
            out[open_] = joined(out[open_], chunk)
            open_ = open_[left > 8]
        more = left > 8
        at, left = at[more] + 8, left[more] - 8
    return out


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each place with `size` hashes from it on, a 64-bit hash of that sequence (texts not considered).

    Sequences of 1, 2, 4, ... are joined in pairs, so about twice the logarithm of size passes make it.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, width, power = None, 0, 1, hashes
    while True:
        if size & width:
            part = power[done : done + n]
            out = part.copy() if out is None else joined(out, part)
            done += width
        width *= 2
        if width > size:
            return out
        power = joined(power[: -(width // 2)], power[width // 2 :])


def range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence hashes[start:end]: neighbours are joined until one is left of each."""
    size = end - start
    begin = np.cumsum(size) - size
    value = hashes[np.arange(int(size.sum())) - np.repeat(begin - start, size)]
    left = size.copy()
    while (left > 1).any():
        half = (left + 1) // 2
        owner = np.repeat(np.arange(len(left)), half)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(half) - half, half)
        at = begin[owner] + 2 * place
        alone = 2 * place + 1 == left[owner]
        second = value[np.where(alone, at, at + 1)]
        value = np.where(alone, value[at], joined(value[at], second))
        begin, left = np.cumsum(half) - half, half
    out = size.astype(np.uint64)
    some = size > 0
    out[some] = joined(value[begin[some]], out[some])
    return mix64(out)

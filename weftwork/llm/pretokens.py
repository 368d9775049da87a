"""Pre-tokens of texts of Latin letters and ASCII, cut and looked up as numpy vectors over whole batches.

They are those of the usual pattern of byte-level vocabularies::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Pre-tokens are told apart by 64-bit hashes; that two of them are confused by chance is not considered.
"""

from __future__ import annotations

import numpy as np

from weftwork.llm.textbatch import _powers, mix

_OTHER, _LETTER, _DIGIT, _MARK, _BLANK = range(5)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
# U+00C0 to U+024F, with the exceptions of ``plain``.
_CLASS[0x80:0xC0] = _CLASS[0xC3:0xCA] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CODE = np.random.Generator(np.random.PCG64(20250211)).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def plain(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text, of UTF-8 bytes with n + 1 offsets, has Latin letters and ASCII without control characters alone."""
    odd = _CLASS[data] == _OTHER
    high = np.flatnonzero(data >= 0xC3)
    high = high[data[high] < 0xCA]
    lead, then = data[high], data[high + 1]
    # U+00D7 and U+00F7 are marks; from U+0250 on there are others too.
    odd[high[((lead == 0xC3) & ((then == 0x97) | (then == 0xB7))) | ((lead == 0xC9) & (then >= 0x90))]] = True
    out = np.ones(len(offs) - 1, bool)
    out[np.searchsorted(offs, np.flatnonzero(odd), "right") - 1] = False
    return out


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each pre-token of plain texts, first pre-token of each text as n + 1 offsets)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    blank = kind == _BLANK
    # A space goes with what follows it; before that, other white space ends.
    first[1:] &= blank[1:] | (data[:-1] != 0x20)
    first[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:-1]
    first |= edge[:-1]
    mark = np.flatnonzero(data == 0x27)
    if len(mark):
        mark = mark[first[mark]]
        # The letters after an apostrophe, 0 beyond its text.
        left = offs[np.searchsorted(offs, mark, "right")] - mark
        a = np.where(left > 1, data[np.minimum(mark + 1, n - 1)], 0)
        b = np.where(left > 2, data[np.minimum(mark + 2, n - 1)], 0)
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        short = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        first[mark[short | long] + 1] = False
        end = np.concatenate([mark[short] + 2, mark[long] + 3])
        first[end[end < n]] = True
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to the next one; 0 is none."""
    n = len(data)
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * power[:n], out=total[1:])
        ends = np.append(starts[1:], n)
        h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return np.maximum(h, np.uint64(1))


class Table:
    """The ids of pre-tokens by their hashes: open addressing, ids in one array."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        self.size = 0
        self.starts, self.counts = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it isn't there."""
        place = (h & self.mask).astype(np.int64)
        there = self.keys[place]
        out = np.where(there == h, self.at[place], np.int32(-1))
        on = np.flatnonzero((there != h) & (there != 0))
        while len(on):
            place[on] = (place[on] + 1) & int(self.mask)
            there = self.keys[place[on]]
            hit = there == h[on]
            out[on[hit]] = self.at[place[on[hit]]]
            on = on[~hit & (there != 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Take in new, distinct hashes with their ids, which follow one another."""
        more, n = len(h), len(ids)
        if 4 * (self.size + more) > 3 * len(self.keys):
            self._widen(2 * (self.size + more))
        while len(self.starts) < self.size + more:
            self.starts, self.counts = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.counts, np.zeros_like(self.counts))
        while len(self.ids) < self.used + n:
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + n] = ids
        self.counts[self.size : self.size + more] = counts
        self.starts[self.size : self.size + more] = self.used + np.cumsum(counts) - counts
        self._put(h, np.arange(self.size, self.size + more, dtype=np.int32))
        self.size, self.used = self.size + more, self.used + n

    def _widen(self, most: int) -> None:
        there = np.flatnonzero(self.keys)
        h, number = self.keys[there], self.at[there]
        size = 1 << int(most).bit_length()
        self.mask, self.keys, self.at = np.uint64(size - 1), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self._put(h, number)

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        place = (h & self.mask).astype(np.int64)
        on = np.arange(len(h))
        while len(on):
            free = on[self.keys[place[on]] == 0]
            self.keys[place[free]] = h[free]
            won = free[self.keys[place[free]] == h[free]]
            self.at[place[won]] = number[won]
            on = on[self.keys[place[on]] != h[on]]
            place[on] = (place[on] + 1) & int(self.mask)

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the numbered hashes in a row, how many each has)."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts, dtype=np.int64)
        at = np.repeat(self.starts[numbers] - (ends - counts), counts)
        at += np.arange(len(at))
        return self.ids[at], counts

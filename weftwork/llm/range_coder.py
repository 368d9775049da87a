"""Adaptive context-mixing range coder for token ids.

A segment is cut into blocks of equally many ids. Every block starts with a fresh model and has a
checksum of its own, so one damaged block leaves the others readable. All blocks of a segment are
coded in step, one id of each at a time, as numpy vectors; nothing passes between them. The more
blocks a segment has, the less an id costs.

Model of a block. Order 2 and order 1 each predict one id, the one last confirmed after the last
two ids and after the last id, with a confidence of 1 to 3. The chances that the predictions hold
are learnt for each pair of confidences and blended: that of order 2, what it leaves times that of
order 1, and the rest for order 0. Order 0 splits the ids, ranked by their frequency in the
segment, into classes of 1, 2, 4, 8 ... ranks; chances of the classes are learnt, ranks of a class
are equally likely and are stored as plain bits. The classes' chances begin as those of the segment.

All arithmetic is on integers, so every machine decodes alike. Those of the coder's interval, of up
to 49 bits, are kept as doubles, which hold them exactly and divide faster; a quotient below 2^17 of
such numbers, rounded to a double, does not reach the next integer.

Layout, little-endian: magic, ids, ids in a block, dictionary size, bytes and crc32 of the packed
dictionary (u32 each); the edges of the classes (u16 each) and the dictionary, ids by rank, packed with
zlib; bytes and crc32 of each block (u32 each); the blocks. A block is 16-bit words: the coder's from the
front, plain bits from the back.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WFT2"
BLOCK = 2048
#: A block's table has so many places for order 2, by powers of 2, and then for order 1.
_BITS2, _BITS1 = 11, 10
_PLACES = (1 << _BITS2) + (1 << _BITS1)
_RATE = 5
#: Classes are learnt from one id of so many.
_EVERY, _CLASS_RATE = 4, 6
#: Chances of predictions move towards one of these, and stay 0 where there is none.
_MISS, _HIT = 31, 58_000
#: With the slowest rate a class keeps 41 of 2^15, and 1 of 2^16 where both predictions are as sure as they get.
_GAP, _ONE = 104, 1 << 15
_FULL, _LEAST = float(1 << 48), float(1 << 32)
_HASH_A, _HASH_B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Ids up to here are counted in an array.
_DENSE = 1 << 22


class _Model:
    """What the blocks of a segment have learnt; x is a rank plus one.

    Lanes are blocks, and the last axis of every array. ``narrow`` sets how many of them take part.
    """

    def __init__(self, lanes: int, edges: np.ndarray) -> None:
        classes = len(edges) - 1
        self.lanes, self.classes = lanes, classes
        self.table = np.zeros(lanes * _PLACES, np.uint32)
        # Chances of order 2, in the upper half, and of order 1 by four times the confidence of order 2 plus that of order 1.
        upper = np.repeat(np.array([0, 20_000, 40_000, 52_000], np.uint32), 4)
        lower = np.array([0, 16_000, 30_000, 44_000] + [0, 12_000, 24_000, 36_000] * 3, np.uint32)
        self.q = np.tile(upper << 16 | lower, lanes)
        # Lower edges of the classes and the upper one of the last; those between move.
        self.cdf = np.repeat(edges.astype(np.uint16)[:, None], lanes, 1)
        self.edges = self.cdf.reshape(-1)
        self.number = np.arange(1, classes, dtype=np.int16)[:, None]
        self.far = np.int16(_ONE - classes * _GAP)
        self.goal = self.number * np.int16(_GAP) + self.far
        self.b, self.ha = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.narrow(lanes)

    def narrow(self, m: int) -> None:
        """Go on with the first m blocks alone."""
        self.lane = np.arange(m, dtype=np.int64)
        self.at, self.row = self.lane * _PLACES + np.array([[0], [1 << _BITS2]]), self.lane << 4
        self.u2 = np.empty((2, m), np.uint32)
        self.b, self.ha = self.b[:m].copy(), self.ha[:m].copy()
        self.inner = self.cdf[1:-1, :m].view(np.int16)
        self.above = np.empty((self.classes - 1, m), np.int16)
        self.hb, self.u, self.m2, self.m1, self.p1, self.p3, self.p4, self.base, self.rest = np.empty((9, m), np.uint32)
        # Of order 2 and of order 1: places in the table, entries, predictions, confidences.
        self.k, self.iq, self.ic = np.empty((2, m), np.int64), np.empty(m, np.int64), np.empty(m, np.int64)
        self.e, self.c, self.s = np.empty((3, 2, m), np.uint32)
        self.c2, self.c1 = self.c
        self.step = np.empty((2, m), np.int8)
        self.lo, self.hi = np.empty((2, m), np.uint16)

    def predict(self) -> None:
        """Set the predictions c2, c1 and the shares m2, m1 and rest."""
        u, m2, m1 = self.u, self.m2, self.m1
        np.multiply(self.b, _HASH_A, out=self.hb)
        np.multiply(self.b, _HASH_B, out=u)
        np.add(u, self.ha, out=u)
        np.right_shift(u, 32 - _BITS2, out=self.u2[0])
        np.right_shift(self.hb, 32 - _BITS1, out=self.u2[1])
        np.add(self.u2, self.at, out=self.k)
        self.ha, self.hb = self.hb, self.ha
        self.table.take(self.k, out=self.e, mode="clip")
        np.right_shift(self.e, 2, out=self.c)
        np.bitwise_and(self.e, 3, out=self.s)
        np.left_shift(self.s[0], 2, out=u)
        np.bitwise_or(u, self.s[1], out=u)
        np.add(u, self.row, out=self.iq)
        self.q.take(self.iq, out=m2, mode="clip")
        np.bitwise_and(m2, 0xFFFF, out=self.p1)
        np.right_shift(m2, 16, out=m2)
        self.differ = self.c1 != self.c2
        np.subtract(65_536, m2, out=u)
        np.multiply(u, self.p1, out=m1)
        np.right_shift(m1, 16, out=m1)
        np.multiply(m1, self.differ, out=m1)
        np.add(m2, m1, out=self.base)
        np.subtract(65_536, self.base, out=self.rest)

    def find(self, w: np.ndarray) -> np.ndarray:
        """The classes that the places w, of 2^15, lie in."""
        np.subtract(self.inner, w + np.int16(1), out=self.above)
        np.right_shift(self.above, 15, out=self.above)  # -1 for the edges up to a class's own, 0 above
        kind = np.negative(np.add.reduce(self.above, axis=0, dtype=np.int16))
        self._edges(kind)
        return kind

    def name(self, kind: np.ndarray, learn: bool) -> None:
        """Say which classes come, in place of ``find``."""
        if learn:
            np.subtract(self.number, kind + np.int16(1), out=self.above)
            np.right_shift(self.above, 15, out=self.above)
        self._edges(kind)

    def _edges(self, kind: np.ndarray) -> None:
        np.multiply(kind, self.lanes, out=self.ic, dtype=np.int64)
        np.add(self.ic, self.lane, out=self.ic)
        self.edges.take(self.ic, out=self.lo, mode="clip")
        np.add(self.ic, self.lanes, out=self.ic)
        self.edges.take(self.ic, out=self.hi, mode="clip")

    def interval(self, hit2: np.ndarray, hit1: np.ndarray, literal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and widths of what comes, of 2^16."""
        rest, lo, hi = self.rest, self.u, self.p3
        np.multiply(self.lo, rest, out=lo)
        np.right_shift(lo, 15, out=lo)
        np.multiply(self.hi, rest, out=hi)
        np.right_shift(hi, 15, out=hi)
        np.subtract(hi, lo, out=hi)
        # Of a literal hi - lo from base + lo on; m1 from m2 on; m2 from 0 on.
        np.add(lo, self.m1, out=lo)
        np.multiply(lo, literal, out=lo)
        np.multiply(self.m2, ~hit2, out=self.p4)
        np.add(lo, self.p4, out=lo)
        np.multiply(hi, literal, out=hi)
        np.multiply(self.m2, hit2, out=self.p4)
        np.add(hi, self.p4, out=hi)
        np.multiply(self.m1, hit1, out=self.p4)
        np.add(hi, self.p4, out=hi)
        return lo, hi

    def learn(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, literal: np.ndarray, classes: bool) -> None:
        """Take in the ids x and, if ``classes``, the classes that were found or named."""
        v = self.u.view(np.int32)
        m2, p1 = self.m2.view(np.int32), self.p1.view(np.int32)
        np.multiply(hit2, _HIT - _MISS, out=v, dtype=np.int32)
        np.add(v, _MISS, out=v)
        np.subtract(v, m2, out=v)
        np.right_shift(v, _RATE, out=v)
        np.add(m2, v, out=m2)
        np.multiply(hit1, _HIT - _MISS, out=v, dtype=np.int32)
        np.add(v, _MISS, out=v)
        np.subtract(v, p1, out=v)
        np.right_shift(v, _RATE, out=v)
        np.multiply(v, self.differ & ~hit2, out=v)
        np.add(p1, v, out=p1)
        np.left_shift(self.m2, 16, out=self.m2)
        np.bitwise_or(self.m2, self.p1, out=self.m2)
        self.q[self.iq] = self.m2
        if classes:
            above, inner = self.above, self.inner
            np.bitwise_and(above, -self.far, out=above)
            np.add(above, self.goal, out=above)
            np.subtract(above, inner, out=above)
            np.right_shift(above, _CLASS_RATE, out=above)
            np.bitwise_and(above, -literal.astype(np.int16), out=above)
            np.add(inner, above, out=inner)
        fresh = (x << np.uint32(2)) | np.uint32(1)
        same, e = self.c == x, self.e
        # One that held is trusted more, up to 3; another one less, and at 1 it gives way.
        np.subtract(((self.s != 3) & same).view(np.int8), (~same).view(np.int8), out=self.step)
        np.add(e.view(np.int32), self.step, out=e.view(np.int32))
        self.table[self.k] = np.where(same | (self.s > 1), e, fresh)
        self.b = x


def _turns(n: int, block: int) -> tuple[int, list[tuple[range, int]]]:
    """The number of blocks, and the steps with the blocks that take part in them."""
    lanes = -(-n // block)
    last = n - (lanes - 1) * block
    return lanes, [(range(last), lanes)] + ([(range(last, block), lanes - 1)] if lanes > 1 and last < block else [])


def _class(ranks: np.ndarray) -> np.ndarray:
    return (ranks.astype(np.float64).view(np.int64) >> 52) - 1023  # the exponent


def _edges(counts: np.ndarray) -> np.ndarray:
    """Edges of the classes of ranks that come so many times; none is narrower than the gap."""
    classes = int(len(counts)).bit_length()
    n = np.bincount(_class(np.arange(1, len(counts) + 1)), counts, classes).astype(np.int64).cumsum()
    return np.append(0, np.arange(1, classes + 1) * _GAP + (_ONE - classes * _GAP) * n // n[-1])


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, most frequent first, how often they come, and for each id its place among them, from 1."""
    if int(ids.max()) < _DENSE:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        values = values[np.argsort(-counts[values], kind="stable")]
        rank = np.zeros(len(counts), np.uint32)
        rank[values] = np.arange(1, len(values) + 1, dtype=np.uint32)
        return values, counts[values], rank[ids]
    values, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
    return values[order], counts[order], rank[at.reshape(-1)]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The bytes of a segment; ``decode`` gives the ids back."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    if not n:
        return MAGIC + struct.pack("<5I", 0, block, 0, 0, 0)
    values, counts, ranks = _ranks(ids)
    edges = _edges(counts)
    classes = len(edges) - 1
    packed = zlib.compress(edges.astype("<u2").tobytes() + values.astype("<u4").tobytes(), 1)
    lanes, turns = _turns(n, block)
    grid = np.zeros(lanes * block, np.uint32)
    grid[:n] = ranks
    del ranks
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    model = _Model(lanes, edges)
    # An id takes a word of the coder and the plain bits of a class at most. Words may hold a carry until the end.
    width, room = block + 4, block * max(classes - 1, 0) // 32 + 2
    out, back = np.zeros(lanes * width, np.uint32), np.zeros(lanes * room, np.uint32)
    rows, backs = np.arange(lanes, dtype=np.int64) * width, np.arange(lanes, dtype=np.int64) * room
    pos, back_pos = rows.copy(), backs.copy()
    low, span = np.zeros(lanes), np.full(lanes, _FULL)
    held, bits, one = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64), np.uint64(1)

    for steps, m in turns:
        model.narrow(m)
        po, bp, lw, sp, hd, nb = pos[:m], back_pos[:m], low[:m], span[:m], held[:m], bits[:m]
        for t in steps:
            x = grid[t, :m]
            kind = _class(x).astype(np.int16)
            model.predict()
            hit2 = model.c2 == x
            hit1 = (model.c1 == x) & ~hit2
            literal = ~(hit2 | hit1)
            model.name(kind, t % _EVERY == 0)
            start, share = model.interval(hit2, hit1, literal)
            np.multiply(sp, 1 / 65_536, out=sp)
            np.floor(sp, out=sp)
            lw += sp * start
            np.multiply(sp, share, out=sp)
            small = sp < _LEAST
            top = np.floor(lw * (1 / _LEAST))
            out[po] = top
            po += small
            grow = small * 65_535.0 + 1
            lw -= top * (small * _LEAST)
            lw *= grow
            sp *= grow
            # Plain bits: those below the highest one of a rank.
            k = (kind * literal).astype(np.uint64)
            hd |= (x & ((one << k) - one)) << nb
            nb += k
            if t & 1 or classes > 17:
                back[bp] = hd
                full = nb >> np.uint64(5)
                bp += full.view(np.int64)
                full <<= np.uint64(5)
                hd >>= full
                nb -= full
            model.learn(x, hit2, hit1, literal, t % _EVERY == 0)
    whole = low.astype(np.int64)
    for shift, most in ((32, 0x1FFFF), (16, 0xFFFF), (0, 0xFFFF)):
        out[pos] = (whole >> shift) & most
        pos += 1
    carry = np.flatnonzero(out >> 16)
    while len(carry):
        out[carry] &= 0xFFFF
        carry -= 1
        out[carry] += 1
        carry = carry[out[carry] >> 16 > 0]
    for part in (0, 32):  # up to two words are held
        back[back_pos] = (held >> np.uint64(part)) & np.uint64(0xFFFFFFFF)
        back_pos += part == 0
    out, back = out.astype("<u2"), back.astype("<u4").view("<u2")
    back_pos = backs * 2 + (back_pos - 1 - backs) * 2 + (bits.astype(np.int64) + 15) // 16
    blocks = [out[a:b].tobytes() + back[c:d][::-1].tobytes() for a, b, c, d in zip(rows.tolist(), pos.tolist(), (2 * backs).tolist(), back_pos.tolist(), strict=True)]
    table = np.array([[len(b), zlib.crc32(b)] for b in blocks], "<u4").tobytes()
    return MAGIC + struct.pack("<5I", n, block, len(values), len(packed), zlib.crc32(packed)) + packed + table + b"".join(blocks)


def decode(data: bytes, skip_damaged: bool = False) -> np.ndarray:
    """The ids of a segment. A damaged block raises ValueError, or leaves zeros if ``skip_damaged``."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, block, size, packed, crc = struct.unpack_from("<5I", data, 4)
    if not n:
        return np.zeros(0, np.uint32)
    at = 24 + packed
    if zlib.crc32(data[24:at]) != crc:
        raise ValueError("the dictionary is damaged")
    classes = int(size).bit_length()
    unpacked = zlib.decompress(data[24:at])
    edges, values = np.frombuffer(unpacked, "<u2", classes + 1), np.frombuffer(unpacked, "<u4", size, 2 * (classes + 1))
    lanes, turns = _turns(n, block)
    table = np.frombuffer(data, "<u4", lanes * 2, at).reshape(lanes, 2).astype(np.int64)
    at += lanes * 8
    ends = at + np.cumsum(table[:, 0])
    parts = [data[e - w : e] for e, w in zip(ends.tolist(), table[:, 0].tolist(), strict=True)]
    bad = [i for i, p in enumerate(parts) if zlib.crc32(p) != table[i, 1]]
    if bad and not skip_damaged:
        raise ValueError(f"damaged blocks: {bad[:10]}")
    width = max(max(len(p) // 2 for p in parts), 3) + 4
    words, back = np.zeros((lanes, width), np.uint16), np.zeros((lanes, width), np.uint64)
    for i, p in enumerate(parts):
        if i not in bad:
            words[i, : len(p) // 2] = w = np.frombuffer(p, "<u2")
            back[i, : len(p) // 2] = w[::-1]
    # Four words from each place on, of which 49 bits are there from any bit of the first word on.
    for by in (1, 2):
        back[:, :-by] |= back[:, by:] << np.uint64(16 * by)
    words, back = words.reshape(-1), back.reshape(-1)
    pos = np.arange(lanes, dtype=np.int64) * width
    ahead = words[pos] * _LEAST + words[pos + 1] * 65_536.0 + words[pos + 2]
    span = np.full(lanes, _FULL)
    bit = pos << 4
    pos += 3
    grid = np.ones((block, lanes), np.uint32)
    model = _Model(lanes, edges)
    one = np.int64(1)

    for steps, m in turns:
        model.narrow(m)
        po, bp, ah, sp = pos[:m], bit[:m], ahead[:m], span[:m]
        for t in steps:
            model.predict()
            np.multiply(sp, 1 / 65_536, out=sp)
            np.floor(sp, out=sp)
            v = np.minimum(ah / sp, 65_535).astype(np.uint32)
            hit2 = v < model.m2
            literal = v >= model.base
            hit1 = ~(hit2 | literal)
            w = np.maximum(v, model.base) - model.base
            w <<= 15
            w |= 32_767
            w //= model.rest
            kind = model.find(w.astype(np.int16))
            start, share = model.interval(hit2, hit1, literal)
            ah -= sp * start
            np.multiply(sp, share, out=sp)
            small = sp < _LEAST
            grow = small * 65_535.0 + 1
            ah *= grow
            ah += words.take(po, mode="clip") * small
            sp *= grow
            po += small
            k = (kind * literal).astype(np.int64)
            top = one << k
            x = (back.take(bp >> 4, mode="clip").view(np.int64) >> (bp & 15)) & (top - 1)
            x |= top
            bp += k
            x = x.astype(np.uint32) * literal
            x += model.c2 * hit2
            x += model.c1 * hit1
            grid[t, :m] = x
            model.learn(x, hit2, hit1, literal, t % _EVERY == 0)
    del model, words, back
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    del grid
    for i in bad:
        ids[i * block : (i + 1) * block] = 1
    ids = np.append(0, values).astype(np.uint32).take(ids)
    for i in bad:
        ids[i * block : (i + 1) * block] = 0
    return ids

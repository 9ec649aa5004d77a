"""Adaptive context-mixing range coder for token ids, in numpy lanes.

A block of ids is cut into lanes of equal length that are coded side by side, one id of each lane a step; all lanes
share one model, which learns from every step before the next. The model predicts from the last two ids (order 2),
the last id (order 1) and nothing (order 0). Orders 2 and 1 each name a candidate id with a confidence; a logistic
mixer turns the hit rates at these confidences and the order-0 share of the candidate into its probability, with
weights that follow the error. Whatever probability the candidates leave is spread by the order-0 frequencies, so
that one interval codes one id. Each lane is an ordinary range coder (64-bit low and range, 32-bit words, carries
avoided by cutting the range at a word's border; a step ends with one word at most, and a lane with one word). All arithmetic is on integers, so that any machine decodes alike.

Lanes learn from each other one step late, so a block should have some hundred steps: 3072 lanes of 342 ids each beat the
order-0 entropy of their block. Candidates learn from every step; hit rates and weights from every one at first, then from each sixteenth.

A block is independent: its model starts anew, and its header holds the counts and a CRC-32 of the ids. Layout, little-endian:
magic "LTB3", u32 ids, u32 vocabulary, u32 lanes, u32 crc32, then u32 words of each lane, then the words, lane by lane.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC, HEAD = b"LTB3", struct.Struct("<4sIIIII")
LANES, LEAST_STEPS = 3072, 64
TOTAL, ZERO = 28, 20  # bits of an interval's scale, and of the order-0 scale
FLOOR = 1 << (TOTAL - 7)  # what candidates always leave to the others
WORD, BORDER = np.uint64(32), np.uint64(1 << 32)
SCALE, FULL, BELOW = np.uint64(TOTAL), np.uint64((1 << 64) - 1), np.uint64((1 << 32) - 1)
#: ln(p / (1 - p)) in 1/256 for p = (i + 0.5) / 4096, and its inverse on -2047..2047 in 1/65536
STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int64)
SQUASH = np.array([round(65536 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], np.int32)
SIZE1 = np.minimum(SQUASH << (TOTAL - 16), (1 << TOTAL) - 2 * FLOOR)  # an interval of that share
MOST = 1 << 19  # of a weight in 1/65536, so that products stay below 2**31
TABLE = 17
CLIP = "clip"  # of all lookups: what they look up is in range, or meant to be cut to it, and this is the quickest mode
EVERY, EARLY = 16, 32  # rates and weights learn from every step up to EARLY, then from each EVERY-th
#: What candidates say in all: agreement, and the confidences of orders 2 and 1, as one number; confidence 0 is an empty place.
SAYS = np.arange(512)
SURE2, SURE1 = SAYS >> 4 & 15, SAYS & 15
AGREE = (SAYS >> 8 == 1) & (SURE2 > 0) & (SURE1 > 0)
HAS2 = SURE2 > 0
SECOND = HAS2 & (SURE1 > 0) & ~AGREE
SET = HAS2 * 2 + AGREE
OF_SET = (np.arange(4)[:, None] == SET).astype(np.float64)
BY_SURE = np.concatenate([SURE2[:, None] == np.arange(16), SURE1[:, None] == np.arange(16)], 1).astype(np.float64)
#: The next confidence after a miss and, 16 places on, after a hit.
NEXT = np.array([1 if n < 2 else n >> 1 for n in range(16)] + [min(n + 1, 15) for n in range(16)], np.int32)


def _hash(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places in the table of order 2 for uint32 ids."""
    x = before * np.uint32(0x9E3779B1)
    x += last * np.uint32(0x85EBCA6B)
    x += last >> np.uint32(3)
    return (x >> np.uint32(32 - TABLE)).astype(np.intp)


class Mixer:
    """The shared model of a block; predict() and learn() alternate, with the same steps when coding and decoding.

    A candidate and its confidence lie in one number (id * 16 + confidence). All that is mixed but the order-0 share
    depends on what the candidates say (SAYS), so that the mixer works on 512 numbers and each lane looks its own up.
    """

    def __init__(self, vocabulary: int, slots: bool):
        self.v, self.slots = vocabulary, slots
        self.one, self.two = np.zeros(vocabulary + 1, np.int32), np.zeros(1 << TABLE, np.int32)
        self.hits, self.seen = np.ones((3, 16), np.int64), np.full((3, 16), 2, np.int64)
        self.weights = np.full((4, 3), 1 << 15, np.int64)
        self.counts, self.steps, self.next = np.zeros(vocabulary, np.int64), 0, 1
        self.rows: list[np.ndarray] = []
        self._zero()
        self._mix()

    def _zero(self) -> None:
        """Order-0 frequencies anew, each at least 1, summing to 2**ZERO, and (to decode) the id of every slot."""
        if self.rows:
            self.counts += np.bincount(np.concatenate(self.rows), minlength=self.v)
            self.rows = []
        room, total = (1 << ZERO) - self.v, int(self.counts.sum())
        freq = 1 + (self.counts * room // total if total else np.full(self.v, room // self.v, np.int64))
        freq[int(freq.argmax())] += (1 << ZERO) - int(freq.sum())
        self.freq = freq.astype(np.int32)
        self.start = (np.cumsum(freq) - freq).astype(np.int32)
        self.share = STRETCH[np.minimum(freq >> (ZERO - 12), 4095)].astype(np.int32)
        if self.slots:
            self.slot = np.repeat(np.arange(self.v, dtype=np.int32), freq)

    def _mix(self) -> None:
        rates = (self.hits * 4096 + 2048) // (self.seen + 1)
        self.s0 = np.where(HAS2, STRETCH[rates[0]][SURE2], 0)
        self.s1 = np.where(AGREE | ~HAS2, STRETCH[rates[1]][SURE1], STRETCH[40])
        w = self.weights[SET]
        self.base = ((w[:, 0] * self.s0 + w[:, 1] * self.s1) >> 16).astype(np.int32)
        self.weight = w[:, 2].astype(np.int32)
        self.rate = np.where(SECOND, rates[2][SURE1], 0).astype(np.int32)

    def predict(self, h: np.ndarray, last: np.ndarray) -> None:
        """h and last: each lane's place in the table of order 2, and its last id, as indices."""
        self.h, self.last = h, last
        e2, e1 = self.two.take(h, mode=CLIP), self.one.take(last, mode=CLIP)
        self.n2, self.n1, self.c2, self.c1 = e2 & 15, e1 & 15, e2 >> 4, e1 >> 4
        self.first = np.where(self.n2 > 0, self.c2, self.c1)
        says = self.n2 << 4
        says |= self.n1
        self.says = says = says.astype(np.intp)
        says += (self.c1 == self.c2) * 256
        self.s2 = self.share.take(self.first, mode=CLIP)
        x = self.weight.take(says, mode=CLIP)
        x *= self.s2
        x >>= 16
        x += self.base.take(says, mode=CLIP)
        x += 2047
        self.x = x
        self.size1 = SIZE1.take(x, mode=CLIP)
        self.size2 = (1 << TOTAL) - FLOOR - self.size1
        self.size2 >>= 12
        self.size2 *= self.rate.take(says, mode=CLIP)
        self.both = self.size1 + self.size2
        self.unit = (1 << TOTAL) - self.both
        self.unit >>= ZERO

    def interval(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of x (as indices: at), as uint64; what x hits is kept for learn()."""
        self.hit, self.hit1 = x == self.first, x == self.c1
        start = self.start.take(at, mode=CLIP)
        start *= self.unit
        start += self.both
        width = self.freq.take(at, mode=CLIP)
        width *= self.unit
        two = self.size2 > 0
        two &= self.hit1
        np.putmask(start, two, self.size1)
        np.putmask(width, two, self.size2)
        np.putmask(start, self.hit, 0)
        np.putmask(width, self.hit, self.size1)
        return start.astype(np.uint64), width.astype(np.uint64)

    def find(self, value: np.ndarray) -> np.ndarray:
        rest = value - self.both
        return np.where(value < self.size1, self.first, np.where(rest < 0, self.c1, self.slot.take(rest // self.unit, mode=CLIP)))

    def learn(self, x: np.ndarray) -> None:
        if self.steps < EARLY or self.steps % EVERY == 0:
            self._learn_rates()
        self.rows.append(x)
        x16 = x << 4
        for table, at, c, n, same in ((self.two, self.h, self.c2, self.n2, self.c2 == x), (self.one, self.last, self.c1, self.n1, self.hit1)):
            # an empty place holds id 0 with no confidence, which a hit and a miss turn into x alike
            keeps = same | (n > 1)
            table[at] = np.where(keeps, c << 4, x16) | NEXT.take(n + (same.view(np.int8) << 4), mode=CLIP)
        self.steps += 1
        if self.steps == self.next:
            self.next = self.steps * 2 if self.steps < 64 else self.steps + 64
            self._zero()

    def _learn_rates(self) -> None:
        says, hit = self.says, self.hit.astype(np.int32)
        err = (hit << 16) - SQUASH.take(self.x, mode=CLIP)
        # sums of whole numbers below 2**53, which floats hold exactly in any order
        miss, far = np.bincount(says, err, 512), np.bincount(says, err * self.s2, 512)
        hit += self.hit1.astype(np.int32) << 1
        hit <<= 9
        (none, only), (only1, both) = np.bincount(says + hit, minlength=2048).astype(np.float64).reshape(2, 2, 512)
        hit, hit1 = only + both, only1 + both
        seen = none + only + hit1
        many = np.maximum((OF_SET @ seen).astype(np.int64), 1) << 8
        self.weights += (OF_SET @ np.stack([miss * self.s0, miss * self.s1, far], 1)).astype(np.int64) // many[:, None]
        np.clip(self.weights, -MOST, MOST, out=self.weights)
        by = (np.stack([seen, hit, hit1, (seen - hit) * SECOND, hit1 * SECOND]) @ BY_SURE).astype(np.int64)
        self.seen += np.stack([by[0, :16], by[0, 16:], by[3, 16:]])
        self.hits += np.stack([by[1, :16], by[2, 16:], by[4, 16:]])
        self._mix()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


def _within(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranges below a word, cut where the word above changes."""
    cut = (low ^ (low + size - np.uint64(1))) >= BORDER
    return np.where(cut, BORDER - (low & BELOW), size)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block. ids are whole numbers from 0 and below vocabulary, which is at most 2**18."""
    ids = np.asarray(ids)
    n = len(ids)
    if n and not 0 <= ids.min() <= ids.max() < vocabulary <= 1 << (ZERO - 2):
        raise ValueError("ids out of range")
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    lanes, steps = _shape(n)
    if not n:
        return HEAD.pack(MAGIC, 0, vocabulary, 0, crc, 0)
    x = np.zeros(lanes * steps, np.int32)
    x[:n] = ids
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    model = Mixer(vocabulary, slots=False)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    whose, words = [], []
    last = before = np.full(lanes, vocabulary, np.int32)
    at = last.astype(np.intp)
    for row in x:
        model.predict(_hash(before.view(np.uint32), last.view(np.uint32)), at)
        at = row.astype(np.intp)
        start, width = model.interval(row, at)
        size >>= SCALE
        start *= size
        low += start
        size *= width
        m = np.flatnonzero(size < BORDER)
        a = low[m]
        whose.append(m.astype(np.uint16))
        words.append((a >> WORD).astype(np.uint32))
        low[m], size[m] = a << WORD, _within(a, size[m]) << WORD
        model.learn(row)
        before, last = last, row
    # a whole word lies in what is left of each lane
    whose.append(np.arange(lanes, dtype=np.uint16))
    words.append(((low + BELOW) >> WORD).astype(np.uint32))
    del x, model
    lane = np.concatenate(whose)
    whose.clear()
    lengths = np.bincount(lane, minlength=lanes).astype("<u4")
    order = np.argsort(lane, kind="stable")
    del lane
    word = np.concatenate(words)
    words.clear()
    return HEAD.pack(MAGIC, n, vocabulary, lanes, crc, steps) + lengths.tobytes() + word[order].astype("<u4").tobytes()


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; a block that is torn or altered raises ValueError."""
    if len(block) < HEAD.size or block[:4] != MAGIC:
        raise ValueError("not a block")
    _, n, vocabulary, lanes, crc, steps = HEAD.unpack_from(block)
    if not n:
        return np.zeros(0, np.int64)
    lengths = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    word = np.frombuffer(block, "<u4", -1, HEAD.size + 4 * lanes)
    if lengths.sum() != len(word):
        raise ValueError("torn block")
    # each lane's words, and a zero for the half of the state that its last word leaves open
    wide = np.zeros(len(word) + 2 * lanes + 2, np.uint64)
    wide[np.arange(len(word)) + np.repeat(2 * np.arange(lanes), lengths)] = word
    at = np.cumsum(lengths + 2) - lengths - 2
    code = wide[at] << WORD | wide[at + 1]
    at += 2
    out = np.empty((steps, lanes), np.int32)
    model = Mixer(vocabulary, slots=True)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    end = len(wide) - 1
    last = before = np.full(lanes, vocabulary, np.int32)
    index = last.astype(np.intp)
    for k in range(steps):
        model.predict(_hash(before.view(np.uint32), last.view(np.uint32)), index)
        size >>= SCALE
        value = np.minimum((code - low) // size, np.uint64((1 << TOTAL) - 1)).astype(np.int32)
        out[k] = x = model.find(value)
        index = x.astype(np.intp)
        start, width = model.interval(x, index)
        start *= size
        low += start
        size *= width
        m = np.flatnonzero(size < BORDER)
        a, t = low[m], at[m]
        code[m] = code[m] << WORD | wide[np.minimum(t, end)]
        at[m] = t + 1
        low[m], size[m] = a << WORD, _within(a, size[m]) << WORD
        model.learn(x)
        before, last = last, x
    ids = out.T.ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block differs")
    return ids

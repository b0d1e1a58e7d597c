"""Adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes of equal length that are coded in lockstep by numpy, one
id of each lane a step, under one shared model that starts afresh with the block.
For each id the model has a candidate from the two ids before (order 2), one from
the id before (order 1), and adaptive frequencies of all ids (order 0). Counters of
past success for the candidates, their agreement and the order-0 frequency of the
order-2 candidate form a small state; for every state a logistic mixture of the
orders' predictions, with weights that adapt, gives the share of the candidates.
The range coder spends one step on an id: on the order-2 candidate's interval, the
order-1 candidate's, or the order-0 interval in the rest.

All arithmetic is on integers, so that decoding repeats it exactly on any machine.
Both the coded bytes and the ids of a block carry a crc32, and each block decodes
without any other.

Block: header of HEADER (ids, lanes, vocabulary, crc32 of ids as little-endian
unsigned 32-bit integers, crc32 of the payload, payload bytes), then the payload:
16-bit words of each lane as unsigned 32-bit counts, then the words of the lanes.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

HEADER = struct.Struct("<4sIIIIII")
MAGIC = b"CMR1"
#: Ids of a block at most, and of a lane at least where there are several.
BLOCK_IDS, LANE_IDS, MAX_LANES = 1 << 21, 128, 8192
TOTAL_BITS, RARE_BITS = 24, 20
CONTEXT_BITS = 18
RUN_BITS, LEVELS = 4, 8
RUNS = 1 << RUN_BITS
STATES = RUNS * RUNS * 2 * LEVELS
REFRESH = 16

_TOTAL, _HALF, _WORD = np.uint64(TOTAL_BITS), np.uint64(32), np.uint64(16)
_MASK32, _MASK16, _LEAST = np.uint64(0xFFFFFFFF), np.uint64(0xFFFF), np.uint64(1 << 32)

_ONE = 1 << 16
_STRETCH = np.array([round(256 * math.log((k + 0.5) / (4096 - k - 0.5))) for k in range(4096)], dtype=np.int64)
_SQUASH = np.array([round(_ONE / (1 + math.exp(-k / 256))) for k in range(-2304, 2305)], dtype=np.int64)


def _stretch(p: np.ndarray) -> np.ndarray:
    return _STRETCH[np.clip(p >> 4, 0, 4095)]


class _Flag:
    """Mixed probability, for each state, that a candidate is right."""

    def __init__(self, groups: list[np.ndarray], sets: np.ndarray) -> None:
        self.groups, self.sets = groups, sets
        self.tables = [np.full(int(g.max()) + 1, _ONE // 4, dtype=np.int64) for g in groups]
        self.weights = np.full((int(sets.max()) + 1, len(groups)), _ONE // 2, dtype=np.int64)
        self.mix()

    def mix(self) -> None:
        self.inputs = [_stretch(t)[g] for t, g in zip(self.tables, self.groups, strict=True)]
        w = self.weights[self.sets]
        z = sum(w[:, k] * x for k, x in enumerate(self.inputs)) >> 16
        self.p = _SQUASH[np.clip(z, -2304, 2304) + 2304]

    def learn(self, seen: np.ndarray, right: np.ndarray) -> None:
        """seen, right: how often each state occurred, and was right, since the last call."""
        for t, g in zip(self.tables, self.groups, strict=True):
            n = np.bincount(g, weights=seen, minlength=len(t)).astype(np.int64)
            h = np.bincount(g, weights=right, minlength=len(t)).astype(np.int64)
            t += ((h << 16) - n * t) // (n + 24)
            np.clip(t, 64, _ONE - 64, out=t)
        error = (right << 16) - seen * self.p
        for k, x in enumerate(self.inputs):
            total = np.zeros(len(self.weights), dtype=np.int64)
            np.add.at(total, self.sets, (error * x) >> 12)
            count = np.bincount(self.sets, weights=seen, minlength=len(self.weights)).astype(np.int64)
            self.weights[:, k] += total // (count * 2 + 64)
        np.clip(self.weights, 0, 2 * _ONE, out=self.weights)
        self.mix()


_STATE = np.arange(STATES)
_RUN2, _RUN1 = _STATE // (RUNS * 2 * LEVELS), _STATE // (2 * LEVELS) % RUNS
_SAME, _LEVEL = _STATE // LEVELS % 2, _STATE % LEVELS


class _Model:
    def __init__(self, vocabulary: int, lanes: int) -> None:
        self.vocabulary, self.step, self.pending = vocabulary, 0, []
        self.counts = np.ones(vocabulary, dtype=np.int64)
        # Candidate and counter of each context in one number: candidate * RUNS + counter.
        self.order1, self.order2 = np.zeros(vocabulary, dtype=np.int64), np.zeros(1 << CONTEXT_BITS, dtype=np.int64)
        self.last, self.before = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.flag2 = _Flag([_STATE, _RUN2, _RUN1 * 2 + _SAME, _LEVEL], _SAME)
        self.flag1 = _Flag([_STATE, _RUN1, _RUN2, _LEVEL], _SAME)
        self.outcomes: list[np.ndarray] = []  # of each id its state, and whether order 2 (2), order 1 (1) or neither was right
        self.refresh()

    def refresh(self) -> None:
        """Order-0 frequencies from the counts so far, on a scale of 2**RARE_BITS."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.vocabulary) * 32
            self.pending = []
        total, room = int(self.counts.sum()), (1 << RARE_BITS) - self.vocabulary
        freq = 1 + self.counts * room // total
        freq[int(np.argmax(freq))] += (1 << RARE_BITS) - int(freq.sum())
        self.cum, self.lookup = np.concatenate(([0], np.cumsum(freq))), None
        self.freq = freq
        self.level = np.clip(np.frexp(freq.astype(np.float64))[1] // 2 - 1, 0, LEVELS - 1)

    def ids_at(self, point: np.ndarray) -> np.ndarray:
        """The id whose order-0 interval holds each point; the encoder needs no table for it."""
        if self.lookup is None:
            self.lookup = np.repeat(np.arange(self.vocabulary), self.freq)
        return self.lookup[point]

    def predict(self) -> None:
        self.context = ((self.last * 0x9E3779B1 + self.before * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - CONTEXT_BITS)
        self.v2, self.v1 = self.order2[self.context], self.order1[self.last]
        self.c2, self.c1 = self.v2 >> RUN_BITS, self.v1 >> RUN_BITS
        same = self.c1 == self.c2
        self.state = ((self.v2 & RUNS - 1) << RUN_BITS | self.v1 & RUNS - 1) * (2 * LEVELS) + same * LEVELS + self.level[self.c2]
        # The candidates share at most 15/16 of the range; the rest holds all order-0 intervals.
        self.a = 1 + (self.flag2.p[self.state] * 900 >> 16 << 14)
        self.b = np.where(same, 0, 1 + ((((1 << 10) - 64 << 14) - self.a) * self.flag1.p[self.state] >> 16))

    def update(self, ids: np.ndarray) -> None:
        hit2, hit1 = ids == self.c2, ids == self.c1
        for table, at, value, hit in ((self.order2, self.context, self.v2, hit2), (self.order1, self.last, self.v1, hit1)):
            length = value & RUNS - 1
            keep = value - length
            missed = np.where(length > 1, keep, ids << RUN_BITS) + (length >> 1)
            table[at] = np.where(hit, keep + np.minimum(length + 1, RUNS - 1), missed)
        self.outcomes.append(self.state * 3 + np.where(hit2, 2, hit1))
        self.pending.append(ids)
        self.before, self.last = self.last, ids
        self.step += 1
        if self.step % REFRESH == 0 or self.step in (1, 2, 4, 8):
            n = np.bincount(np.concatenate(self.outcomes), minlength=3 * STATES).reshape(STATES, 3)
            self.flag2.learn(n.sum(axis=1), n[:, 2])
            self.flag1.learn(n[:, 0] + n[:, 1], n[:, 1])
            self.outcomes = []
            self.refresh()


def lanes_of(n: int) -> int:
    return max(1, min(MAX_LANES, n // LANE_IDS))


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of ids below vocabulary; at most BLOCK_IDS are meant to share one."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
        raise ValueError("an id is outside the vocabulary")
    lanes = lanes_of(len(ids))
    steps = -(-len(ids) // lanes)
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocabulary, lanes)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 1 << 48, dtype=np.uint64)
    # A step gives at most two words a lane, and three hold what is left of low.
    words, counts = np.zeros((2 * steps + 3, lanes), dtype=np.uint32), np.zeros(lanes, dtype=np.intp)
    for t in range(steps):
        now = grid[t]
        model.predict()
        ab = model.a + model.b
        rest = (1 << TOTAL_BITS) - ab
        start = ab + (model.cum[now] * rest >> RARE_BITS)
        size = ab + (model.cum[now + 1] * rest >> RARE_BITS) - start
        hit2 = now == model.c2
        hit1 = (now == model.c1) & ~hit2
        start = np.where(hit2, 0, np.where(hit1, model.a, start)).astype(np.uint64)
        size = np.where(hit2, model.a, np.where(hit1, model.b, size)).astype(np.uint64)
        unit = width >> _TOTAL
        low += unit * start
        width = unit * size
        for _ in range(2):
            short = np.flatnonzero(width < _LEAST)
            if not len(short):
                break
            # 17 bits: a carry waits in its word until the lane is complete.
            part = low[short]
            words[counts[short], short] = part >> _HALF
            counts[short] += 1
            low[short] = (part & _MASK32) << _WORD
            width[short] <<= _WORD
        model.update(now)
    every = np.arange(lanes)
    for k, part in enumerate((low >> _HALF, low >> _WORD & _MASK16, low & _MASK16)):
        words[counts + k, every] = part
    counts += 3
    lane_words = words[: int(counts.max())]
    for k in range(len(lane_words) - 1, 0, -1):
        lane_words[k - 1] += lane_words[k] >> np.uint32(16)
        lane_words[k] &= np.uint32(0xFFFF)
    kept = np.arange(len(lane_words))[None, :] < counts[:, None]
    payload = counts.astype("<u4").tobytes() + lane_words.T[kept].astype("<u2").tobytes()
    head = HEADER.pack(MAGIC, len(ids), lanes, vocabulary, zlib.crc32(ids.astype("<u4")), zlib.crc32(payload), len(payload))
    return head + payload


def decode_block(data: bytes | memoryview) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers; ValueError if a checksum is wrong."""
    magic, n, lanes, vocabulary, ids_crc, crc, size = HEADER.unpack_from(data)
    payload = memoryview(data)[HEADER.size : HEADER.size + size]
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != crc:
        raise ValueError("a block is damaged")
    counts = np.frombuffer(payload, dtype="<u4", count=lanes).astype(np.int64)
    words = np.concatenate((np.frombuffer(payload, dtype="<u2", offset=4 * lanes).astype(np.uint64), np.zeros(1, dtype=np.uint64)))
    at = np.cumsum(counts) - counts
    code = words[at] << _HALF | words[at + 1] << _WORD | words[at + 2]
    at += 3
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), dtype=np.int64)
    model = _Model(vocabulary, lanes)
    width = np.full(lanes, 1 << 48, dtype=np.uint64)
    for t in range(steps):
        model.predict()
        unit = width >> _TOTAL
        value = np.minimum(code // unit, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
        ab = model.a + model.b
        rest = (1 << TOTAL_BITS) - ab
        hit2 = value < model.a
        hit1 = (value < ab) & ~hit2
        point = np.clip((((value - ab + 1) << RARE_BITS) - 1) // rest, 0, (1 << RARE_BITS) - 1)
        now = np.where(hit2, model.c2, np.where(hit1, model.c1, model.ids_at(point)))
        start = ab + (model.cum[now] * rest >> RARE_BITS)
        size = ab + (model.cum[now + 1] * rest >> RARE_BITS) - start
        start = np.where(hit2, 0, np.where(hit1, model.a, start)).astype(np.uint64)
        size = np.where(hit2, model.a, np.where(hit1, model.b, size)).astype(np.uint64)
        code -= unit * start
        width = unit * size
        for _ in range(2):
            short = np.flatnonzero(width < _LEAST)
            if not len(short):
                break
            code[short] = code[short] << _WORD | words[np.minimum(at[short], len(words) - 1)]
            width[short] <<= _WORD
            at[short] += 1
        grid[t] = now
        model.update(now)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids) != ids_crc:
        raise ValueError("the ids of a block do not match their checksum")
    return ids

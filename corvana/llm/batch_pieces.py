"""Pre-tokens of many texts at once: cut, hashed and looked up in numpy.

The pattern of byte-level BPE cuts a text into runs of letters, of numbers and of
other characters, each with the space before it, into white space, and into
contractions after letters or numbers. Runs follow from the class of each character
alone, so all texts of a batch are cut in one pass over their code points. Each
pre-token has a 128-bit hash from two prefix sums; an open-addressing table keeps the
ids of those that a worker has met, and only new ones are encoded by the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import regex

from corvana.llm.common import mix64

# Fixed value: the pattern that this module cuts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters of a pass, and what a worker's table holds before it starts afresh.
PASS_CHARS, MAX_ENTRIES, MAX_IDS = 1 << 18, 800_000, 1 << 22
_SLOTS = 1 << 21

_R1, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            for a, b in _code_ranges(m.start(), m.end()):
                table[a:b] = kind
    return table


def _code_ranges(a: int, b: int) -> list[tuple[int, int]]:
    """Offsets in the string without surrogates, as ranges of code points."""
    gap, size = 0xD800, 0x800
    return [(x, y) for x, y in ((min(a, gap), min(b, gap)), (max(a, gap) + size, max(b, gap) + size)) if x < y]


def _powers(root: int) -> tuple[np.ndarray, np.ndarray]:
    """root and its inverse to the powers 0, 1, ... modulo 2**64."""

    def powers(x: int) -> np.ndarray:
        out = np.full(PASS_CHARS + 1, x, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return powers(root), powers(pow(root, -1, 1 << 64))


def boundaries(points: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of texts that begin at `starts`."""
    n = len(points)
    kind = kinds[points]
    first = np.zeros(n + 1, dtype=bool)  # texts begin
    first[starts] = True
    first[n] = True
    begin = np.empty(n, dtype=bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= first[:n]
    # A space right before a run of its text belongs to it.
    run = np.flatnonzero(begin & (kind != SPACE) & ~first[:n])
    after_space = kind[run - 1] == SPACE
    last = run[after_space] - 1
    joined = points[last] == 32
    begin[last[joined] + 1] = False
    begin[last] = True  # either with its run, or alone as the rest of longer white space
    # Contractions: a lone apostrophe that begins a pre-token, and letters after it.
    mark = np.flatnonzero(begin & (points == 39))
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        c1 = points[mark + 1]
        c2 = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        size = np.where(np.isin(c1, (115, 116, 109, 100)), 1, 0)
        size[((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)] = 2
        mark, size = mark[size > 0], size[size > 0]
        begin[mark + 1] = False
        end = mark + 1 + size
        begin[end[end < n]] = True
    return np.flatnonzero(begin)


class BatchEncoder:
    """Ids of whole texts; encode gives those of each of a list of pre-tokens."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]]) -> None:
        self.encode, self.kinds = encode, _classes()
        self.up1, self.down1 = _powers(_R1)
        self.up2, self.down2 = _powers(_R2)
        with np.errstate(over="ignore"):
            self.mixed = mix64(np.arange(1, 0x10001, dtype=np.uint64) * np.uint64(_R1))
        self.reset()

    def reset(self) -> None:
        self.slots, self.keys = np.full(_SLOTS, -1, dtype=np.int32), np.zeros(_SLOTS, dtype=np.uint64)
        self.second, self.offset, self.size = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.ids, self.entries, self.used = np.zeros(1 << 18, dtype=np.uint32), 0, 0

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Entry of each pre-token, -1 for those not met yet."""
        out = np.full(len(h1), -1, dtype=np.int32)
        open_, at = np.arange(len(h1)), (h1 & np.uint64(_SLOTS - 1)).astype(np.intp)
        while len(open_):
            entry = self.slots[at]
            taken = entry >= 0
            hit = taken & (self.keys[at] == h1[open_])
            hit[hit] = self.second[entry[hit]] == h2[open_[hit]]
            out[open_[hit]] = entry[hit]
            on = taken & ~hit
            open_, at = open_[on], (at[on] + 1) & (_SLOTS - 1)
        return out

    def _add(self, h1: np.ndarray, h2: np.ndarray, found: Sequence[Sequence[int]]) -> None:
        """Keep the ids of pre-tokens whose first hashes differ."""
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total, k = int(sizes.sum()), self.entries
        while k + len(found) > len(self.second):
            self.second, self.offset, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.second, self.offset, self.size))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=total)
        entry = np.arange(k, k + len(found), dtype=np.int32)
        self.second[entry], self.size[entry] = h2, sizes
        self.offset[entry] = self.used + np.cumsum(sizes) - sizes
        self.used, self.entries = self.used + total, k + len(found)
        at = (h1 & np.uint64(_SLOTS - 1)).astype(np.intp)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]  # of several the last stays
            won = free & (self.slots[at] == entry)
            self.keys[at[won]] = h1[won]
            h1, entry, at = h1[~won], entry[~won], (at[~won] + 1) & (_SLOTS - 1)

    def _pass(self, texts: list[str]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts], dtype=np.intp)
        starts = np.cumsum(sizes) - sizes
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        if self.entries > MAX_ENTRIES or self.used > MAX_IDS:
            self.reset()
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = boundaries(points, starts[sizes > 0], self.kinds)
        end = np.append(begin[1:], len(points))
        n = len(points)
        with np.errstate(over="ignore"):
            value = self.mixed[np.minimum(points, 0xFFFF)]
            high = np.flatnonzero(points >= 0xFFFF)
            value[high] = mix64(points[high].astype(np.uint64) * np.uint64(_R2))
            sums = np.empty(n + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(value * self.up1[:n], out=sums[1:])
            h1 = mix64((sums[end] - sums[begin]) * self.down1[begin])
            np.cumsum(value * self.up2[:n], out=sums[1:])
            h2 = (sums[end] - sums[begin]) * self.down2[begin] + (end - begin).astype(np.uint64)
        entry = self._find(h1, h2)
        while len(new := np.flatnonzero(entry < 0)):
            _, pick = np.unique(h1[new], return_index=True)
            pick = new[pick]
            self._add(h1[pick], h2[pick], self.encode([whole[a:b] for a, b in zip(begin[pick].tolist(), end[pick].tolist(), strict=True)]))
            entry[new] = self._find(h1[new], h2[new])
        count = self.size[entry].astype(np.intp)
        close = np.cumsum(count)
        where = np.repeat(self.offset[entry] - (close - count), count) + np.arange(close[-1])
        data = self.ids[where].astype("<u4").tobytes()
        # Texts end where the last of their pre-tokens does.
        upto = np.concatenate(([0], close))[np.searchsorted(begin, starts + sizes)] * 4
        return [data[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def encode_many(self, texts: list[str | None], one: Callable[[str], bytes]) -> list[bytes]:
        """Ids of each text; one encodes a text that is longer than a pass may be."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if held and size + len(t) > PASS_CHARS:
                out += self._pass(held)
                held, size = [], 0
            if len(t) > PASS_CHARS:
                out.append(one(t))
            else:
                held.append(t)
                size += len(t)
        return out + (self._pass(held) if held else [])

"""N-gram Jaccard join as a blocked product of the document by n-gram incidence matrix.

A document's row of the matrix is its set of word n-grams, hashed to 64 bits. Two
rows link when the Jaccard similarity of their sets is MIN_SHARE hundredths or more.
Equal sets are one row. The product of the matrix with its transpose is not formed
as a whole; what of it can hold a link is bounded three times by the sizes of sets:

1. Columns: of a set of n, a partner must have ceil(0.85 n), so the n - ceil(0.85 n) + 1
   n-grams that come first in any fixed order hold a common one. Documents meet by these
   columns alone. The order puts n-grams last that repeat much within parts of the corpus,
   and before them those of common words (tables of hashed counts whose sizes are bounded),
   so that common passages, lines and phrases make no large meeting, and few rows meet by chance.
2. Sizes and cells: an n-gram falls into one of about n / 4 cells; the overlap of two sets
   is at most the sum of their cells' smaller counts. Pairs whose bound is below the overlap
   that their sizes ask for are discarded before their texts travel.
3. Blocks: what is left is multiplied in blocks bounded in rows and n-grams. A row passes by
   a block's inverted columns and accumulates its overlap with every row of the block; exact
   overlaps decide. Columns and blocks of the very same documents go through once.

Of a column's documents the smallest meets all others first. Once components are known,
only documents outside a column's largest component are held against those of other
components, in blocks: a group of copies costs a pass, not its pairs. No pair is dropped:
rows that meet in no block are linked already, or share no column, and so are below the
threshold.

Defined cases: a null or empty text, or one of white space alone, has an empty set and no
link; a text of fewer than four words is one n-gram of all its words; a null id is left
out; repeated rows of an id count once (by the text that is greatest).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.llm.common import lean, materialise, mix64, window_hashes
from corvana.llm.prob_minhash import components, merged

WORDS, MIN_SHARE = 4, 85
#: N-grams whose repetitions are counted together in a task, and how often one, or a word, must be there to count.
PART, REPEATED, COMMON = 1 << 21, 3, 8
#: Bits of the table of n-grams: one cell for each 64, between these bounds; bits of the table of words.
LEAST_BITS, MOST_BITS, WORD_BITS = 12, 22, 20
#: N-grams of a cell on the average, and cells at most.
PER_CELL, MOST_CELLS = 4, 1 << 13
#: A block: rows that are held with their n-grams, and rows that pass by.
BLOCK_ROWS, BLOCK_NGRAMS, PASSING_ROWS = 512, 1 << 19, 1024
#: Rows of blocks that leave a task in one batch.
SIFTED_ROWS = 1 << 13
#: Matching n-grams that one numpy pass counts; bytes of text that one pass cuts.
MATCHES, CUT_BYTES = 1 << 20, 1 << 20
#: Pairs of a task: by cells, and by texts.
TASK_PAIRS, TASK_TEXTS = 50_000, 4_000

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte, capital letters as small ones.
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE[65:91] = _VALUE[97:123]
#: The base of the polynomial that hashes a word, its powers as far as a cut reaches.
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(255, np.uint64(0xD1342543DE82EF95))))


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, _POWERS[1])))


def word_hashes(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of UTF-8 bytes, where the words begin); no word goes on across a place in `begins`."""
    inside = ~_SEPARATOR[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = begins[begins < len(raw)]
    start[begins] = inside[begins]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at
    own = np.flatnonzero(inside)
    size = np.diff(np.append(np.searchsorted(own, at), len(own)))  # bytes of each word
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    terms = _VALUE[raw[own]] * _powers(int(size.max()))[place]
    return mix64(np.add.reduceat(terms, np.cumsum(size) - size)), at


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of about CUT_BYTES, cut at separators."""
    a = 0
    while len(raw) - a > CUT_BYTES:
        cut = np.flatnonzero(_SEPARATOR[raw[a : a + CUT_BYTES]])
        if len(cut):
            b = a + int(cut[-1]) + 1
        else:  # one word is longer
            b, step = a + CUT_BYTES, np.empty(0, dtype=np.int64)
            while b < len(raw) and not len(step):
                step = np.flatnonzero(_SEPARATOR[raw[b : b + CUT_BYTES]])
                b += int(step[0]) + 1 if len(step) else min(CUT_BYTES, len(raw) - b)
        yield raw[a:b]
        a = b
    yield raw[a:]


def _set(words: np.ndarray) -> np.ndarray:
    grams = window_hashes(words, min(WORDS, len(words))) if len(words) else words
    grams.sort()
    new = np.ones(len(grams), dtype=bool)
    np.not_equal(grams[1:], grams[:-1], out=new[1:])
    return grams[new]


def word_lists(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text in order; texts: a string array, null as empty."""
    if not len(texts):
        return
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CUT_BYTES, side="right")) - 1)
        low, raw = offsets[a], whole[offsets[a] : offsets[b]]
        if b == a + 1:
            yield np.concatenate([word_hashes(piece, np.zeros(1, dtype=np.int64))[0] for piece in _pieces(raw)])
        else:
            hashes, at = word_hashes(raw, offsets[a:b] - low)
            cuts = np.searchsorted(at, offsets[a : b + 1] - low)
            for k in range(b - a):
                yield hashes[cuts[k] : cuts[k + 1]]
        a = b


def ngram_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    return map(_set, word_lists(texts))


def _strings(column: pa.Array) -> pa.Array:
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of a table of 2^bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _repeated(held: list[np.ndarray], least: int, bits: int, kind: int) -> pa.RecordBatch:
    """Rows (null id, times, cell, kind) of hashes that are there `least` times or more."""
    every = np.sort(np.concatenate(held)) if held else np.empty(0, dtype=np.uint64)
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, dtype=np.int64)
    times = np.diff(np.append(at, len(every)))
    many = times >= least
    cells, inverse = np.unique(_cell(every[at[many]], bits), return_inverse=True)
    most = np.zeros(len(cells), dtype=np.int64)
    np.maximum.at(most, inverse, times[many])
    return pa.RecordBatch.from_arrays([pa.nulls(len(cells), pa.int64()), pa.array(most), pa.array(cells), pa.array(np.full(len(cells), kind))], ["id", "n", "h1", "h2"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (id, n, digest of its set), and those of the n-grams (kind 0) and words (1) that repeat in a part."""
    grams_held, words_held, size, seen = [], [], 0, set()
    for batch in batches:
        sizes, high, low = [], [], []
        for words in word_lists(_strings(batch.column(1))):
            grams = _set(words)
            digest = xxhash.xxh3_128_intdigest(grams.tobytes())
            sizes.append(len(grams))
            high.append((digest >> 64) - (1 << 63))
            low.append((digest & (1 << 64) - 1) - (1 << 63))
            if digest not in seen:
                seen.add(digest)
                grams_held.append(grams)
                words_held.append(words)
                size += len(words)
                if size >= PART:
                    yield _repeated(grams_held, REPEATED, MOST_BITS, 0)
                    yield _repeated(words_held, COMMON, WORD_BITS, 1)
                    grams_held, words_held, size, seen = [], [], 0, set()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["id", "n", "h1", "h2"])
    yield _repeated(grams_held, REPEATED, MOST_BITS, 0)
    yield _repeated(words_held, COMMON, WORD_BITS, 1)


def level_table(cells: DataFrame, held_bits: int, bits: int) -> np.ndarray:
    """Four times the logarithm of the greatest number in each of 2^bits cells: 2^bits bytes; cells: cell of held_bits, times."""
    folded = cells.groupBy(F.shiftright("cell", held_bits - bits).alias("cell")).agg(F.max("times").alias("times"))
    levels = np.zeros(1 << bits, dtype=np.uint8)
    for batch in folded.select("cell", F.floor(4 * F.log2("times")).cast("long").alias("level")).toArrow().to_batches():
        levels[batch["cell"].to_numpy()] = np.minimum(batch["level"].to_numpy(), 255)
    return levels


def place_in_order(words: np.ndarray, gram_levels: np.ndarray, word_levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct n-grams of a text, ascending, their places in the order of columns); equal places are told apart by the hash."""
    grams = window_hashes(words, min(WORDS, len(words))) if len(words) else words
    grams, at = np.unique(grams, return_index=True)
    if not len(grams):
        return grams, np.empty(0, dtype=np.int64)
    common = np.cumsum(np.append(0, word_levels[_cell(words, WORD_BITS)].astype(np.int64)))
    width = min(WORDS, len(words))
    sums = common[width:] - common[:-width]
    return grams, gram_levels[_cell(grams, len(gram_levels).bit_length() - 1)].astype(np.int64) * (WORDS << 8) + sums[at]


def least_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Common n-grams that sets of these sizes have at least, if they link."""
    return -(-MIN_SHARE * (a + b) // (100 + MIN_SHARE))


def cell_counts(grams: np.ndarray) -> np.ndarray:
    """N-grams in each of a power of two of cells, about PER_CELL in one; a text is too short for 65536 in a cell."""
    cells = min(MOST_CELLS, 1 << max(0, (len(grams) // PER_CELL).bit_length()))
    return np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The overlap is at most this; the larger vector of cells is folded to the smaller."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0)).sum())


def _sketcher(tables: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n, first columns, cells) of sets."""
        for batch in batches:
            sizes, firsts, cells = [], [], []
            for words in word_lists(_strings(batch.column(1))):
                grams, place = place_in_order(words, *tables.value)
                n = len(grams)
                first = n - -(-MIN_SHARE * n // 100) + 1 if n else 0
                sizes.append(n)
                firsts.append(grams[np.argsort(place, kind="stable")[:first]].view(np.int64))
                cells.append(cell_counts(grams).astype(np.uint16).tobytes())
            ends = np.cumsum([0, *map(len, firsts)])
            columns = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts) if firsts else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), columns, pa.array(cells, pa.binary())], ["id", "n", "firsts", "cells"])

    sketch.__module__ = __name__
    return sketch


def _cells(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint16).astype(np.int64)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, na, nb, ca, cb) those whose bound reaches the overlap that they need."""
    for batch in batches:
        keep = [overlap_bound(_cells(ca), _cells(cb)) >= least_overlap(na, nb) for na, nb, ca, cb in zip(*(batch.column(n).to_pylist() for n in ("na", "nb", "ca", "cb")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")], ["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with texts (a, b, ta, tb), rows of one a together, those that link."""
    last: tuple = (None, None)
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep, mine = [], _strings(batch.column(2))
        for k, theirs in enumerate(ngram_sets(_strings(batch.column(3)))):
            if last[0] != a[k]:
                last = a[k], next(ngram_sets(mine.slice(k, 1)))
            common = len(np.intersect1d(last[1], theirs, assume_unique=True))
            keep.append(common >= least_overlap(len(last[1]), len(theirs)))
        at = [k for k, x in enumerate(keep) if x]
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in at], pa.int64()), pa.array([b[k] for k in at], pa.int64())], ["a", "b"])


class _Block:
    """Rows of the incidence matrix that are held, as inverted columns, while others pass by."""

    def __init__(self, key: tuple) -> None:
        self.key, self.batches, self.rows = key, [], 0

    def settle(self) -> None:
        if self.rows or not self.batches:
            return
        whole = pa.Table.from_batches(self.batches).combine_chunks()
        self.batches, self.rows = [], whole.num_rows
        self.id, self.label = whole["id"].to_pylist(), whole["label"].to_pylist()
        self.n, self.table, self.columns = whole["n"].to_numpy(), whole, None
        if "cells" not in whole.column_names:
            return
        self.cells = [_cells(c) for c in whole["cells"].to_pylist()]
        few = min(map(len, self.cells))
        self.coarse = np.array([c.reshape(-1, few).sum(axis=0) for c in self.cells])

    def invert(self) -> None:
        sets = list(ngram_sets(_strings(self.table["text"].combine_chunks())))
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.columns, self.owner = every[order], np.repeat(np.arange(self.rows), [len(s) for s in sets])[order]

    def product(self, grams: np.ndarray) -> np.ndarray:
        """Overlap of a row that passes by with each row of the block, accumulated over its columns."""
        if self.columns is None:
            self.invert()
        low, high = np.searchsorted(self.columns, grams, "left"), np.searchsorted(self.columns, grams, "right")
        n = high - low
        low, n = low[n > 0], n[n > 0]
        out, ends, a = np.zeros(self.rows, dtype=np.int64), np.cumsum(n), 0
        while a < len(n):
            done = ends[a] - n[a]
            b = max(a + 1, int(np.searchsorted(ends, done + MATCHES, "right")))
            part = n[a:b]
            at = np.repeat(low[a:b] - (ends[a:b] - part - done), part) + np.arange(ends[b - 1] - done)
            out += np.bincount(self.owner[at], minlength=self.rows)
            a = b
        return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(block, whether its rows are held, rows): rows of a block follow one another, those that are held first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "c", "m", "holds")]
        new = np.zeros(batch.num_rows, dtype=bool)
        for x in parts:
            new[1:] |= x[1:] != x[:-1]
        at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            yield (int(parts[0][a]), int(parts[1][a]), int(parts[2][a])), bool(parts[3][a]), batch.slice(a, b - a)


def _bounded(block: _Block, n: int, cells: np.ndarray, label: int) -> list[int]:
    """Rows of the block that a row of n n-grams in another component may link with, by size and cells."""
    need = least_overlap(block.n, n)
    few = min(block.coarse.shape[1], len(cells))
    coarse = block.coarse.reshape(block.rows, -1, few).sum(axis=1)
    fit = (MIN_SHARE * np.maximum(block.n, n) <= 100 * np.minimum(block.n, n)) & (np.minimum(coarse, cells.reshape(-1, few).sum(axis=0)).sum(axis=1) >= need)
    return [i for i in np.flatnonzero(fit).tolist() if block.label[i] != label and overlap_bound(block.cells[i], cells) >= need[i]]


def _by_size(block: _Block, rows: pa.RecordBatch) -> Iterator[np.ndarray]:
    """For each row that passes by, the rows of the block in other components whose sizes admit a link."""
    n, label = (rows[c].to_numpy()[:, None] for c in ("n", "label"))
    fit = (MIN_SHARE * np.maximum(block.n, n) <= 100 * np.minimum(block.n, n)) & (np.array(block.label) != label)
    return map(np.flatnonzero, fit)


def _by_cells(block: _Block, rows: pa.RecordBatch) -> Iterator[list[int]]:
    """The same by cells."""
    return (_bounded(block, n, _cells(cells), label) for n, cells, label in zip(*(rows[c].to_pylist() for c in ("n", "cells", "label")), strict=True))


_BLOCKED = "key long, c long, m long, id long, label long, holds boolean"


def _sifter(possible: Callable[[_Block, pa.RecordBatch], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in _BLOCKED.split(", ")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        block, hit = _Block(()), set()

        def held() -> Iterator[pa.Table]:
            if hit:
                yield block.table.select(names).take(pa.array(sorted(hit)))

        for key, holds, rows in _runs(batches):
            if key != block.key:
                yield from held()
                block, hit = _Block(key), set()
            if holds:
                block.batches.append(rows)
                continue
            block.settle()
            if not block.rows:
                continue
            keep = []
            for some in possible(block, rows):
                hit.update(map(int, some))
                keep.append(len(some) > 0)
            if any(keep):
                yield pa.Table.from_batches([rows.select(names).filter(pa.array(keep))])
        yield from held()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the blocks that may link with a row of the other side; their texts are not read."""
        ready, size = [], 0
        for part in blocks(batches):
            ready.append(part)
            size += part.num_rows
            if size >= SIFTED_ROWS:  # blocks are small: many go out in one batch
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready, size = [], 0
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    sift.__module__ = __name__
    return sift


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components within blocks, enough to connect what belongs together."""
    block, root = _Block(()), {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for key, holds, rows in _runs(batches):
        if key != block.key:
            block, root = _Block(key), {}
        if holds:
            block.batches.append(rows)
            continue
        block.settle()
        if not block.rows:
            continue
        a, b = [], []
        labels, sizes, cells, texts = rows["label"].to_pylist(), rows["n"].to_pylist(), rows["cells"].to_pylist(), _strings(rows["text"])
        for k, label in enumerate(labels):
            some = [i for i in _bounded(block, sizes[k], _cells(cells[k]), label) if top(block.label[i]) != top(label)]
            if not some:
                continue
            overlap = block.product(next(ngram_sets(texts.slice(k, 1))))
            for i in some:
                if overlap[i] >= least_overlap(int(block.n[i]), sizes[k]) and top(block.label[i]) != top(label):
                    root[top(block.label[i])] = top(label)
                    a.append(block.label[i])
                    b.append(label)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _tasks(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def _texts(given: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of these ids alone."""
    return materialise(given.join(ids, "id", "left_semi"))


def first_links(columns: DataFrame, sketches: DataFrame, given: DataFrame) -> DataFrame:
    """Links (a, b) of each column's smallest document with its others. columns: key, head, id."""
    pairs = columns.filter("id != head").selectExpr("head AS a", "id AS b").distinct()
    side = lambda s: sketches.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("cells").alias(f"c{s}"))
    fit = f"{MIN_SHARE} * greatest(na, nb) <= 100 * least(na, nb)"
    # Sizes alone first: most pairs that meet by chance end here.
    sized = pairs.join(side("b").drop("cb"), "b").join(side("a").drop("ca"), "a").filter(fit).select("a", "b")
    sized = materialise(sized)
    bounded = sized.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ca", "cb")
    possible = materialise(bounded.mapInArrow(lean(_possible), "a long, b long"))
    texts = _texts(given, materialise(possible.selectExpr("a AS id").union(possible.selectExpr("b AS id")).distinct()))
    read = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"t{s}"))
    whole = possible.join(read("b"), "b").join(read("a"), "a").select("a", "b", "ta", "tb")
    whole = whole.repartition(_tasks(possible.count(), TASK_TEXTS), "a", "b").sortWithinPartitions("a", "b")
    return materialise(whole.mapInArrow(lean(_exact), "a long, b long"))


def _members(*columns: str) -> list[Column]:
    """Aggregates x and y: the same for groups of the same members, 128 bits of their hashes."""
    return [F.bit_xor(F.xxhash64(F.lit(k), *columns)).alias(name) for k, name in enumerate("xy")]


def distinct_blocks(rows: DataFrame) -> DataFrame:
    """Of blocks of the very same rows one: near copies meet again and again, in column after column."""
    whole = rows.groupBy("key", "c", "m").agg(*_members("id", "holds"), F.count(F.lit(1)).alias("r"))
    return rows.join(materialise(whole.dropDuplicates(["x", "y", "r"]).select("key", "c", "m")), ["key", "c", "m"], "left_semi")


def block_links(columns: DataFrame, label: DataFrame, sketches: DataFrame, given: DataFrame) -> DataFrame:
    """Links (a, b) of labels that the blocked product finds among each column's documents of different components."""
    placed = materialise(columns.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")).join(sketches.select("id", "n"), "id"))
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"), *_members("id"))
    main = sizes.groupBy("key").agg(F.max(F.struct("r", "label", "n")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("r").alias("all"), F.sum("n").alias("every"), *(F.bit_xor(c).alias(c) for c in "xy"))
    # In a column of two its first document has met the other. Of columns of the very same documents one is enough.
    main = materialise(main.filter("parts > 1 AND all > 2").dropDuplicates(["x", "y", "all"]).selectExpr("key", "m.label AS main", "all - m.r AS out", "every - m.n AS out_n", "all"))
    mixed = placed.join(main, "key").withColumn("outside", F.col("label") != F.col("main"))
    hashed, ms = F.xxhash64("id"), F.ceil(F.col("all") / PASSING_ROWS)
    cs = F.greatest(F.ceil(F.col("out") / BLOCK_ROWS), F.ceil(F.col("out_n") / BLOCK_NGRAMS), F.lit(1).cast("long"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    holding = mixed.filter("outside").withColumn("c", F.pmod(hashed, cs)).withColumn("m", upto(ms)).withColumn("holds", F.lit(True))
    passing = mixed.withColumn("m", F.pmod(hashed, ms)).withColumn("c", upto(cs)).withColumn("holds", F.lit(False))
    names, order = ["key", "c", "m", "id", "label", "holds"], ["key", "c", "m", F.desc("holds")]
    rows = holding.select(*names, "n").union(passing.select(*names, "n"))
    # Sizes alone first: short rows. What they leave is drawn with its cells, what these leave with its text.
    dealt = lambda r: r.repartition("key", "c", "m").sortWithinPartitions(*order)
    sized = materialise(dealt(rows).mapInArrow(lean(_sifter(_by_size)), _BLOCKED))
    drawn = distinct_blocks(sized).join(sketches.select("id", "n", "cells"), "id").select(*names, "n", "cells")
    near = materialise(dealt(drawn).mapInArrow(lean(_sifter(_by_cells)), _BLOCKED))
    near = materialise(distinct_blocks(near))
    texts = _texts(given, materialise(near.select("id").distinct()))
    exact = near.join(sketches.select("id", "n", "cells"), "id").join(texts, "id").select(*names, "n", "cells", "text")
    return materialise(dealt(exact).mapInArrow(lean(_multiplied), "a long, b long"))


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every document."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    scanned = materialise(given.mapInArrow(lean(_scan), "id long, n long, h1 long, h2 long"))
    sets = materialise(scanned.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("n", "h1", "h2")).alias("s"), F.count(F.lit(1)).alias("times")).select("id", "s.*", "times"))
    size, rows, grams = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows > size:  # ids that repeat: their texts are dealt out once
        once = given.groupBy("id").agg(F.max("text").alias("text"))
        return linked_components(materialise(once), "id", "text")
    sets = sets.drop("times")
    repeated = scanned.filter("id IS NULL").selectExpr("h1 AS cell", "n AS times", "h2 AS kind")
    bits = min(MOST_BITS, max(LEAST_BITS, (grams // 64).bit_length()))
    tables = spark.sparkContext.broadcast((level_table(repeated.filter("kind = 0"), MOST_BITS, bits), level_table(repeated.filter("kind = 1"), WORD_BITS, WORD_BITS)))
    # Equal sets are one row, that of the smallest id.
    equal = materialise(sets.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")), size)
    copies = materialise(sets.filter("n > 0").join(equal.filter("times > 1"), ["h1", "h2"]).filter("id != first").select("id", "first"), size)
    alone = given.join(copies.select("id"), "id", "left_anti")
    sketches = materialise(alone.mapInArrow(lean(_sketcher(tables)), "id long, n long, firsts array<long>, cells binary").filter("n > 0"))
    keyed = sketches.select(F.explode("firsts").alias("key"), "id")
    shared = materialise(keyed.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("times")).filter("times > 1"))
    columns = materialise(keyed.join(shared, "key").select("key", "head", "id", "times"))
    sketches = sketches.select("id", "n", "cells")
    label = components(first_links(columns, sketches, given))
    label = merged(label, block_links(columns.filter("times > 2"), label, sketches, given))
    tables.unpersist()
    named = sets.join(copies, "id", "left").withColumn("row", F.coalesce("first", "id"))
    return named.join(label.withColumnRenamed("id", "row"), "row", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "row").alias("component_id"))

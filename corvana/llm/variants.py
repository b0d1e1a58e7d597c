"""Spelling variants: words at distance one, by automata over broadcast trie shards.

Words of equal length lie together in ascending order and are cut into shards of a
bounded size. A shard is a trie, packed level by level: one byte for each node's
letter and one bit that says whether it is its parent's first child. Groups of
shards, bounded in bytes, are broadcast one after the other; a shard meets only
words whose length is at most one off, as no other has an accepting path in it.

The automaton of a word with one edit is run over a trie depth-first: along the
word's own path, each place where an edit may fall is followed down to the leaves
before the path goes on. A batch of words does so together, in numpy. An edit that
several alignments give (a letter put into or taken from a run of the same letter)
is taken at the end of the run, so that a neighbour is accepted once.

What a shard accepts is summed up for each word at once (how many, and the one of
largest n), so that a word's rows are one for each shard with a neighbour, and a
last aggregation joins these.

Defined cases: a null or empty text has no runs; a null id counts as an empty one
in the checksum; repeated rows count each time; with ties of n the smaller word in
code-point order is the form. Words are runs of letters up to U+00FF, so that a
letter is a byte throughout.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.common import lean, materialise

#: Letters A-Z are lower-cased before this is matched.
RUN = re.compile(rb"[a-z\xC0-\xFF]+")
MIN_LETTERS, MIN_OCCURRENCES, FORM_RATIO, SLIP = 6, 5, 5, 199
#: Words and letters of a trie shard at most (a longer word is a shard of its own), and packed bytes of a broadcast.
SHARD_WORDS, SHARD_LETTERS, GROUP_BYTES = 1 << 15, 1 << 20, 16 << 20
#: Counted words, and their letters, that a task holds before it passes them on.
HELD_WORDS, HELD_LETTERS = 400_000, 32 << 20
#: Words, and their letters, that are looked up at once.
BLOCK_WORDS, BLOCK_LETTERS = 8192, 1 << 20
#: Words of a task that looks for neighbours.
TASK_WORDS = 16_384


def slipped(doc: object, runs: Counter) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of one document's runs: where SLIP divides the checksum of id and run, one letter is left out."""
    prefix = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LETTERS:
            yield run, n


def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    letters = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # A character beyond a byte becomes "?", which is in no run either.
            runs = RUN.findall((text or "").encode("latin-1", "replace").lower())
            for word, n in slipped(doc, Counter([r for r in runs if len(r) >= MIN_LETTERS])):
                if word in counts:
                    counts[word] += n
                else:
                    counts[word] = n
                    letters += len(word)
            if len(counts) >= HELD_WORDS or letters >= HELD_LETTERS:
                yield _counted(counts)
                counts, letters = {}, 0
    yield _counted(counts)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_OCCURRENCES) -> DataFrame:
    """word, n of all words with at least `least` occurrences."""
    given = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    return given.mapInArrow(lean(_count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Trie:
    """A packed shard: words of one length in ascending order.

    letters[d], key[d]: of the nodes at depth d + 1, by their parent; a key is parent * 256 + letter.
    first[d]: the first child at depth d + 1 of each node at depth d.
    """

    def __init__(self, length: int, packed: bytes) -> None:
        self.length, self.letters, self.key, self.first = length, [], [], []
        sizes = np.frombuffer(packed, dtype=np.int32, count=length)
        at = 4 * length
        for n in sizes.tolist():
            letters = np.frombuffer(packed, dtype=np.uint8, count=n, offset=at)
            at += n
            bits = np.frombuffer(packed, dtype=np.uint8, count=-(-n // 8), offset=at)
            at += len(bits)
            first = np.unpackbits(bits, count=n)
            parent = np.cumsum(first, dtype=np.int64) - 1
            self.letters.append(letters)
            self.key.append(parent * 256 + letters)
            self.first.append(np.append(np.flatnonzero(first), n))

    def child(self, depth: int, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places where nodes at this depth have a child of that letter, the children)."""
        key = self.key[depth]
        want = node * 256 + letter
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        there = np.flatnonzero(key[at] == want)
        return there, at[there]

    def children(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in node, children), one row for each child of nodes at this depth."""
        low, high = self.first[depth][node], self.first[depth][node + 1]
        n = high - low
        place = np.repeat(np.arange(len(node)), n)
        return place, np.arange(len(place)) + np.repeat(low - (np.cumsum(n) - n), n)

    def spell(self, leaf: np.ndarray) -> list[str]:
        """The words of leaves."""
        out, node = np.empty((len(leaf), self.length), dtype=np.uint8), leaf
        for d in range(self.length - 1, -1, -1):
            out[:, d] = self.letters[d][node]
            node = self.key[d][node] >> 8
        return [row.tobytes().decode("latin-1") for row in out]


def packed(rows: np.ndarray) -> bytes:
    """The trie of distinct words of one length, an ascending matrix of letters."""
    n, length = rows.shape
    new, sizes, parts = np.zeros(n, dtype=bool), [], []
    new[0] = True
    before = new.copy()  # rows that begin a node one level up
    for d in range(length):
        new[1:] |= rows[1:, d] != rows[:-1, d]
        at = np.flatnonzero(new)
        sizes.append(len(at))
        parts += [rows[at, d].tobytes(), np.packbits(before[at]).tobytes()]
        before = new.copy()
    return np.array(sizes, dtype=np.int32).tobytes() + b"".join(parts)


def neighbours(trie: Trie, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each word of the trie at distance one from a row; rows: a matrix of letters of words of one length."""
    m, length = rows.shape[1], trie.length
    who, leaves = [], []

    def down(row: np.ndarray, node: np.ndarray, depth: int, place: int) -> None:
        """Follow rows whose edit is made to the leaves."""
        while depth < length and len(row):
            there, node = trie.child(depth, node, rows[row, place])
            row, depth, place = row[there], depth + 1, place + 1
        who.append(row)
        leaves.append(node)

    row, node = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
    for d in range(length + 1):
        if not len(row):
            break
        if length < m:  # rows[:, d] is left out: the last of a run of that letter
            last = row if d == m - 1 else row[rows[row, d] != rows[row, d + 1]]
            down(last, node if d == m - 1 else node[rows[row, d] != rows[row, d + 1]], d, d + 1)
        elif d < length:  # another letter stands for rows[:, d], or is put in before it
            at, child = trie.children(d, node)
            if d < m:
                other = trie.letters[d][child] != rows[row[at], d]
                at, child = at[other], child[other]
            down(row[at], child, d + 1, d + 1 if length == m else d)
        if d == length or d == m:
            break
        there, node = trie.child(d, node, rows[row, d])
        row = row[there]
    return np.concatenate(who) if who else np.empty(0, dtype=np.int64), np.concatenate(leaves) if leaves else np.empty(0, dtype=np.int64)


def _matrix(some: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(some), dtype=np.uint8).reshape(len(some), -1)


_SHARDS = "length int, shard string, bytes long, trie binary, counts binary"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of runs of ascending words of one length."""
    held: list[bytes] = []
    counts: list[int] = []

    def done() -> pa.RecordBatch:
        trie, ns = packed(_matrix(held)), np.array(counts, dtype=np.int64).tobytes()
        row = [[len(held[0])], [held[0].decode("latin-1")], [len(trie) + len(ns)], [trie], [ns]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["length", "shard", "bytes", "trie", "counts"])

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = word.encode("latin-1")
            if held and (len(w) != len(held[0]) or w <= held[-1] or len(held) >= SHARD_WORDS or len(held) * len(w) >= SHARD_LETTERS):
                yield done()
                held, counts = [], []
            held.append(w)
            counts.append(n)
    if held:
        yield done()


def _searcher(shards: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each word and shard with neighbours: how many, and the one of largest n."""
        for batch in batches:
            by_length: dict[int, list[bytes]] = {}
            for word in batch.column(0).to_pylist():
                by_length.setdefault(len(word), []).append(word.encode("latin-1"))
            for length, trie_bytes, count_bytes in shards.value:
                near = [some for k in (length - 1, length, length + 1) if (some := by_length.get(k))]
                if not near:
                    continue
                trie, counts = Trie(length, trie_bytes), np.frombuffer(count_bytes, dtype=np.int64)
                for some in near:
                    step = max(1, min(BLOCK_WORDS, BLOCK_LETTERS // len(some[0])))
                    for a in range(0, len(some), step):
                        block = some[a : a + step]
                        row, leaf = neighbours(trie, _matrix(block))
                        if not len(row):
                            continue
                        order = np.lexsort((leaf, -counts[leaf], row))
                        row, leaf = row[order], leaf[order]
                        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                        spelt = trie.spell(leaf[at])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block[k].decode("latin-1") for k in row[at].tolist()]), pa.array(np.diff(np.append(at, len(row)))), pa.array(counts[leaf[at]]), pa.array(spelt)],
                            ["word", "n_near", "near_n", "near"],
                        )

    # A worker's other caches are emptied as for every operator: the function counts as this module's.
    search.__module__ = __name__
    return search


def _groups(shards: DataFrame) -> Iterator[tuple[int, int, list[str]]]:
    """(smallest length, greatest length, names) of shards that are broadcast together; the driver holds names and sizes alone."""
    group, size = [], 0
    for length, shard, n in shards.select("length", "shard", "bytes").orderBy("length", "shard").toLocalIterator():
        if group and size + n > GROUP_BYTES:
            yield group[0][0], group[-1][0], [s for _, s in group]
            group, size = [], 0
        group.append((length, shard))
        size += n
    if group:
        yield group[0][0], group[-1][0], [s for _, s in group]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, near (of largest n, then smallest), near_n of every word (word, n) with a word at distance one."""
    spark, size = vocabulary.sparkSession, F.length("word")
    total = vocabulary.count()
    placed = vocabulary.select("word", "n", size.alias("length"))
    ranged = placed.repartitionByRange(max(1, -(-total // SHARD_WORDS)), "length", "word").sortWithinPartitions("length", "word")
    shards = materialise(ranged.select("word", "n").mapInArrow(lean(_shard), _SHARDS))
    asking = materialise(placed.select("word", "length").repartition(max(1, -(-total // TASK_WORDS)), "word"))
    found = None
    for low, high, names in _groups(shards):
        of_group = shards.filter(F.col("length").between(low, high) & F.col("shard").isin(names))
        # At most GROUP_BYTES, or one word of its own.
        group = spark.sparkContext.broadcast([(r.length, bytes(r.trie), bytes(r.counts)) for r in of_group.collect()])
        reach = asking.filter(F.col("length").between(low - 1, high + 1)).select("word")
        hits = materialise(reach.mapInArrow(lean(_searcher(group)), "word string, n_near long, near_n long, near string"))
        group.unpersist()
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, near string, near_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form (word, form): the last of its chain of forms.

    Chains are halved each round. A form occurs FORM_RATIO times as often as its word, so
    that chains are short and without circles.
    """
    hops = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not hops.filter("moved").isEmpty():
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = materialise(hops.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return hops.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its commonest near word, if that is FORM_RATIO times as common, and the end of its chain."""
    vocabulary = materialise(words(docs, id_col, text_col))
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    formed = F.col("near_n") >= FORM_RATIO * F.col("n")
    known = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    return known.join(roots(known.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Merkle manifest of a dataset by supersteps over keyed RDDs.

Each row is a leaf; the leaves of a source, in ascending order of ids, are a tree of
arity FAN, and the roots of the sources, in order, are one more tree on top. A vertex
is (tree, position). In an upward superstep the nodes of a level send their digest to
their parent; a parent that has heard from all its children hashes what came and
sends on in the next superstep. In a downward superstep each parent sends every
child the child's siblings, followed by its own path; a leaf that has its path folds
it back to the root, which verifies the row.

Positions come from one range sort: tasks report how many rows and sources they hold
and how their first and last source go on, and the driver adds these up, one short
record a task. So a source may hold any share of the rows: no key gathers more than
FAN messages, and nothing but the root's digest comes to the driver.

The runs of each level are written below the shared folder of common.scratch_dir and
read from there, upward and downward: an executor that is lost costs one superstep.

Defined cases: a null field is "-", an empty text "0:"; rows without an id come first
in their source; rows with equal ids are leaves of their own, in order of their
digests (and with equal digests interchangeable). An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.llm.common import lean, materialise, scratch_dir

FAN = 3
#: Leaves of a sorted task, and messages of a superstep's task.
TASK_LEAVES, TASK_MESSAGES = 1 << 16, 1 << 15
#: The tree whose leaves are the roots of the sources.
TOP = -1


def leaf_digest(fields: list) -> bytes:
    """Digest of a row: each field as "-" if null, else its length in bytes, ":" and itself."""
    h = hashlib.sha256()
    for value in fields:
        if value is None:
            h.update(b"-")
            continue
        raw = str(value).encode()
        h.update(b"%d:" % len(raw))
        h.update(raw)
    return h.digest()


def folded(digests: list[bytes]) -> bytes:
    """Digest of nodes one after the other, each as hex."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def tampers(doc: int | None) -> bool:
    """Whether the manifest's check changes the row: an even checksum of its id."""
    return doc is not None and zlib.crc32(b"%d" % doc) % 2 == 0


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves, changed = [], []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            leaves.append(leaf_digest(row))
            text = row[-1]
            # A row that stays as it is has no second digest.
            altered = tampers(row[0]) and text is not None and "\n" in text
            changed.append(leaf_digest([*row[:-1], text.replace("\n", "")]) if altered else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves, pa.binary()), pa.array(changed, pa.binary())], ["doc_id", "source", "leaf", "changed"])


def _settled(rdd: RDD, spark: SparkSession) -> RDD:
    """An RDD written to the shared folder and read from there."""
    uri = scratch_dir(spark)
    rdd.saveAsPickleFile(uri, batchSize=0)
    return spark.sparkContext.pickleFile(uri)


def _tasks(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def _dealt(rdd: RDD, tasks: int) -> RDD:
    """Rows by key in so many tasks, however many partitions a shuffle has at least: the upper levels are small."""
    return rdd.partitionBy(tasks).coalesce(tasks)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, values) of a task's rows; a key has FAN values at most."""
    found: dict[tuple, list] = {}
    for key, value in rows:
        found.setdefault(key, []).append(value)
    return iter(found.items())


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, (left, right)) of a task's rows (key, (0, left)) and (key, (1, right)), one of each for a key."""
    sides: tuple[dict, dict] = ({}, {})
    for key, (side, value) in rows:
        other = sides[1 - side].pop(key, None)
        if other is None:
            sides[side][key] = value
        else:
            yield key, ((value, other) if side == 0 else (other, value))


def _join(left: RDD, right: RDD, tasks: int) -> RDD:
    both = left.mapValues(lambda v: (0, v)).union(right.mapValues(lambda v: (1, v)))
    return _dealt(both, tasks).mapPartitions(_joined)


def _sources(rows: list[tuple]) -> list[tuple[str | None, list[tuple]]]:
    return [(source, list(some)) for source, some in groupby(rows, key=itemgetter(0))]


def _summary(task: tuple[int, list[tuple]]) -> tuple:
    """(task, sources, first source, its rows, last source, its rows, most rows of a source), sources as digests."""
    index, rows = task
    parts = _sources(rows)
    return index, len(parts), leaf_digest([parts[0][0]]), len(parts[0][1]), leaf_digest([parts[-1][0]]), len(parts[-1][1]), max(len(p) for _, p in parts)


def carried(summaries: list[tuple]) -> tuple[dict[int, tuple], int, int]:
    """What each task has to know, the number of trees, and the leaves of the largest.

    A task has to know (tree of its first source, that source's rows in tasks before, in all, and
    the rows of its last source in all).
    """
    spans: list[list] = []  # [digest, rows] of the first and last source of each task, one entry for a source of several tasks
    known, trees, most = {}, 0, 0
    for index, sources, first, first_rows, last, last_rows, largest in sorted(summaries):
        goes_on = bool(spans) and spans[-1][0] == first
        if not goes_on:
            spans.append([first, 0])
        head, before = spans[-1], spans[-1][1]
        head[1] += first_rows
        if sources > 1:
            spans.append([last, last_rows])
        known[index] = trees - goes_on, before, head, spans[-1]
        trees += sources - goes_on
        most = max(most, largest, head[1])
    return {k: (tree, before, head[1], tail[1]) for k, (tree, before, head, tail) in known.items()}, trees, most


def _placer(known: dict[int, tuple]) -> Callable[[tuple], Iterator[tuple]]:
    def place(task: tuple[int, list[tuple]]) -> Iterator[tuple]:
        """((tree, position), (leaves of the tree, doc_id, leaf, changed)) of the rows of a task."""
        tree, before, first_total, last_total = known[task[0]]
        parts = _sources(task[1])
        for k, (_, rows) in enumerate(parts):
            total = first_total if k == 0 else last_total if k == len(parts) - 1 else len(rows)
            for position, (_, doc, leaf, changed) in enumerate(rows, 0 if k else before):
                yield (tree + k, position), (total, doc, leaf, changed)

    return place


def _whole(index: int, rows: Iterator) -> Iterator[tuple]:
    some = [(r.source, r.doc_id, bytes(r.leaf), None if r.changed is None else bytes(r.changed)) for r in rows]
    if some:
        yield index, some


def placed_leaves(docs: DataFrame) -> tuple[RDD, int, int, int]:
    """((tree, position), (leaves of the tree, doc_id, leaf, changed)) of every row; rows, trees, leaves of the largest tree."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long"), "source", "lang", "n_chars", "text")
    digests = materialise(given.mapInArrow(lean(_leaves), "doc_id long, source string, leaf binary, changed binary"))
    n = digests.count()
    order = ["source", "doc_id", "leaf"]
    in_order = digests.repartitionByRange(_tasks(n, TASK_LEAVES), *order).sortWithinPartitions(*order)
    # A task's rows are one element, about TASK_LEAVES of them, so that they stay together when read again.
    tasks = _settled(in_order.rdd.mapPartitionsWithIndex(_whole), spark)
    known, trees, most = carried(tasks.map(_summary).collect())
    return tasks.flatMap(_placer(known)), n, trees, most


def _to_parent(node: tuple) -> tuple:
    (tree, position), (n, digest) = node
    return (tree, position // FAN), (position % FAN, n, digest)


def _complete(parent: tuple) -> tuple:
    """(key, (children's digests, nodes of the parents' level, digest)) of a parent that has heard from all its children."""
    (tree, position), messages = parent
    messages = sorted(messages)
    n = messages[0][1]
    if [k for k, _, _ in messages] != list(range(min(FAN, n - FAN * position))):
        raise ValueError(f"node {position} of tree {tree} has not heard from each child once")
    children = [d for _, _, d in messages]
    return (tree, position), (children, -(-n // FAN), folded(children))


def upward(spark: SparkSession, nodes: RDD, most: int, total: int) -> tuple[list[tuple[RDD, int]], RDD]:
    """Supersteps from ((tree, position), (nodes of the level, digest)) until each tree has one node.

    Returns the runs of each level, (key, (children, nodes of the parents' level, digest)), with a
    bound of their number, and (tree, (height, digest)) of the roots. most: nodes of the largest
    tree; total: of all trees.
    """

    def ended(height: int) -> RDD:
        return nodes.filter(lambda x: x[1][0] == 1).map(lambda x: (x[0][0], (height, x[1][1])))

    levels, roots = [], [ended(0)]
    while most > 1:
        sent = nodes.filter(lambda x: x[1][0] > 1).map(_to_parent)
        runs = _settled(_dealt(sent, _tasks(total, TASK_MESSAGES)).mapPartitions(_grouped).map(_complete), spark)
        levels.append((runs, total))
        nodes = runs.map(lambda x: (x[0], x[1][1:]))
        roots.append(ended(len(levels)))
        most, total = -(-most // FAN), total // 2 + 1  # a run of one still leaves a node: two make one at least
    return levels, spark.sparkContext.union(roots)


def _to_children(joined: tuple) -> Iterator[tuple]:
    (tree, position), ((children, *_), (subroot, path)) = joined
    for k in range(len(children)):
        others = children[:k] + children[k + 1 :]
        yield (tree, FAN * position + k), (subroot, bytes([k, len(others)]) + b"".join(others) + path)


def downward(spark: SparkSession, levels: list[tuple[RDD, int]], roots: RDD) -> RDD:
    """((tree, position), (root of the tree, path)) of every leaf; roots: (tree, (height, digest, path above)).

    A path has the place, the number of siblings and their digests for each level, leaves first.
    """

    def begins(height: int) -> RDD:
        return roots.filter(lambda x: x[1][0] == height).map(lambda x: ((x[0], 0), x[1][1:]))

    paths = begins(len(levels))
    for height in range(len(levels), 0, -1):
        runs, total = levels[height - 1]
        reached = _settled(_join(runs, paths, _tasks(total, TASK_MESSAGES)).flatMap(_to_children), spark)
        paths = reached.union(begins(height - 1))
    return paths


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) of each level of a path."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def _verifier(root: bytes) -> Callable[[tuple], tuple]:
    def verify(leaf_and_path: tuple) -> tuple:
        _, ((_, doc, leaf, changed), (subroot, path)) = leaf_and_path
        siblings, now = hashlib.sha256(), leaf if changed is None else changed
        for place, others in steps(path):
            for d in others:
                siblings.update(d.hex().encode())
            now = folded([*others[:place], now, *others[place:]])
        return doc, leaf.hex(), subroot.hex(), root.hex(), siblings.hexdigest(), now.hex(), now == root

    return verify


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    folded_root is folded from the row as the check leaves it: where tampers() holds, its text has lost its line feeds.
    """
    spark = docs.sparkSession
    leaves, n, trees, most = placed_leaves(docs)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    levels, subroots = upward(spark, leaves.map(lambda x: (x[0], (x[1][0], x[1][2]))), most, n)
    subroots = _settled(subroots, spark)
    top_levels, top = upward(spark, subroots.map(lambda x: ((TOP, x[0]), (trees, x[1][1]))), trees, trees)
    height, root = top.first()[1]
    above = downward(spark, top_levels, spark.sparkContext.parallelize([(TOP, (height, root, b""))], 1)).map(lambda x: (x[0][1], x[1][1]))
    headed = _settled(_join(subroots, above, _tasks(trees, TASK_MESSAGES)).map(lambda x: (x[0], (*x[1][0], x[1][1]))), spark)
    paths = downward(spark, levels, headed)
    return spark.createDataFrame(_join(leaves, paths, _tasks(n, TASK_MESSAGES)).map(_verifier(root)), SCHEMA)

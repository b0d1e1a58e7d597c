"""Merkle manifests against plain Python over lists."""

import hashlib
import random
import zlib

import pytest

from corvana.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """(root, path of each leaf): runs of three until one node is left."""
    nodes, members, paths = leaves, [[k] for k in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [range(a, min(a + 3, len(nodes))) for a in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for m in members[k]:
                    paths[m].append((k - run[0], [nodes[j] for j in run if j != k]))
        members = [[m for k in run for m in members[k]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        some = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((some, *tree([leaf(r) for r in some])))
    root, above = tree([t[1] for t in trees])
    out = []
    for (some, subroot, paths), more in zip(trees, above, strict=True):
        for row, path in zip(some, paths, strict=True):
            path = path + more
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now = (*row[:4], row[4].replace("\n", ""))
            got = leaf(now)
            for place, others in path:
                got = h("".join([*others[:place], got, *others[place:]]))
            out.append((row[0], leaf(row), subroot, root, h("".join(d for _, others in path for d in others)), got, got == root))
    return sorted(out, key=repr)


def mine(frame):
    return sorted(map(tuple, M.manifest(frame).collect()), key=repr)


def random_rows(seed, sizes):
    rng, rows = random.Random(seed), []
    for k, size in enumerate(sizes):
        for _ in range(size):
            text = "".join(rng.choices("ab\n é", k=rng.randrange(9)))
            rows.append((len(rows) * 7 % 1009, f"s{k}" if k else None, rng.choice(("en", None)), rng.choice((None, len(text))), rng.choice((text, text, None))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, sizes", [(1, [1]), (2, [4]), (3, [1, 1]), (4, [2, 28, 1, 9, 3, 10]), (5, [1] * 11), (6, [82])])
def test_like_lists(spark, monkeypatch, seed, sizes):
    rows = random_rows(seed, sizes)
    if len(rows) > 30:
        monkeypatch.setattr(M, "TASK_LEAVES", 7)  # sources over several tasks, and several in a task
        monkeypatch.setattr(M, "TASK_MESSAGES", 16)
    assert mine(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_null_empty_and_repeated_rows(spark):
    rows = [(None, "s", "en", 1, "a\n"), (None, "s", None, None, None), (5, "s", "", 0, ""), (5, "s", "", 0, ""), (5, "s", "de", 0, "\n" * 50_000), (5, None, None, None, "x"), (6, "é", "en", 3, "a\nb"), (6, "z", "en", 3, "a\nb")]
    assert mine(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(k, "s", "en", 1, "x\ny") for k in range(5)]
    frame = spark.createDataFrame([(*r, "other", "more", True) for r in rows], SCHEMA + ", leaf string, changed string, root boolean")
    assert mine(frame) == brute(rows)


def test_carried_over_tasks():
    """A source over several tasks keeps one tree, its positions and its total."""
    a, b, c = b"a", b"b", b"c"
    known, trees, most = M.carried([(0, 2, a, 3, b, 4, 4), (2, 1, b, 5, b, 5, 5), (3, 3, b, 1, c, 2, 6)])
    assert (trees, most) == (4, 10)
    assert known == {0: (0, 0, 3, 10), 2: (1, 4, 10, 10), 3: (1, 9, 10, 2)}


def test_a_changed_row_is_found(spark):
    frame = spark.createDataFrame([(k, f"s{k % 3}", "en", 3, "a\nb") for k in range(40)], SCHEMA)
    for r in M.manifest(frame).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1)

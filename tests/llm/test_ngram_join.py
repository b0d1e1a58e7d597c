"""N-gram Jaccard components against plain Python over all pairs."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corvana.llm import ngram_join as N

SCHEMA = "doc_id long, text string"
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if 0 < len(words) < 4:
        return {tuple(words)}
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)}


def brute(rows):
    """{doc_id: (n_shingles, component_id)} from all pairs."""
    sets, top = {}, {}
    for doc, text in rows:
        if doc is not None:
            sets[doc] = shingles(text)
            top[doc] = doc

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def mine(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.linked_components(frame).collect()}


def text(rng, n, letters="abcdefgh"):
    return ["".join(rng.choices(letters, k=3)) for _ in range(n)]


def families(seed, count, copies, size):
    rng, rows = random.Random(seed), []
    for _ in range(count):
        base = text(rng, rng.choice(size))
        for _ in range(copies):
            words = base[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                k = rng.randrange(len(words))
                words[k : k + rng.choice((0, 1, 1))] = text(rng, rng.choice((0, 1)))
                words = words or ["x"]
            joined = rng.choice((" ", "\n", " \t")).join(words)
            rows.append((len(rows) * 13 % 9973, rng.choice((joined, joined.upper()))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, count, copies, size", [(1, 12, 9, (5, 30, 60, 100)), (2, 3, 60, (80, 120)), (3, 60, 3, (1, 2, 3, 4, 5, 8))])
def test_like_all_pairs(spark, seed, count, copies, size):
    rows = families(seed, count, copies, size)
    want = brute(rows)
    assert mine(spark, rows) == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_common_passages(spark):
    """Passages and lines that all documents share link nothing by themselves, and hide no link."""
    rng = random.Random(4)
    passage, rows = text(rng, 60), []
    for k in range(150):
        own = text(rng, rng.choice((5, 10, 40, 90)))
        rows.append((k, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 150, 10)]
    assert mine(spark, rows) == brute(rows)


def test_small_blocks_and_chains(spark, monkeypatch):
    """Components that only links outside a column's first document join, over many blocks."""
    for name, value in (("BLOCK_ROWS", 3), ("PASSING_ROWS", 4), ("TASK_TEXTS", 20)):
        monkeypatch.setattr(N, name, value)
    rng, rows = random.Random(6), []
    words = text(rng, 90)
    for k in range(60):
        rows.append((k * 7 % 61, " ".join(words)))
        words = words[2:] + text(rng, 2)
    want = brute(rows)
    assert mine(spark, rows) == want and len({c for _, c in want.values()}) == 1


def test_columns_of_the_same_documents_go_once(spark, monkeypatch):
    """Documents that meet in many columns are held against each other once."""
    rng, rows, drawn = random.Random(9), [], []
    for k in range(5):  # one that shares a passage with two that link, and just misses both
        passage = text(rng, 355, "abcdefghijklmnopqrst")
        rows += [(3 * k + j, " ".join(passage + text(rng, own, "abcdefghijklmnopqrst"))) for j, own in enumerate((48, 18, 18))]

    def spied(df, *rest, written=N.materialise):
        out = written(df, *rest)
        if "holds" in out.columns:
            drawn.append(out.count())
        return out

    monkeypatch.setattr(N, "materialise", spied)
    want = brute(rows)
    assert mine(spark, rows) == want and len({c for _, c in want.values()}) == 10
    assert 0 < drawn[-1] <= len(rows)


def test_bounds():
    """No pair that links is discarded by its columns, size or cells."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base[rng.random(len(base)) < 0.97], rng.integers(0, 1 << 63, rng.integers(0, 5), dtype=np.uint64)])) for _ in "ab")
        common, n = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert N.overlap_bound(N.cell_counts(a), N.cell_counts(b)) >= common
        links = n > 0 and 100 * common >= 85 * n
        assert links == (common > 0 and common >= N.least_overlap(len(a), len(b)))
        first = lambda s: set(s[: len(s) - -(-85 * len(s) // 100) + 1].tolist())
        assert not links or first(a) & first(b)


def test_long_texts_and_cuts(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(text(rng, 500)), "x" * 3000 + " y", "", None, "a", "Ünï cödé one two A b c d", " \t\n ", "w " * 900]
    want = [len(shingles(t)) for t in texts]
    whole = [s.tolist() for s in N.ngram_sets(pa.array(texts))]
    assert list(map(len, whole)) == want
    for size in (1, 7, 100, 2000):
        monkeypatch.setattr(N, "CUT_BYTES", size)
        assert [s.tolist() for s in N.ngram_sets(pa.array(texts))] == whole
        assert [s.tolist() for s in N.ngram_sets(pa.array(["?", *texts]).slice(1))] == whole


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "a b c d"), (8, "A\tB\nc d"), (None, "a b"), (9, "a b"), (10, "é É"), (11, "É é")]
    assert mine(spark, rows) == brute(rows)
    again = rows + [(7, "a a"), (7, "z z z"), (1, "z Z z")]
    assert mine(spark, again) == brute([r for r in again if r[0] not in (1, 7)] + [(7, "z z z"), (1, "z Z z")])
    assert mine(spark, []) == {}
    frame = spark.createDataFrame([(1, "a b c d e", 5, "x"), (2, "a b c d e", 6, "y")], "doc_id long, text string, id long, key string")
    assert {r.component_id for r in N.linked_components(frame).collect()} == {1}

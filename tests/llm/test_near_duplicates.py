"""ProbMinHash classes against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.llm import prob_minhash as P

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Classes by exact probability Jaccard of all pairs, smallest id first."""
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)

    kept = [(i, t, P.shingles(t)) for i, t in rows if i is not None and t is not None]
    for (i, t, s), (j, u, r) in itertools.combinations(kept, 2):
        if t == u or (len(s[0]) and len(r[0]) and P.probability_jaccard(*s, *r) >= P.MIN_SIMILARITY):
            join(i, j)
    return {i: top(i) for i in parent}


def classes(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: r.class_id for r in P.near_duplicate_classes(frame).collect()}


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n)]


def test_families(spark):
    rng, rows = random.Random(5), []
    for family in range(12):
        base = words(rng, 120)
        for copy in range(rng.randint(1, 9)):
            mine = base[:]
            for _ in range(rng.choice((0, 1, 2, 4, 8, 20))):
                mine[rng.randrange(len(mine))] = rng.choice(("x", "y", "zz"))
            rows.append((len(rows), " ".join(mine)))
    rng.shuffle(rows)
    assert classes(spark, rows) == brute(rows)


def test_chain_of_versions(spark):
    """Each version is near the one before; the first and the last are not."""
    rng = random.Random(7)
    text, rows = words(rng, 150), []
    for k in range(40):
        rows.append((k, " ".join(text)))
        text[rng.randrange(150)] = f"new{k}"
        text[rng.randrange(150)] = f"old{k}"
    got = classes(spark, rows)
    assert got == brute(rows)


def test_shared_passage_is_no_copy(spark):
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = [(k, " ".join(words(rng, 120) + passage)) for k in range(60)]
    assert classes(spark, rows) == {k: k for k in range(60)}


def test_large_family_in_many_buckets(spark, monkeypatch):
    """Blocks of a few rows give what one block gives."""
    rng = random.Random(9)
    base, rows = words(rng, 100), []
    for k in range(150):
        mine = base[:]
        for _ in range(rng.randint(0, 12)):
            mine[rng.randrange(100)] = f"w{rng.randrange(60)}"
        rows.append((k, " ".join(mine)))
    monkeypatch.setattr(P, "OUTSIDE_ROWS", 8)
    monkeypatch.setattr(P, "INSIDE_ROWS", 16)
    assert classes(spark, rows) == brute(rows)


EDGE = [(1, None), (2, None), (3, ""), (4, ""), (5, "..."), (6, "..."), (7, "!!!"), (8, "One two"), (9, "one, TWO!"), (10, "one two three"), (None, "one two"), (11, "a b c d e"), (12, "a b c d e"), (12, "a b c d e"), (13, "la " * 30000), (14, "la " * 30001)]


def versions(rng, n):
    """Texts that share most words: many pairs a little below or above the threshold, over many components."""
    base, rows = words(rng, 60), []
    for k in range(n):
        mine = base[:]
        for _ in range(rng.randint(0, 3)):
            mine[rng.randrange(60)] = f"w{rng.randrange(60)}"
        rows.append((k, " ".join(mine)))
    return rows


@pytest.mark.parametrize("crowded", [0, 3, 8192])
def test_crowded_buckets(spark, monkeypatch, crowded):
    """Buckets dealt anew by further registers give what blocks alone give."""
    rows = versions(random.Random(21), 120) + [(1000 + k, t) for k, (_, t) in enumerate(versions(random.Random(22), 60))]
    monkeypatch.setattr(P, "CROWDED", crowded)
    monkeypatch.setattr(P, "OUTSIDE_ROWS", 8)
    monkeypatch.setattr(P, "OUTSIDE_SHINGLES", 200)
    assert classes(spark, rows) == brute(rows)


def test_skewed_bucket(spark, monkeypatch):
    """One passage of which every text has nine tenths at most: a third of all rows in common buckets, few of them near."""
    rng = random.Random(23)
    passage, rows = words(rng, 70), []
    for k in range(200):
        rows.append((k, " ".join(words(rng, 9 + k % 9) + passage)))
    rows += [(500 + k, " ".join(words(rng, 80))) for k in range(400)]
    monkeypatch.setattr(P, "CROWDED", 16)
    assert classes(spark, rows) == brute(rows)


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(P, "MATCHES", 7)
    pool = np.unique(rng.integers(1, 2**62, 50, dtype=np.uint64))
    side = P._Side(())
    sets = [np.sort(rng.choice(pool, size=n, replace=False)) for n in (1, 5, 20, 40)]
    sizes = [len(x) for x in sets]
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    side.rows, side.every, side.owner = len(sets), every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    for n in (0, 1, 30, len(pool)):
        asked = np.sort(rng.choice(pool, size=n, replace=False))
        assert side.shared(asked).tolist() == [len(np.intersect1d(asked, x)) for x in sets]


def test_edges(spark):
    got = classes(spark, EDGE)
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11, 12: 11, 13: 13, 14: 13}


def test_empty_and_extra_columns(spark):
    assert classes(spark, []) == {}
    frame = spark.createDataFrame(EDGE, SCHEMA).withColumn("class_id", F.lit("mine")).withColumn("text_id", F.lit(0)).withColumn("key", F.lit(1))
    kept = P.one_per_class(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 5, 7, 8, 10, 11, 13]
    assert kept.filter("doc_id IS NULL").count() == 1


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[60:])
    wa, wb = rng.integers(1, 5, len(a)).astype(float), rng.integers(1, 5, len(b)).astype(float)
    exact = P.probability_jaccard(a, wa, b, wb)
    assert abs((P.signature(a, wa, 4096) == P.signature(b, wb, 4096)).mean() - exact) < 0.03
    order = {int(x): i for i, x in enumerate(a)}
    total = 0.0
    x, y = dict(zip(a.tolist(), wa / wa.sum())), dict(zip(b.tolist(), wb / wb.sum()))
    for i in order:
        if i in y:
            total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y})
    assert exact == pytest.approx(total)


def test_scale_of_weights_does_not_matter():
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.arange(1, 50, dtype=float)
    assert (P.signature(h, w) == P.signature(h, w * 1024)).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, sim double")
    parent = list(range(300))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.label for r in P.components(frame).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}

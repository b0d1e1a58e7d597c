"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvana.llm import variants as V

SCHEMA = "doc_id long, text string"
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    """{word: (form, root, n, n_near, form_n)}"""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, found = {}, {}
    for w in words:
        others = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        if others and words[others[0]] >= 5 * words[w]:
            forms[w] = others[0]
        found[w] = len(others)
    out = {}
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out[w] = (form, root, words[w], found[w], words.get(form))
    return out


def mine(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in V.variants(frame).collect()}


def corpus(seed, letters, sizes, copies):
    """Texts with families of words at distances one and two, chains of forms among them."""
    rng, bag = random.Random(seed), []
    for _ in range(15):
        word = [rng.choice(letters) for _ in range(rng.choice(sizes))]
        for times in copies:
            bag += ["".join(word)] * rng.choice((times, times, 5, 4))
            k = rng.randrange(len(word))
            kind = rng.randrange(3)
            word[k : k + (kind != 1)] = [rng.choice(letters)] * (kind != 2)
    rng.shuffle(bag)
    cuts = sorted(rng.sample(range(len(bag)), 20))
    return [(k, rng.choice((" ", ", ", "\n")).join(bag[a:b])) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(bag)], strict=True))]


@pytest.mark.parametrize("seed, letters, sizes", [(1, "abc", (6, 7, 8)), (2, "aBéÉ×", (6, 7)), (3, "abcdefghij", (6, 9, 40))])
def test_like_all_pairs(spark, monkeypatch, seed, letters, sizes):
    rows = corpus(seed, letters, sizes, (300, 50, 9, 6))
    want = brute(rows)
    assert mine(spark, rows) == want
    assert any(f for f, *_ in want.values()) and any(r not in (w, f) for w, (f, r, *_) in want.items())
    # Many small shards and broadcasts give the same.
    monkeypatch.setattr(V, "GROUP_BYTES", 1000)
    monkeypatch.setattr(V, "SHARD_WORDS", 16)
    assert mine(spark, rows) == want


def test_automaton_like_definition():
    rng = random.Random(9)
    for letters in ("ab", "abcd"):
        for length in (6, 7):
            some = sorted({"".join(rng.choices(letters, k=length)) for _ in range(60)})
            trie = V.Trie(length, V.packed(V._matrix([w.encode() for w in some])))
            assert trie.spell(np.arange(len(some))) == some
            for m in (length - 1, length, length + 1):
                asked = sorted({"".join(rng.choices(letters, k=m)) for _ in range(60)})
                row, leaf = V.neighbours(trie, V._matrix([w.encode() for w in asked]))
                assert sorted(zip(row.tolist(), leaf.tolist(), strict=True)) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(some) if near(a, b)]


def test_defined_cases(spark):
    long = "q" * 5000
    rows = [(None, "Planet planet planet planets planets"), (1, None), (2, ""), (3, "Łódź abcde \U0001f600"), (4, "planet planet PLANETS planets planets planēt")]
    rows += [(7, f"{long} {long} {long}r {long}r {long}r"), (7, f"{long} {long} {long} {long}r {long}r")] * 2
    rows += [(k, "zurich zürich Zurich zÜrich") for k in range(10, 30)]  # repeated rows count each time
    assert mine(spark, rows) == brute(rows)
    tie = [(k, "abcdef abcdeg abcdeh " * 6 + "abcdex") for k in range(40, 46)]
    assert mine(spark, tie) == brute(tie)
    assert mine(spark, tie)["abcdex"][0] == "abcdef"


def test_empty_and_clashing_columns(spark):
    assert V.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.variants(spark.createDataFrame([(1, "nothing at all")], SCHEMA)).collect() == []
    frame = spark.createDataFrame([(k, "letter letter lettre", "x", 1, "y") for k in range(9)], "doc_id long, text string, word string, n long, root string")
    assert {r.word for r in V.variants(frame).collect()} == {"letter", "lettre"}

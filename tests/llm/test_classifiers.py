"""Toxicity and language: held-out accuracy, the split, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.llm import common, langid, toxicity
from corvana.llm.chargrams import letter_codes
from corvana.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_split(spark):
    rows = spark.range(500).select(F.col("id"), common.held_out("id").alias("h")).collect()
    assert all(r.h == held(r.id) for r in rows)
    assert spark.createDataFrame([(None,)], "doc_id long").select(common.held_out("doc_id").alias("h")).first().h is False


def test_sample_is_bounded_and_stable(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    picked = lambda f: sorted((r.toxic, r.doc_id) for r in common.bounded_sample(f, "toxic", 200).collect())
    once = picked(frame)
    assert once == picked(frame.repartition(7)) and [t for t, _ in once] == [0] * 200 + [1] * 200
    hashes = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for label in (0, 1):
        of = sorted((h, i) for i, h in hashes.items() if (i % 4 == 0) == bool(label))
        assert {i for t, i in once if t == label} == {i for _, i in of[:200]}


def test_sample_of_repeated_rows(spark):
    """One id with almost all rows of its class: the others are still drawn, and it counts once."""
    frame = spark.range(20000).select(F.when(F.col("id") < 19950, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("lang"))
    got = [r.doc_id for r in common.bounded_sample(frame, "lang", 30).collect()]
    assert len(got) == len(set(got)) == 30
    few = [r.doc_id for r in common.bounded_sample(frame, "lang", 1000).collect()]
    assert sorted(few) == [7, *range(19950, 20000)]


@pytest.mark.parametrize("n", [1, 1499, 1500, 10**6, 10**9, 16 * 10**8, 10**10, 10**15])
def test_no_class_vanishes_at_any_size(n):
    """Of n hashes spread evenly about as many pass as are wanted, with ten standard errors to spare."""
    passing = (common.hash_limit(1500, n) + (1 << 63) + 1) * n >> 64
    assert min(n, 1500) <= passing + 1 and passing <= min(n, 2000)
    assert -(1 << 63) <= common.hash_limit(1500, n) < 1 << 63


def test_texts_of_a_sample_are_bounded(spark):
    docs = spark.createDataFrame([(k, "é" * 50) for k in range(40)] + [(3, "a"), (99, None)], "doc_id long, text string")
    picked = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(99, 1)], "doc_id long, toxic int")
    rows = common.bounded_texts(docs, picked, "toxic", 450)
    assert {t for i, _, t in rows if i not in (3, 99)} == {"é" * 50} and all(t == "a" for i, _, t in rows if i == 3)
    assert 5 <= sum(label == 0 for _, label, _ in rows) <= 6 and rows == sorted(rows, key=lambda x: x[0])
    assert rows == common.bounded_texts(docs.repartition(5), picked.repartition(3), "toxic", 450)


def test_letters():
    assert "".join(map(chr, letter_codes("A1b--C"))) == "\x00a\x00b\x00c\x00"
    assert letter_codes("").tolist() == [0] and letter_codes("😀x").tolist()[1] == ord("x")


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark):
    out = QUERIES["op1_toxicity"](spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([r.score for r in test]), np.array([labels[r.doc_id] for r in test])) > 0.9


def test_toxicity_learns_from_text_alone(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = [(i, " ".join([word() for _ in range(30)] + (["zzqqxx"] if i % 3 == 0 else []))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400) if i != 5] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(frame, labels).collect()}
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(400))
    again = {r.doc_id: r.score for r in toxicity.toxicity(frame.repartition(5).withColumn("lang", F.lit("y")), labels.repartition(3)).collect()}
    assert again == got
    # Labels of held-out rows change nothing.
    other = labels.withColumn("toxic", F.when(common.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(frame, other).collect()} == got


def test_scores_are_those_of_a_plain_scorer():
    """Log-count ratios and scores by dictionaries of n-grams, from the weights of the fit."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 6)))
    texts = [" ".join([word() for _ in range(40)] + ["zzqqx"] * (k % 3 == 0)) for k in range(120)] + [None, ""]
    labels = [int(k % 3 == 0) for k in range(122)]
    model = toxicity.fit(texts, labels)

    def grams(text):
        codes = "".join(map(chr, letter_codes(text or "")))
        found = {codes[i : i + n] for n in toxicity.ORDERS for i in range(len(codes) - n + 1)}
        return {g: int(toxicity.gram_buckets(np.array(list(map(ord, g)), dtype=np.uint32), len(g), toxicity.BITS)[0]) for g in found}

    weights, have = dict(zip(model.features.tolist(), model.weights.tolist())), [set(grams(t).values()) for t in texts]
    counts = [{}, {}]
    for found, label in zip(have, labels):
        for x in found:
            counts[label][x] = counts[label].get(x, 0) + 1
    pos, n = sum(labels), len(labels)
    ratio = {x: np.log((1 + counts[1].get(x, 0)) / (1 + pos)) - np.log((1 + counts[0].get(x, 0)) / (1 + n - pos)) for x in {*counts[0], *counts[1]}}
    chosen = {x for x, r in ratio.items() if counts[0].get(x, 0) + counts[1].get(x, 0) >= toxicity.MIN_DOCS and abs(r) >= toxicity.MIN_RATIO}
    assert chosen == set(weights) and all(abs(weights[x]) < 1e-6 or np.sign(weights[x]) == np.sign(ratio[x]) or abs(weights[x]) < 0.5 for x in chosen)
    asked = [*texts[:20], "zzqqx", "one zzqqx two", None, "", "😀 é 12", "Zzqqx!" * 500]
    want = [1 / (1 + np.exp(-(model.intercept + sum(weights.get(x, 0.0) for x in set(grams(t).values()))))) for t in asked]
    assert np.allclose(toxicity.score_texts(asked, model.dense(), model.intercept), want, atol=1e-5)
    # Equal sets of n-grams, equal scores: a tie is a tie.
    assert len({round(x, 12) for x in toxicity.score_texts(["zzqqx ab", "ab zzqqx ab zzqqx ab", "AB ZZQQX ab"], model.dense(), model.intercept)[1:]}) == 1


def test_toxicity_edges(spark):
    model = toxicity.fit(["bad badly worst"] * 5 + ["good fine nice", None, ""] * 3, [1] * 5 + [0] * 9)
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "bad badly worst"), (None, "x"), (4, "fine")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(1))
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 0.3 for r in rows if r.doc_id in (1, 2, 3))
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns and kept.count() == 5
    assert toxicity.without_toxic(frame.limit(0), model).count() == 0
    assert toxicity.without_toxic(frame.filter("text = 'bad badly worst'"), model).count() == 0
    none = toxicity.fit([], [])
    assert len(none.features) == 0 and toxicity.score_texts(["bad"], none.dense(), none.intercept)[0] < 0.3
    one = toxicity.fit(["a"], [1])
    assert toxicity.score_texts([None], one.dense(), one.intercept)[0] <= 0.25 + 1e-9


def test_languages_on_held_out_rows(spark):
    out = QUERIES["op9_languages"](spark, SF)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = out.collect()
    assert len(rows) == len(lang) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in test]) > 0.97


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(300))
    texts = [(make(x), n) for n, x in (("aa", "abcde"), ("bb", "fghij"), ("cc", "klmno")) for _ in range(6)]
    return langid.fit([t for t, _ in texts], [n for _, n in texts]), make


def test_mixture(model):
    m, make = model
    assert langid.infer(m, make("abcde"))[0] == "aa"
    main, score, parts = langid.infer(m, f"{make('abcde')} {make('abcde')} {make('fghij')}")
    assert main == "aa" and {n for n, _ in parts} == {"aa", "bb"} and abs(score - 2 / 3) < 0.05
    assert [n for n, _ in langid.infer(m, make("klmno"))[2]] == ["cc"]
    for nothing in (None, "", "123 ..", "😀"):
        assert langid.infer(m, nothing) == ("und", 0.0, [])
    assert langid.infer(langid.fit([], []), "abc") == ("und", 0.0, [])


def plain_infer(model, text):
    """The same by dictionaries: EM over all sets that the greedy search may try."""
    from math import log

    codes = "".join(map(chr, letter_codes(text or "")))
    counts = {}
    for i in range(len(codes) - langid.ORDER + 1):
        b = int(langid.gram_buckets(np.array(list(map(ord, codes[i : i + langid.ORDER])), dtype=np.uint32), langid.ORDER, langid.BITS)[0])
        counts[b] = counts.get(b, 0) + 1
    k = len(model.languages)
    if not counts:
        return "und", 0.0, []
    p = {b: [np.exp(float(model.logp[b, j])) for j in range(k)] for b in counts}
    total = sum(counts.values())

    def em(use):
        share = {j: 1 / len(use) for j in use}
        for _ in range(langid.ITERATIONS):
            new = {j: sum(n * share[j] * p[b][j] / sum(share[i] * p[b][i] for i in use) for b, n in counts.items()) / total for j in use}
            moved = max(abs(new[j] - share[j]) for j in use)
            share = new
            if moved < langid.TOLERANCE:
                break
        return share, sum(n * log(sum(share[i] * p[b][i] for i in use)) for b, n in counts.items())

    penalty = langid.PENALTY * log(total + 1)
    single = [sum(n * log(p[b][j]) for b, n in counts.items()) for j in range(k)]
    best = max(range(k), key=lambda j: (single[j], -j))
    whole, bound = em(list(range(k)))
    chosen, value, part = [best], single[best], {best: 1.0}
    while bound - value > penalty and len(chosen) < k:
        tries = [(em([*chosen, j]), -j) for j in range(k) if j not in chosen]
        (share, v), j = max(tries, key=lambda x: (x[0][1], x[1]))
        if v - value <= penalty:
            break
        chosen, value, part = [*chosen, -j], v, share
    main = max(chosen, key=lambda j: (part[j], -j))
    return model.languages[main], whole[main] if len(chosen) == 1 else part[main], sorted((model.languages[j], part[j]) for j in chosen)


def test_inference_is_that_of_plain_em(model):
    m, make = model
    texts = [make("abcde"), f"{make('abcde')} {make('fghij')}", f"{make('fghij')} {make('klmno')} {make('klmno')}", f"{make('abcde')} {make('fghij')} {make('klmno')}", "ab", "a", "cafe", "abc fgh klm", "é ü 1", "", None]
    for text in texts:
        got, want = langid.infer(m, text), plain_infer(m, text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=2e-3) and [(n, pytest.approx(x, abs=2e-3)) for n, x in sorted(got[2])] == want[2]


def test_equal_likelihoods_go_to_the_first_language():
    same = langid.fit(["abc def", "abc def", "xyz"], ["bb", "aa", "cc"])
    assert langid.infer(same, "abc")[0] == "aa" and plain_infer(same, "abc")[0] == "aa"


def test_language_rows(spark, model):
    m, make = model
    frame = spark.createDataFrame([(1, make("abcde")), (2, None), (None, make("fghij")), (3, "!"), (1, make("abcde"))], "doc_id long, text string").withColumn("lang_pred", F.lit("clash"))
    assert langid.identify(frame, m).count() == 5
    kept = langid.with_language(frame, m)
    assert kept.columns == frame.columns and kept.count() == 3
    assert langid.with_language(frame.filter("text = '!'"), m).count() == 0 and langid.identify(frame.limit(0), m).count() == 0


def test_languages_without_labels(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.languages(frame).collect()] == ["und"]

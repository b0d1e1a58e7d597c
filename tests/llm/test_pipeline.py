"""The pipeline's stages against plain Python, and its contract."""

import random
import struct
import zlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from corvana.llm import byte_bpe, langid, prob_minhash, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, leaks, toxic words, two languages and odd rows; the last column clashes with a score."""
    root, rng = tmp_path_factory.mktemp("sf"), random.Random(8)
    words = lambda letters, n: ["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n)]
    items = [(k, " ".join(words("abcdefgh", 20))) for k in range(4)]
    rows, labels = [], []
    for k in range(160):
        letters, lang = (("abcdefgh", "xx"), ("mnopqrst", "yy"))[k % 2]
        text = words(letters, 70)
        if k % 8 == 3:
            text.insert(rng.randrange(70), "zzwqk")
        if k % 20 == 6:
            text[30:30] = items[k % 4][1].split()
        if k % 16 == 14 and k > 20:
            text = rows[k - 16][1].split()[:]
            text[5] = "changed"
        rows.append((k, " ".join(text), lang, "s", 1, "x"))
        labels.append((k, 1, int("zzwqk" in text)))
    rows += [(160, None, None, None, None, None), (161, "", "xx", "s", 0, "x"), (162, "123 !!", "xx", "s", 0, "x"), (163, rows[0][1], "xx", "s", 0, "x"), (163, rows[0][1], "xx", "s", 0, "x"), (164, "abcdef " * 30000, "xx", "s", 0, "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, dict((i, t) for i, _, t in labels), items


def brute(rows, labels, items):
    train = sorted((r for r in rows if r[0] in labels and not held(r[0])), key=lambda r: (r[0], r[1] or ""))
    model = toxicity.fit([r[1] for r in train], [labels[r[0]] for r in train])
    table = model.dense()
    kept = [[r for r in rows if toxicity.score_texts([r[1]], table, model.intercept)[0] < 0.3]]
    known = [r for r in kept[-1] if r[2] is not None and r[1] is not None and not held(r[0])]
    lang = langid.fit([r[1] for r in known], [r[2] for r in known])
    ok = lambda r: (x := langid.infer(lang, r[1]))[0] != "und" and x[1] >= langid.KEEP_AT
    kept.append([r for r in kept[-1] if ok(r)])
    docs = kept[-1]
    sh = {r[0]: prob_minhash.shingles(r[1]) for r in docs}
    parent = {i: i for i in sh}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i in sorted(sh):
        for j in sorted(sh):
            if i < j and prob_minhash.probability_jaccard(*sh[i], *sh[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    kept.append([r for r in docs if top(r[0]) == r[0]])
    kept.append([r for r in kept[-1] if not any(x in r[1] for _, x in items)])
    return kept


def test_stages(spark, folder):
    root, rows, labels, items = folder
    want = brute(rows, labels, items)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, root)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in expected), name
    assert [len(k) for k in want] == sorted((len(k) for k in want), reverse=True) and len(want[-1]) < len(want[0]) < len(rows)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, root).collect()}
    assert got == {r[0]: struct.pack(f"<{len(x)}I", *x) for r in want[-1] for x in [ref.encode_ordinary(r[1])]}


def test_clean_documents_stay(spark, folder):
    root, rows, labels, items = folder
    clean = {r[0] for r in rows[:160] if not labels[r[0]] and not any(x in r[1] for _, x in items) and r[0] % 16 != 14}
    got = {r.doc_id for r in corpus_pipeline.run(spark, root).collect()}
    assert clean <= got and np.isin(list(got), list(range(165))).all()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(1, "abc def", None, None, None, None)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, one, str(tmp_path)).count() == 1


def test_contract():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None

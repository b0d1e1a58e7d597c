"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character 4- and 5-grams of the letters of a
text. From labelled texts come r = log((a + p) / |a + p|) - log((a + q) / |a + q|),
where p and q count the toxic and the other documents with a feature; logistic
regression is trained on features scaled by r, and a score is its probability.

The classifier is fitted on at most SAMPLE_PER_CLASS labelled documents of each
class, the first by a hash of the id, and on no further ones once their texts fill
SAMPLE_BYTES; scoring takes every character of every text.
Only text and label are used: neither lang nor source nor doc_id is a feature.

Defined cases: null and empty texts, and texts without letters, score as no
feature does (the intercept, about the share of toxic documents, at most 0.25).
Null labels, null ids and held-out rows are not learned from. With labels of one
class alone (or none) every score is the share of toxic labels, at most 0.25.
Repeated rows give repeated results and are learned from once; of texts that share
an id the first in the alphabet is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.chargrams import gram_buckets, letter_codes
from corvana.llm.common import bounded_sample, bounded_texts, give_back, held_out, lean

ORDERS = (4, 5)
BITS = 21
SAMPLE_PER_CLASS, SAMPLE_BYTES = 5000, 64 << 20
#: Threshold of `predicted`.
TOXIC_AT = 0.3
#: A feature needs this many training documents and this log-count ratio.
MIN_DOCS, MIN_RATIO = 3, 1.5
SMOOTHING, L2, STEPS, RATE = 1.0, 2e-2, 300, 0.1


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.features] = self.weights
        return table


def present(text: str | None) -> np.ndarray:
    """The distinct features of a text."""
    codes = letter_codes(text or "")
    return np.unique(np.concatenate([gram_buckets(codes, n, BITS) for n in ORDERS]))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = min(0.25, y.mean()) if len(y) else 0.1
        share = max(share, 1e-3)
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), float(np.log(share / (1 - share))))
    size = 1 << BITS
    p, q = np.zeros(size), np.zeros(size)
    rows = []
    for text, label in zip(texts, labels, strict=True):
        rows.append(present(text).astype(np.int32))
        (p if label else q)[rows[-1]] += 1
    ratio = np.log((SMOOTHING + p) / (SMOOTHING + y.sum())) - np.log((SMOOTHING + q) / (SMOOTHING + len(y) - y.sum()))
    chosen = (p + q >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO)
    place = np.full(size, -1, dtype=np.int32)
    features = np.flatnonzero(chosen)
    place[features] = np.arange(len(features))
    r = ratio[features]
    del p, q
    cols = [c[c >= 0] for c in (place[x] for x in rows)]
    del rows
    doc = np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.empty(0, np.int32)
    del cols
    w, b = np.zeros(len(features)), float(np.log(y.mean() / (1 - y.mean())))
    base = b
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(doc, (w * r)[col], minlength=len(y))
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(col, error[doc], minlength=len(features)) * r / len(y) + L2 * w / 10
        grad = np.append(grad, error.mean() + 1e-3 * (b - base))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) * (1 - step / (STEPS + 1))
        w -= move[:-1]
        b -= move[-1]
    return Model(features, (w * r).astype(np.float32), float(min(b, np.log(0.25 / 0.75))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out("doc_id"))
    rows = bounded_texts(docs.select("doc_id", "text"), bounded_sample(marked, "toxic", SAMPLE_PER_CLASS), "toxic", SAMPLE_BYTES)
    texts, marks = [x[2] for x in rows], [x[1] for x in rows]
    del rows
    model = fit(texts, marks)
    del texts
    give_back()
    return model


def score_texts(texts: list[str | None], table: np.ndarray, intercept: float) -> np.ndarray:
    out = np.empty(len(texts))
    for k, text in enumerate(texts):
        codes = letter_codes(text or "")
        hits = []
        for order in ORDERS:
            buckets = gram_buckets(codes, order, BITS)
            hits.append(buckets[np.flatnonzero(table[buckets])])
        out[k] = intercept + float(table[np.unique(np.concatenate(hits))].sum(dtype=np.float64))
    return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and its score; one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for batch in batches:
            scores = score_texts(batch.column(1).to_pylist(), table, model.intercept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below TOXIC_AT, whole and in one pass."""
    text_at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for batch in batches:
            keep = score_texts(batch.column(text_at).to_pylist(), table, model.intercept) < TOXIC_AT
            if not keep.any():  # Spark can not read a batch of strings without a row
                continue
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns], names)

    return docs.mapInArrow(lean(run), docs.schema)

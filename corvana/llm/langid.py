"""Language identification by multilingual mixture inference.

A document is a bag of hashed character trigrams. Each language has a smoothed
trigram distribution learned from labelled texts. Expectation-maximisation finds
the proportions of the languages in a document that make its trigrams likeliest;
the set of languages is chosen by likelihood less a penalty for each language.
The mixture over all languages bounds the likelihood of every set, so that a
document whose best single language comes within the penalty of it is settled at
once; otherwise languages are added greedily while each addition pays for itself.

Distributions are fitted on at most SAMPLE_PER_LANGUAGE whole documents of each
language, the first by a hash of the id, and on no further ones once they fill
SAMPLE_BYTES; languages are those of all learned rows.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
no proportions. Null lang and held-out rows are not learned from. Equal
likelihoods go to the language first in the alphabet. With no labelled row at
all, every document is `und`. Repeated rows give repeated results and are learned
from once; of texts that share id and language the first in the alphabet is.
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

ORDER, BITS = 3, 16
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES = 1500, 32 << 20
SMOOTHING = 0.1
ITERATIONS, TOLERANCE = 40, 1e-4
#: Log-likelihood that a further language must gain, for each log of a trigram count.
PENALTY = 6.0
UNDETERMINED = "und"
#: A pipeline keeps documents whose main language has at least this proportion.
KEEP_AT = 0.4


@dataclass
class Model:
    languages: list[str]
    #: Bucket by language.
    logp: np.ndarray


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram buckets of the letters of a text, and their counts."""
    codes = letter_codes(text or "")
    if len(codes) < ORDER:
        return np.empty(0, dtype=np.uint32), np.empty(0)
    buckets, counts = np.unique(gram_buckets(codes, ORDER, BITS), return_counts=True)
    return buckets, counts.astype(np.float64)


def fit(texts: list[str | None], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    counts = np.full((1 << BITS, len(languages)), SMOOTHING)
    place = {name: k for k, name in enumerate(languages)}
    for text, lang in zip(texts, langs, strict=True):
        buckets, n = trigrams(text)
        counts[buckets, place[lang]] += n
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def train(docs: DataFrame) -> Model:
    marked = docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out("doc_id"))
    rows = bounded_texts(marked, bounded_sample(marked.select("doc_id", "lang"), "lang", SAMPLE_PER_LANGUAGE), "lang", SAMPLE_BYTES)
    texts, names = [x[2] for x in rows], [x[1] for x in rows]
    del rows
    model = fit(texts, names)
    del texts
    give_back()
    return model


def mixture(p: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that maximise the likelihood of the counts, and its logarithm."""
    share, total = start, counts.sum()
    for _ in range(ITERATIONS):
        after = share * (p.T @ (counts / (p @ share))) / total
        moved = np.abs(after - share).max()
        share = after
        if moved < TOLERANCE:
            break
    return share, float(counts @ np.log(p @ share))


def infer(model: Model, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
    """The main language, its proportion, and the chosen languages with theirs."""
    buckets, counts = trigrams(text)
    k = len(model.languages)
    if not len(buckets) or not k:
        return UNDETERMINED, 0.0, []
    logp = model.logp[buckets].astype(np.float64)
    top = logp.max(axis=1, keepdims=True)
    p, shift = np.exp(logp - top), float(counts @ top[:, 0])
    single = counts @ logp
    best = int(np.argmax(single))
    penalty = PENALTY * np.log(counts.sum() + 1.0)
    share, bound = mixture(p, counts, np.full(k, 1.0 / k))
    chosen, value, part = [best], float(single[best]) - shift, np.ones(1)
    while bound - value > penalty and len(chosen) < k:
        tries = []
        for other in range(k):
            if other not in chosen:
                use = [*chosen, other]
                s, v = mixture(p[:, use], counts, np.full(len(use), 1.0 / len(use)))
                tries.append((v, -other, use, s))
        v, _, use, s = max(tries, key=lambda x: x[:2])
        if v - value <= penalty:
            break
        chosen, value, part = use, v, s
    order = sorted(range(len(chosen)), key=lambda i: (-part[i], chosen[i]))
    main = chosen[order[0]]
    score = float(share[main]) if len(chosen) == 1 else float(part[order[0]])
    return model.languages[main], min(1.0, max(0.0, score)), [(model.languages[chosen[i]], float(part[i])) for i in order]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score and the proportions of the chosen languages; one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(model, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.map_(pa.string(), pa.float64()))],
                [id_col, "lang_pred", "score", "proportions"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, lang_pred string, score double, proportions map<string,double>")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions of every row of docs."""
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "proportions")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a language whose proportion is KEEP_AT or more, whole and in one pass.

    A model that learned no language rejects nothing.
    """
    if not model.languages:
        return docs
    text_at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(model, t) for t in batch.column(text_at).to_pylist()]
            keep = [x[0] != UNDETERMINED and x[1] >= KEEP_AT for x in found]
            if not any(keep):  # Spark can not read a batch of strings without a row
                continue
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns], names)

    return docs.mapInArrow(lean(run), docs.schema)

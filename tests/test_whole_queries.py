"""Queries over all that SQL can not follow, against plain Python."""

import re
from datetime import datetime

import pytest

from corvana.plans import rank_queries
from corvana.plans.catalogue import ORACLE, QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    """folder(name, rows, schema): a data folder that holds one table."""

    def make(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def plain_parts(text, budget):
    out, start = [], 0
    while start < len(text):
        end = max(k for k in range(start, len(text) + 1) if len(text[start:k].encode()) <= budget)
        out.append(text[start:end])
        if end == len(text):
            return out
        start = max(start + 1, end - min(32, (end - start) // 8))
    return out


def test_byte_parts_of_all_questions(spark, folder):
    texts = ["plain words " * 20, "é" * 100, "漢字かな" * 40, "a😀" * 50, "short", "x" * 63 + "ü" + "y" * 30, "", None]
    sf = folder("benchmark", list(enumerate(texts)), "item_id long, text string")
    want = {k: (max(len(p.encode()) for p in parts), len(parts)) for k, t in enumerate(texts) if (parts := plain_parts(t or "", 64))}
    got = {r.item_id: (r.most, r.parts) for r in QUERIES["byte_parts"](spark, sf).collect()}
    assert got == want and len(got) == 6 and "byte_parts" not in ORACLE


def test_skill_rank_of_whole_texts_and_question(spark, folder):
    question = "padding " * 12 + "alpha beta gamma delta"
    texts = [question, "nothing of note", "filler " * 50 + "alpha beta", "filler " * 8 + "gamma", "word " * 30 + "alpha beta gamma", "", None]
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(10, question), (20, question)]
    sf = folder("benchmark", rows, "item_id long, text string")

    def tokens(x):
        return set(re.findall(r"[a-z0-9_.-]{3,}", x.lower()))

    asked, want = "use skill-7 and " + question, {}
    for k, t in rows:
        slug, text = f"skill-{k}", t or ""
        score = 10 * len(tokens(asked) & tokens(f"{slug} {text}")) + 20 * (slug in asked)
        if score and k % 10:
            want[slug] = score
    got = {r.slug: r.score for r in QUERIES["skill_rank"](spark, sf).collect()}
    assert got == want and got["skill-3"] == 20 and got["skill-5"] == 30 and got["skill-4"] == 10


def test_best_event_of_every_day(spark, folder):
    rows = [(k, datetime(2024, 1, 1 + k % 9, 12), (k * 7 % 31) / 2, "click") for k in range(60)]
    sf = folder("events", rows, "event_id long, ts timestamp, value double, event_type string")
    want = {}
    for k, ts, value, _ in rows:
        want[f"{ts:%Y-%m-%d}"] = max(want.get(f"{ts:%Y-%m-%d}", (-1.0, -1)), (value, k))
    got = {r.date: r.id for r in QUERIES["best_per_date"](spark, sf).collect()}
    assert got == {d: k for d, (_, k) in want.items()} and len(got) == 9


def test_retrieve_asks_for_all_terms(spark, folder, monkeypatch):
    sf = folder("benchmark", [(1, " ".join(f"term{k}" for k in range(15)))], "item_id long, text string")
    folder("pages", [(1, "http://x.org/en/a", "<p>track</p>")], "page_id long, url string, html string")
    asked, real = [], rank_queries.retrieval.retrieve
    monkeypatch.setattr(rank_queries.retrieval, "retrieve", lambda rows, q, *a, **k: asked.append(q) or real(rows, q, *a, **k))
    QUERIES["retrieve"](spark, sf)
    assert all(f"term{k}" in asked[0].split() for k in range(15))


def plain_score(question, text):
    """Saturated counts of the question's terms, half a point for neighbours, ten times that, half to even."""
    word = r"[A-Za-z0-9_'-]{3,}"
    asked, tokens = re.findall(word, question.lower()), re.findall(word, text.lower())
    names, total = list(dict.fromkeys(asked)), 0.0
    for t in names:
        n = tokens.count(t)
        if n:
            total += (1.15 if len(t) >= 7 else 1.0) * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tokens) / 400))) * min(asked.count(t), 2)
    total += 0.5 * sum(f"{a} {b}" in " ".join(tokens) for a, b in zip(names, names[1:]))
    return round(total * 10) if tokens else 0


def plain_windows(text, size):
    """(start, end, kind, text, base) of windows that step by three quarters and end at a blank line in their second half."""
    if len(text.strip()) <= size:
        return [(0, len(text), "whole-chunk", text.strip(), 10)] if text.strip() else []
    out, at = [], 0
    while at < len(text) and len(out) < 32:
        end = min(len(text), at + size)
        blank = text.rfind("\n\n", at, end)
        end = blank if blank > at + size // 2 else end
        if text[at:end].strip():
            out.append((at, end, "text-window", text[at:end].strip(), 5))
        if end >= len(text):
            return out
        at = max(at + size * 3 // 4, end - size // 4)
    if out and out[-1][1] < len(text):
        out.append((len(text) - size, len(text), "text-window", text[len(text) - size :].strip(), 8))
    return out


def long_texts():
    import random

    rng = random.Random(12)
    make = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma-ray", "delta", "of", "considerable", "x")) + rng.choice(("", "", ".", "\n\n")) for _ in range(n))
    return [make(n) for n in (5, 80, 200, 900, 9000)] + ["", None, " \n ", "alpha " * 20, "* [2024-05-01] a\ntext\n** sub\nmore\n# md\nend"]


def test_windows_of_whole_texts(spark, folder):
    question = "alpha beta considerable gamma-ray alpha"
    folder("benchmark", [(1, question)], "item_id long, text string")
    sf = folder("documents", list(enumerate(long_texts())), "doc_id long, text string")
    want = set()
    for k, t in enumerate(long_texts()):
        ranked = sorted((-(base + plain_score(question, x)), a, b, kind, x) for a, b, kind, x, base in plain_windows(t or "", 600))
        kept, used = [], 0
        for o, a, b, _, x in ranked:
            cost = len(x) + (2 if kept else 0)
            if any(a < d and b > c for c, d in kept) or (kept and used + cost > 1500):
                continue
            kept.append((a, b))
            want.add((k, a, b, float(-o)))
            used += cost
            if len(kept) == 4 or used >= 1500:
                break
    got = {(r.doc_id, r.start, r.end, float(r.score)) for r in QUERIES["evidence_windows"](spark, sf).collect()}
    assert got == want and len({g[0] for g in got}) == 7


def test_evidence_of_whole_texts(spark, folder):
    sf = folder("documents", list(enumerate(long_texts())), "doc_id long, text string")
    got = {(r.doc_id, r.kind): (r.n, r.last) for r in QUERIES["evidence_rows"](spark, sf).collect()}
    for k, t in enumerate(long_texts()[:9]):
        spans_ = plain_windows(t or "", 1200)
        for kind in ("whole-chunk", "text-window"):
            mine = {(a, b) for a, b, x, _, _ in spans_ if x == kind}
            assert got.get((k, kind)) == ((len(mine), max(b for _, b in mine)) if mine else None)
    outline = long_texts()[9]
    # The day's section is its heading's and the whole text's, too: the first of a place stands.
    assert got[9, "org-date"] == (1, len(outline)) and got[9, "org-heading"] == (1, len(outline)) and got[9, "markdown-heading"] == (1, len(outline)) and (9, "whole-chunk") not in got

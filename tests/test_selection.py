"""Spans chosen for a question, excerpts of dates, and files with their chunks, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvana.operators import code, similarity, spans
from corvana.plans import planner, retrieval
from tests.test_whole_queries import plain_score, plain_windows


def plain_heads(text):
    """(start, end, kind, text, base) of sections under headings of up to four levels."""
    out = []
    for kind, pattern in (("org-heading", r"^(\*+)\s+(.*)$"), ("markdown-heading", r"^(#{1,6})\s+(.+)$")):
        heads, at = [], 0
        for line in text.splitlines(keepends=True):
            m = re.match(pattern, line.rstrip())
            if m:
                heads.append((at, len(m[1])))
            at += len(line)
        for k, (a, level) in enumerate(heads):
            b = next((s for s, n in heads[k + 1 :] if n <= level), len(text))
            if level <= 4:
                out.append((a, b, kind, text[a:b].strip(), 80 - 4 * level))
    return out


def plain_dates(text):
    """(start, end, date, text) of dated sections, those within another of their date left out."""
    found = []
    for a, b, kind, x, _ in plain_heads_all(text):
        m = re.search(r"[<\[](\d{4}-\d{2}-\d{2})\b", text[a : text.find("\n", a) if "\n" in text[a:] else len(text)]) or re.search(r"\b(\d{4}-\d{2}-\d{2})\b", text[a : text.find("\n", a) if "\n" in text[a:] else len(text)])
        if m:
            found.append((a, b, m[1], x))
    return [s for s in found if not any(t[2] == s[2] and t != s and t[0] <= s[0] and t[1] >= s[1] and (t[1] - t[0] > s[1] - s[0]) for t in found)]


def plain_heads_all(text):
    heads, at = [], 0
    for line in text.splitlines(keepends=True):
        m = re.match(r"^(\*+)\s+(.*)$", line.rstrip())
        if m:
            heads.append((at, len(m[1])))
        at += len(line)
    return [(a, next((s for s, n in heads[k + 1 :] if n <= level), len(text)), "org", text[a : next((s for s, n in heads[k + 1 :] if n <= level), len(text))].strip(), 0) for k, (a, level) in enumerate(heads)]


def cut(text, limit):
    """The middle of a text cut out, its lines kept."""
    side = max(1, (limit - 5) // 2)
    return text if len(text) <= limit else text[:side].rstrip() + "\n...\n" + text[-max(1, limit - 5 - side) :].lstrip()


def plain_selection(question, text, limit):
    text = (text or "").strip()
    if not text:
        return "", "empty", []
    exact, recent = planner.dates(question), planner.recent_count(question)
    dated = plain_dates(text)
    wanted = set(exact) if exact else set(sorted({d for _, _, d, _ in dated})[-recent:]) if recent else set()
    must = [(a, b, x) for a, b, d, x in dated if d in wanted and x]
    if must:
        total = sum(len(x) for *_, x in must) + 2 * (len(must) - 1)
        share = max(180, (limit - 2 * (len(must) - 1)) // len(must))
        shown = [x if total <= limit else cut(x, share) for *_, x in must]
        return "\n\n".join(s.strip() for s in shown)[:limit].strip(), "date-span", [(a, b) for a, b, _ in must]
    terms = [t for t in dict.fromkeys(re.findall(r"[A-Za-z0-9_'-]{3,}", question.lower())) if len(t) >= 4]
    places = [text.lower().find(t) for t in terms if t in text.lower()]
    a = max(0, min(places) - limit // 3) if places else 0
    b = min(len(text), a + limit)
    a = max(0, b - limit) if b - a < limit else a
    found = [*plain_heads(text), (a, b, "term-window", text[a:b].strip(), 60), *((s, e, k, x, base) for s, e, k, x, base in plain_windows(text, max(240, limit)))]
    once = {}
    for s in found:
        if s[3]:
            once.setdefault((s[0], s[1], s[3][:240]), s)
    kept, used = [], 0
    for _, s, e, _, x in sorted((-(base + plain_score(question, x)), s, e, k, x) for s, e, k, x, base in once.values()):
        if any(s < d and e > c for c, d, _ in kept):
            continue
        if not kept and len(x) > limit:
            kept = [(s, e, cut(x, limit))]
            break
        cost = len(x) + (2 if kept else 0)
        if kept and used + cost > limit:
            continue
        kept.append((s, e, x))
        used += cost
        if used >= limit or len(kept) == 4:
            break
    kept.sort()
    return "\n\n".join(x.strip() for *_, x in kept)[:limit].strip(), "scored-span", [(s, e) for s, e, _ in kept]


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ("alpha", "beta", "gamma-ray", "delta", "of", "considerable", "x")

    def line():
        kind = rng.random()
        day = f"2024-05-{rng.randint(1, 6):02d}"
        if kind < 0.12:
            return "*" * rng.randint(1, 5) + " " + rng.choice(("", f"[{day} Wed] ", f"{day} ")) + rng.choice(words)
        if kind < 0.18:
            return "#" * rng.randint(1, 5) + " " + rng.choice(words)
        return "" if kind < 0.3 else " ".join(rng.choices(words, k=rng.randint(1, 15)))

    return ["\n".join(line() for _ in range(rng.randint(1, 60))) for _ in range(n)] + ["", None, " \n ", "short", "* [2024-05-01] only"]


@pytest.mark.parametrize("question", ["alpha considerable gamma-ray", "what of alpha on 2024-05-02 and 2024-05-04", "last two days of beta", "zzzz"])
def test_selection_like_plain_python(spark, question):
    texts = random_texts(11, 60)
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for limit in (300, 900):
        got = {r.id: (r.x, r.method, [(s["start"], s["end"]) for s in r.spans]) for r in spans.with_selection(frame, "t", question, limit, "x").collect()}
        assert got == {k: plain_selection(question, t, limit) for k, t in enumerate(texts)}
        assert all(len(x) <= limit for x, *_ in got.values())


def test_dated_excerpts(spark):
    text = "* [2024-05-01] one\n" + "alpha " * 100 + "\n* [2024-05-03] three\ngamma\n* [2024-05-02] two\n" + "beta " * 100
    frame = spark.createDataFrame([(text,), ("none",), (None,)], "t string")
    one = lambda *a, **k: [r.x for r in frame.select(spans.dated_excerpt(F.col("t"), *a, **k).alias("x")).collect()]
    assert one(5000, dates=["2024-05-03", "2024-05-02"])[0].startswith("* [2024-05-02] two\nbeta") and one(5000, dates=["2024-05-03"]) == ["* [2024-05-03] three\ngamma", "", ""]
    assert one(5000, recent=1)[0] == "* [2024-05-03] three\ngamma" and one(300, recent=3)[0].count(" ... ") >= 1 and len(one(300, recent=3)[0]) <= 300


def test_files_and_chunks_from_one_scan(spark, tmp_path):
    """Limits of a file hold below the exchange, and the table is read once."""
    rng = random.Random(2)
    rows = [(f"f{k % 12}.org", k, f"summary {'garden' if k % 12 < 5 else 'other'}", " ".join(rng.choices(("garden", "bed", "tree"), k=rng.randint(1, 9)))) for k in range(400)]
    spark.createDataFrame(rows, "path string, chunk int, summary string, content string").write.parquet(f"{tmp_path}/c")
    chunks = spark.read.parquet(f"{tmp_path}/c")
    plan = planner.build_plan("garden news of f3.org")
    out = retrieval.two_level(chunks, plan, 2)
    got = [(r.path, r.chunk, r.place) for r in out.collect()]
    shown = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"Exchange hashpartitioning\(path.*\n.*WindowGroupLimit", shown) and shown.count("FileScan") == 1
    score = lambda t: plain_score("garden news of f3.org", t)
    boost = lambda p: 2500 if p == "f3.org" else 0
    files = sorted({(-(score(f"{p}\n{s}") + boost(p)), p) for p, _, s, _ in rows if score(f"{p}\n{s}") + boost(p) > 0})[: plan.limits.files]
    want = set()
    for _, p in files:
        best = sorted((-(score(f"{q}\n{s}\n{c}") + boost(q)), k) for q, k, s, c in rows if q == p)[:2]
        want |= {(p, k, place) for place, (_, k) in enumerate(best, 1)}
    assert set(got) == want and [r.path for r in retrieval.best_files(chunks, plan).collect()] == [p for _, p in files]


def test_fresh_vectors(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "store_id string, id int")
    stores = spark.createDataFrame([("a", "2024-01-01", "f1"), ("b", "2024-01-02", "f1"), ("c", "2024-01-03", "f2")], "store_id string, created string, fingerprint string")
    pick = lambda f: sorted(r.id for r in retrieval.fresh_vectors(rows, stores, f).collect())
    assert pick("f1") == [2, 3] and pick("f2") == [] and pick("none") == []


def test_plan_handlers_and_explanation():
    asks = lambda q: planner.build_plan(q).handlers[2:]
    assert asks("what happened on 2024-01-02") == () and planner.build_plan("what happened on 2024-01-02").dated
    assert asks("latest news") == () and "temporal" in asks("latest entries of a.org") and planner.explain(planner.build_plan("hello there")) is None
    shown = planner.explain(planner.build_plan("last two entries tagged work in notes/a.org"))
    assert shown["temporal"] == {"mode": "newest-in-named-source", "count": 2, "paths": ["notes/a.org"]} and shown["structural"]["tags"] == ["work"]


def test_a_code_map_is_parsed_once(spark, tmp_path):
    """Search sets of a stored map read it; of rows as they are made, they would parse all sources again for each part."""
    files = spark.createDataFrame([("m.py", "def f():\n    g()\n\ndef g():\n    pass\n"), ("t.py", "def test_f():\n    f()\n")], "path string, content string")
    sets = code.search_sets(code.code_map(files, f"file://{tmp_path}/map"))
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan parquet" in plan
    assert sorted(map(tuple, sets.select("set", "name", "path", "line", "haystack").collect())) == sorted(map(tuple, code.search_sets(code.code_rows(files)).select("set", "name", "path", "line", "haystack").collect()))
    found = {(r.set, r.name) for r in code.query(sets, "test f of t.py", 3).collect()}
    assert ("tests", "test_f") in found


def test_a_word_of_all_rows_can_be_split(spark):
    """Both sides of the join by words are plain exchanges, so that adaptive execution may deal a hot word anew."""
    rng = random.Random(3)
    rows = [(k, ["every", *rng.sample("abcdefghijklmnopqrstuvwxyz", 4)]) for k in range(300)]
    frame = spark.createDataFrame(rows, "id int, words array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = similarity.ranked(frame, similarity.frequencies(frame))
        ranked.collect()
        plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and "HashAggregate" not in plan
        got = {(r.a, r.b) for r in similarity.sharing(frame, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= 4}

"""Main text, benchmark templates and license notices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.llm import dom, licenses, main_text, templates
from corvana.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return main_text.train()


def brute_marginals(model, nodes, feats):
    """Marginals by summing over all assignments."""
    import itertools
    import math

    total, ones = 0.0, [0.0] * len(nodes)
    for xs in itertools.product((0, 1), repeat=len(nodes)):
        value = sum(model.weights.get(f, 0.0) for x, fs in zip(xs, feats) if x for f in fs)
        value += sum(model.pairs["text" if n.tag == "#text" else "element"][xs[n.parent]][x] for x, n in zip(xs[1:], nodes[1:]))
        p = math.exp(value)
        total += p
        for k, x in enumerate(xs):
            ones[k] += p * x
    return [o / total for o in ones]


def test_sum_product_is_exact(model):
    nodes = dom.parse("<div class='content'><p>Some words here.</p><ul><li><a href=x>one</a></li><li>two words</li></ul></div><footer>&copy; x</footer>")
    feats = main_text.features(nodes)
    odds, _, _ = model.marginals(nodes, feats)
    assert np.allclose(1 / (1 + np.exp(-np.array(odds))), brute_marginals(model, nodes, feats), atol=1e-9)


def test_held_out_layouts(model):
    wrong = total = 0
    for page in main_text.layouts(150, seed=977):
        nodes = dom.parse(page)
        main_text._label(nodes)
        odds, _, _ = model.marginals(nodes, main_text.features(nodes))
        for node, x in zip(nodes, odds):
            if node.tag == "#text":
                total += len(node.text)
                wrong += len(node.text) * ((x > 0) != bool(node.label))
    assert wrong / total < 0.06


def test_pages_of_the_table(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    good = 0
    for r in QUERIES["op8_main_text"](spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"<(?:/?p|/?h1|/?b|br)>", article)
        want = " ".join(" ".join(html.unescape(b) for b in blocks).split())
        good += " ".join(r.text.split()) == want
        assert r.n_chars == len(r.text)
    assert good / len(pages) > 0.98


@pytest.mark.parametrize(
    "source, blocks",
    [
        (None, []),
        ("", []),
        ("<p>a<p>b &amp; c<br>d</p>e", ["a", "b & c d", "e"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<script>if (a<b) {'</p>'}</script>ok<style>p{}</style>", ["ok"]),
        ("<!-- <p>no</p> -->yes<!-- open", ["yes"]),
        ("a < b <p title='x>y'>q", ["a < b", "q"]),
        ("<title>t</title><noscript><p>n</p></noscript>v<script>open", ["v"]),
        ("one <b>two</b>\n three<div>four", ["one two three", "four"]),
        ("<p>caf&eacute; &#x1F600;&nbsp;x", ["café 😀 x"]),
    ],
)
def test_dom(source, blocks):
    assert [n.text for n in dom.parse(source) if n.tag == "#text"] == blocks


def test_deep_and_long_pages(model):
    assert main_text.extract(model, "<div>" * 5000 + "x") is not None
    text = main_text.extract(model, "<article>" + "<p>Some words of a sentence here.</p>" * 3000 + "</article>")
    assert len(text) == 3000


def test_main_text_edges(spark, model):
    frame = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<article><p>Text of an article, a whole sentence.</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text.main_text(frame, model).collect()}
    assert rows == {1: ("u", "", 0), 2: (None, "", 0), None: ("u", "Text of an article, a whole sentence.", 37)}
    assert main_text.main_text(frame.limit(0), model).count() == 0


LINE = "This is a paragraph of the article with a whole sentence in it. And a second one follows."


@pytest.mark.parametrize(
    "source",
    [
        "Plain text of a page without a tag.\nIt has two sentences.",
        f"<p>{LINE}</p><p>{LINE}</p>",
        f"<div><p>{LINE}</p><p>{LINE}</p></div>",
        f"<section><p>{LINE}</p><p>{LINE}</p></section>",
        f"<article><h2>A headline</h2><p>{LINE}</p></article>",
        f"<h1>A headline</h1>{LINE}",
    ],
)
def test_fragments_are_articles(model, source):
    blocks = [n.text for n in dom.parse(source) if n.tag == "#text"]
    assert [t for t, _ in main_text.extract(model, source)] == blocks


#: Pages written by hand, apart from the generator: the article's blocks are marked by @.
PAGES = [
    f"""<html><body><header class="site"><a href="/">The Daily</a></header><nav><a href="/a">World</a> <a href="/b">Sport</a></nav>
    <article><header><h1>@A headline of the day</h1></header><p>@{LINE}</p><div class="share">Share this</div><p>@{LINE}</p></article>
    <aside class="related"><h3>Related</h3><ul><li><a href="/x">Another story</a></li></ul></aside><footer>&copy; 2024 The Daily</footer></body></html>""",
    f"""<body><div id="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div><div id="main"><h2>@On rivers</h2>
    <p>@{LINE}</p><blockquote><p>@{LINE}</p></blockquote><ul><li>@first point of the text</li><li>@second point of the text</li></ul></div>
    <div id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with this at all.</p></div></div></body>""",
    f"""<html><head><title>x</title></head><body><div class="wrapper"><div class="menu"><ul><li><a href="1">Home</a></li><li><a href="2">Shop</a></li></ul></div>
    <main class="content"><h1>@Bread</h1><p>@{LINE}</p><form action="/s"><label>Newsletter</label><input><button>Send</button></form><p>@{LINE}</p>
    <figure><img src=x><figcaption>@A loaf of bread on a table</figcaption></figure></main></div><div class="footer"><p>All rights reserved. Contact us.</p></div></body></html>""",
    f"""<html><body><div class="post"><div class="post-content"><p>@{LINE} {LINE}</p><div class="ad">Buy two now and save a lot of money.</div><p>@{LINE}</p></div></div>
    <div class="sidebar"><h4>Popular</h4><p>Ten things that you did not know.</p></div></body></html>""",
]


def test_pages_written_by_hand(model):
    right = wrong = missed = 0
    for page in PAGES:
        want = [n.text[1:] for n in dom.parse(page) if n.tag == "#text" and n.text.startswith("@")]
        got = [t for t, _ in main_text.extract(model, page.replace("@", ""))]
        right += len(set(want) & set(got))
        wrong, missed = wrong + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert wrong == 0 and missed == 0 and right == 11


@pytest.mark.parametrize(
    "source",
    ['<a x="' * 170_000, "<a \"<a '>\" '" * 80_000, "<div>" * 60_000 + "</b></i></ul></p>" * 40_000, "<li><ul>" + "<div><li></li>" * 70_000, "<svg>" * 100_000 + "</math>" * 70_000, "<" * 1_000_000, "<dl>" + "<dt><div>" * 100_000, "<p><b>" * 160_000, "<div></p></section>" * 50_000, "<!--" * 250_000, "<p a" + " " * 1_000_000],
    ids=range(11),
)
def test_hostile_markup_is_read_in_seconds(source):
    """About a megabyte each."""
    import time

    began = time.process_time()
    dom.parse(source)
    assert time.process_time() - began < 15


# Decontamination


def test_leaks_of_the_table(spark):
    """Exactly the items that occur word for word, by substring search."""
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = QUERIES["op5_templates"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.exact for r in got)


ITEM = "Yesterday Alice bought 12 apples and 3 kg of flour from Bob for 20 dollars in total, so how much did each apple cost her?"


def test_templates(spark):
    docs = [
        (1, f"Before it. {ITEM} After it."),
        (2, "Yesterday Carol bought 7 apples and 9 lb of flour from Dave for 33 dollars in total, so how much did each apple cost her?"),
        (3, "Yesterday Carol bought 7 pears and 9 lb of sugar with Dave for 33 dollars at once, thus how much will each pear cost him?"),
        (4, ITEM.upper()),
        (5, None),
        (6, ""),
        (7, ITEM.replace("apples", "green apples")),
        (None, ITEM),
        (8, "so how much did each apple cost her? no more of it"),
        (9, "Name " * 3000),
        (10, (ITEM + " ") * 300),
    ]
    bench = [(1, ITEM), (2, None), (3, ""), (4, "two words"), (5, "one short item here")]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string").withColumn("slots", F.lit("clash")), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(frame, items).collect()}
    assert {k[0] for k in got} == {1, 2, 4, 7, 10} and {k[1] for k in got} == {1}
    assert got[1, 1].exact and got[4, 1].exact and got[10, 1].exact and not got[2, 1].exact and got[10, 1].copies >= 299
    kept = templates.without_leaks(frame, items)
    assert kept.columns == frame.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 5, 6, 8, 9]
    assert templates.leaks(frame.limit(0), items).count() == 0 and templates.leaks(frame, items.limit(0)).count() == 0


def test_inconsistent_slots(spark):
    item = "If Ann gives Ben 5 coins and Ben gives Ann 5 coins back then what does Ann have at the end of the day with Ben"
    docs = [(1, item.replace("Ann", "Eve").replace("Ben", "Max")), (2, "If Eve gives Max 5 coins and Tom gives Zoe 5 coins back then what does Pat have at the end of the day with Kim")]
    got = templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [1]


def test_verbatim_copies_dense_in_slots_or_of_other_case(spark):
    dense = "In 2019 Anna Smith paid 45 dollars, Bob Jones paid 30 euros and Carl Brown paid 12 pounds."
    crowd = "Ann Lee met Ben Cox and Eve Day and Max Fox and Tom Gray then left with Zoe Hill for Rome in May"
    bench = spark.createDataFrame([(1, ITEM), (2, dense), (3, "WHO PAID 12 POUNDS TO BOB JONES"), (4, crowd)], "item_id long, text string")
    changed = dense.replace("45", "77").replace("Anna", "Olga").replace("Brown", "White").replace("30", "99")
    mixed = crowd.replace("in May", "in 7")
    docs = [(1, f"Before it. {dense} After it."), (2, changed), (3, ITEM.title()), (4, dense.lower()), (5, "Then WHO PAID 12 POUNDS TO BOB JONES"), (6, f"a line {dense} {ITEM}"), (7, mixed)]
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 2), (3, 1), (4, 2), (5, 3), (6, 1), (6, 2), (7, 4)}
    assert all(got[k].exact and got[k].coverage == 1.0 for k in got if k != (7, 4)) and got[7, 4].coverage < 1


def test_items_of_one_window_after_a_line_without_an_end(spark):
    bench = [(1, "What is the capital of France?"), (2, "Who was the first king of Norway then?"), (3, "Does every red fox sleep in Oslo?")]
    docs = [(1, "Quiz 3\nWhat is the capital of France?"), (2, "Quiz 3\nWhat is the capital of Spain?"), (3, "a list\nWho was the first king of Sweden then?"), (4, "asked Does every red fox sleep in Rome?"), (5, "asked does every red fox sleep in Rome?"), (6, "asked Is every red fox asleep in Rome?")]
    got = templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.exact) for r in got} == {(1, 1, True), (2, 1, False), (3, 2, False), (4, 3, False), (5, 3, False)}


def test_unchanged_windows_of_an_inconsistent_copy_count(spark):
    item = "The old clerk of the harbour office writes down every ship that comes in before dawn, then Ann tells Ben and Ann goes to the market"
    docs = [(1, item.replace("Ann tells", "Eve tells").replace("Ann goes", "Pat goes"))]
    (got,) = templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert 0.6 <= got.coverage < 1 and not got.exact


def test_slots_of_other_languages(spark):
    bench = [(1, "Wenn sie gestern zwölf rote und drei grüne davon gekauft und dafür zwanzig Euro bezahlt hat, wie viel hat sie dann noch übrig"), (2, "Ayer compró Luis cinco libras de pan y ocho litros de agua en la tienda nueva de la calle mayor")]
    docs = [(1, "Wenn sie gestern sieben rote und neun grüne davon gekauft und dafür 31 Euro bezahlt hat, wie viel hat sie dann noch übrig"), (2, "Ayer compró Pablo 7 kilos de pan y nueve litros de agua en la tienda nueva de la calle mayor"), (3, "nichts davon")]
    got = templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.exact) for r in got} == {(1, 1, False), (2, 2, False)}


def test_repeated_rows_and_hot_windows(spark):
    """Repeated rows of a document count once; a window that thousands of rows share meets each once."""
    rows = [(k % 3, f"Before it. {ITEM} After it.") for k in range(900)] + [(100 + k, f"{ITEM} {k}") for k in range(600)]
    got = templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, *range(100, 700)] and all(r.copies == 1 and r.exact for r in got)


def test_many_documents_in_one_pass_keep_apart():
    texts = ["a b c d", "e f g h", "", "i j k l m n o p q"]
    owner, code, own, slot = templates.canonical(texts)
    at, _ = templates.windows(owner, code, slot, 4)
    assert owner[at].tolist() == [0, 1] + [3] * 6


# Licenses


@pytest.fixture(scope="module")
def library():
    return licenses.Library.of(licenses.TEMPLATES)


def test_each_template_is_found_alone(library):
    for name, text in licenses.TEMPLATES.items():
        found = licenses.scan_texts(library, [f"Words before it. {text} And words after."])[0]
        assert [f[0] for f in found] == [name] and found[0][2] == 1.0


def test_whole_texts_and_neighbours(library):
    """A whole license is one match, not its first sentence; a notice that differs in a word has its own name."""
    whole = "Copyright 2024 X. " + licenses.TEMPLATES["MIT-text"].replace(". ", ".\n\n * ") + " end"
    assert [f[0] for f in licenses.scan_texts(library, [whole])[0]] == ["MIT-text"]
    both = licenses.TEMPLATES["BSD-3-Clause-text"] + " " + licenses.TEMPLATES["BSD-disclaimer"]
    assert [f[0] for f in licenses.scan_texts(library, [both])[0]] == ["BSD-3-Clause-text", "BSD-disclaimer"]
    for name in ("AGPL-3.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1"):
        assert [f[0] for f in licenses.scan_texts(library, [f"x. {licenses.TEMPLATES[name]}."])[0]] == [name]


def test_spans_and_edits(library):
    text = "é x. Licensed under the Apache Licence, Version 2.0. y. Released under the MIT License."
    found = licenses.scan_texts(library, [text])[0]
    assert [(f[0], text[f[3] : f[4]]) for f in found] == [("Apache-2.0", "Licensed under the Apache Licence, Version 2.0."), ("MIT-statement", "Released under the MIT License.")]
    words = licenses.TEMPLATES["MIT"].split()
    assert licenses.scan_texts(library, [" ".join(words[:10])])[0] == []
    assert [f[0] for f in licenses.scan_texts(library, [" ".join(words[:12] + ["really"] + words[12:])])[0]] == ["MIT"]


def brute_align(template, text):
    best = (0, 0)
    h = [[(0, 0)] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i, a in enumerate(template, 1):
        for j, b in enumerate(text, 1):
            s, n = h[i - 1][j - 1]
            cell = (s + licenses.MATCH, n + 1) if a == b else (s + licenses.MISS, n)
            for s, n in (h[i - 1][j], h[i][j - 1]):
                if s + licenses.GAP > cell[0]:
                    cell = (s + licenses.GAP, n)
            h[i][j] = cell if cell[0] > 0 else (0, 0)
            best = max(best, h[i][j])
    return best[1]


def test_band_loses_nothing_near_the_diagonal():
    rng = random.Random(3)
    for _ in range(60):
        template = [rng.randrange(40) for _ in range(14)]
        text = template[:]
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randrange(len(text)), 99)
        got = licenses.align(np.array(template, dtype=np.uint64), np.array(text, dtype=np.uint64), 0)
        assert got[0] == brute_align(template, text)


def test_winnow_guarantee():
    rng = np.random.default_rng(5)
    for _ in range(100):
        h = rng.integers(0, 9, rng.integers(1, 30)).astype(np.uint64)
        at = licenses.winnow(h, 4)
        assert all(any(k <= p < k + 4 for p in at) for k in range(max(1, len(h) - 3)) if len(h) >= 4) and len(at)


def test_license_query(spark):
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d for d, t in docs.items() if re.search("(?i)licensed under|released under", t)}
    rows = QUERIES["op6_licenses"](spark, SF).collect()
    assert {r.doc_id for r in rows} == want
    assert all(re.search("(?i)licen|released", docs[r.doc_id][r.start : r.end]) for r in rows)


def test_license_edges(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (None, "Released under the MIT License."), (3, "Released under the MIT License. " * 500), (3, "x " * 60000)], "doc_id long, text string").withColumn("license", F.lit("clash"))
    rows = licenses.licenses(frame).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0] + [3] * 500
    assert licenses.licenses(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Library.of({"x": "two words"})


L1 = "The city council voted on Tuesday to close the old bridge for two months while workers repair its pillars."
L2 = "Drivers will have to use the tunnel instead, which is expected to be crowded in the mornings."
S1, S2, H = "It rained all day.", "Nobody came.", "Old bridge to close for repairs"
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
ART = f"<h1>@{H}</h1><p>@{L1}</p><p>@{L2}</p>"
#: Pages whose class names say nothing or are unknown to the generator; the whole article and nothing else.
STRANGE_PAGES = [
    f'<html><body><div class="flex px-4 grow">{ART}</div></body></html>',
    f'<html><body><header class="p-3"><a href="/">Logo</a></header><div class="container"><div class="row"><div class="col-md-8">{ART}</div><div class="col-md-4"><h4>Most read</h4>{NAV}</div></div></div></body></html>',
    f'<html><body><div class="post">{ART}</div></body></html>',
    f'<html><body><div class="post"><p>@{S1}</p><p>@{S2}</p></div></body></html>',
    f'<html><body>{ART}</body></html>',
    f'<html><body><table><tr><td><a href="/">Home</a></td><td><a href="/n">News</a></td><td><a href="/s">Sport</a></td></tr></table><div class="x1">{ART}</div></body></html>',
    f'<html><body><article>{ART}<p hidden>This paragraph is hidden from all readers of the page.</p></article></body></html>',
    f'<html><body><article>{ART}<div style="display: none"><p>Loading the next story, please wait a moment.</p></div></article></body></html>',
    f'<html><body><div class="k">{ART}</div><div>Copyright 2024 Example</div></body></html>',
    f'<html><body><div id="zq81"><div class="q7"><div class="b">{ART}</div></div></div></body></html>',
    f'<html><body><div class="w-full max-w-xl mx-auto">{ART}<blockquote><p>@{L2}</p></blockquote></div><footer>&copy; 2024 The Daily</footer></body></html>',
    f'<html><body><nav class="d-flex gap-2">{NAV}</nav><div class="td-pb-span8">{ART}<h2>@What comes next</h2><p>@{L1}</p></div></body></html>',
    f'<html><body><div class="c-page"><div class="c-page__in">{ART}</div></div><div id="comments"><h3>3 comments</h3><div class="comment"><p>I do not believe a word of this.</p></div></div></body></html>',
    f'<html><body><div class="u-full"><section class="grid">{ART}<ul><li>@The bridge closes on May 2.</li><li>@It opens again on July 1.</li></ul></section></div></body></html>',
    f'<html><body><div class="site"><div class="top"><a href="/">Home</a> <a href="/a">About</a> <a href="/c">Contact</a></div><div class="yy2">{ART}</div></div></body></html>',
    f'<html><body><main class="px-4"><div class="qq">{ART}</div></main><aside><h3>Related</h3><ul><li><a href="/1">A tunnel story</a></li><li><a href="/2">Bridges of the world</a></li></ul></aside></body></html>',
    f'<html><body><div class="sc-1f2"><div class="sc-88a"><h1>@{H}</h1><div class="sc-2b"><p>@{L1}</p><p>@{L2} {L1}</p><p>@{S1}</p></div></div></div></body></html>',
    f'<html><body><form action="/q"><label>Search</label><input name="q"><button>Go</button></form><div class="r3">{ART}</div></body></html>',
    f'<html><body><div class="cookie-bar flex"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class="flex">{ART}</div></body></html>',
    f'<html><body><div class="hp-2"><div class="entry mt-3 mb-6">{ART}<p>@{L2}</p></div><div class="sidebar bg-white"><h4>Popular</h4>{NAV}</div></div></body></html>',
    f'<html><body><div><div><div><div><div>{ART}</div></div></div></div></div></body></html>',
    f'<html><body><section class="l-stack"><h1>@{H}</h1><p>@{S1}</p><p>@{L1}</p><pre>@make repair</pre><p>@{S2}</p></section></body></html>',
    f'<html><body><div class="nn1">{ART}<figure><img src="b.jpg"><figcaption>@The bridge in spring, seen from the south.</figcaption></figure><p>@{L2}</p></div></body></html>',
    f'<html><body><div class="box">{ART}</div><div class="box"><h3>Newsletter</h3><form><label>Your address</label><input><button>Sign up</button></form></div></body></html>',
    f'<html><body><div class="ad-slot">Buy two and save a lot of money today.</div><div class="zz9">{ART}</div><footer class="py-2"><p>Contact us. All rights reserved.</p></footer></body></html>',
    f'<html><body><div class="outer"><div class="inner"><p>@{L1}</p><p>@{L2}</p><p>@{L1} {L2}</p></div></div></body></html>',
    f'<html><body><article class="mt-3"><header><h1>@{H}</h1></header><p>@{L1}</p><div class="share">Share this</div><p>@{L2}</p></article><div style="display:none">Tracking text that nobody sees at all.</div></body></html>',
    f'<html><body><div class="m-9"><table><tr><td><a href="/1">One</a></td></tr><tr><td><a href="/2">Two</a></td></tr><tr><td><a href="/3">Three</a></td></tr></table></div><div class="m-10">{ART}</div></body></html>',
    f'<html><body><div class="root"><div class="lead"><h1>@{H}</h1></div><div class="rest"><p>@{L1}</p><p>@{L2}</p></div></div><div class="bottom-x">&copy; 2023 Somebody</div></body></html>',
]


@pytest.mark.parametrize("page", STRANGE_PAGES)
def test_pages_with_names_nobody_has_met(model, page):
    want = [n.text[1:] for n in dom.parse(page) if n.tag == "#text" and n.text.startswith("@")]
    assert [t for t, _ in main_text.extract(model, page.replace("@", ""))] == want


def test_held_out_families_of_layouts():
    """A family that training has not seen: articles in boxes without names, in wrappers, with side boxes of prose links."""
    family = lambda page: "<article" not in page and "<main" not in page
    pages = main_text.layouts(700, seed=5)
    model = main_text.train([p for p in pages if not family(p)])
    right = found = there = 0
    for page in filter(family, main_text.layouts(250, seed=6)):
        nodes = dom.parse(page)
        main_text._label(nodes)
        odds, _, _ = model.marginals(nodes, main_text.features(nodes))
        for node, x in zip(nodes, odds, strict=True):
            if node.tag == "#text":
                n = len(node.text)
                right, found, there = right + n * (x > 0 and node.label), found + n * (x > 0), there + n * bool(node.label)
    assert 2 * right / (found + there) > 0.95


def test_the_model_is_fitted_once():
    assert main_text.trained() is main_text.trained()

import re
from collections import Counter

import numpy as np
import pytest
from oracle import SF, check
from pyspark.sql import functions as F

from strandline.llm import main_text, multi_index, queries_search
from strandline.llm.boosting import BoostedTrees
from strandline.plans.runtime import table


def test_search_equals_sql(spark):
    check(spark, "op10", queries_search.op10_multi_index, queries_search.MULTI_INDEX_SQL)


@pytest.mark.parametrize("k", [3, 500])
def test_search_equals_brute_force(spark, k):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(size=64) * (i % 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [None] * 64), (304, [1.0, -1.0]), (None, rows[1][1]), rows[0]]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, codes string, block string")
    got: dict = {}
    for r in multi_index.top_k(frame, F.col("vec_id") % 50 == 0, k=k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    codes = [(i, [(j < len(v) and v[j] > 0) for j in range(64)]) for i, v in rows if i is not None and v is not None and None not in v]
    for q, code in dict(codes).items():
        if q % 50 == 0:
            near = sorted((sum(a != b for a, b in zip(code, c, strict=True)), i) for i, c in codes if i != q)[:k]
            assert sorted(got[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(near)]
    assert multi_index.top_k(frame.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("part_codes", [1, 4096])
def test_crowded_ids_and_hot_values(spark, monkeypatch, part_codes):
    """Ids with many codes, one of which asks, and a segment value that most codes share."""
    monkeypatch.setattr(multi_index, "PART_CODES", part_codes)
    rng = np.random.default_rng(8)

    def near(n):
        v = np.where(np.arange(64) < 16, 1.0, -1.0)
        v[16 + rng.choice(48, n, replace=False)] *= -1
        return v.tolist()

    rows = [(i, near(i % 9)) for i in range(120)] + [(7, near(i % 7)) for i in range(40)] + [(50, near(i % 4)) for i in range(12)] + [(51, near(0))] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    k = 3
    got = Counter((r["query_id"], r["rank"], r["distance"], r["id"]) for r in multi_index.top_k(frame, F.col("vec_id") % 50 == 0, k=k).collect())
    signs = [(i, np.array(v) > 0) for i, v in rows]
    want = Counter()
    for q, code in {(i, tuple(c)) for i, c in signs if i % 50 == 0}:
        best = sorted((int((c != np.array(code)).sum()), i) for i, c in signs if i != q)[:k]
        want.update((q, n + 1, d, i) for n, (d, i) in enumerate(best))
    assert got == want


def test_radius_stops_when_covered(spark):
    def row(i, bits):
        return i, [1.0 if b in bits else -1.0 for b in range(64)]

    rows = [row(0, []), row(1, [0]), row(2, [0, 1]), row(3, [16]), row(4, range(64)), *[row(10 + i, range(i, 64)) for i in range(1, 20)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.top_k(frame, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(1, 1), (3, 1), (2, 2)]
    assert {r["radius"] for r in got} == {0}  # the last of four, one of them its own, is at distance 2, below 4
    with pytest.raises(Exception, match="64 components"):
        multi_index.top_k(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def article(html):
    """The blocks of the article element of the table's own plain pages."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)
    if not inner:
        return None
    import html as h

    blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner[1])]
    return "\n".join(b for b in blocks if b)


def test_pages_equal_their_articles(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in queries_search.op5_main_text(spark, SF).collect():
        if (want := article(pages[r["page_id"]])) is not None:
            assert r["text"] == want and r["n_chars"] == len(want)


def test_trees_on_unseen_layouts():
    model, right, n = main_text.train(n_pages=300), 0, 0
    for source, main in main_text.training_pages(150, seed=77):
        page = main_text.Page(source)
        right += main_text.extract([source], model)[0].split("\n") == [t for t in page.text if t in main]
        n += 1
    assert right / n > 0.9


def test_decoding_never_contradicts():
    model = main_text.train(n_pages=60, n_trees=8)
    for source, _ in main_text.training_pages(30, seed=5):
        page = main_text.Page(source)
        label = main_text.decode(page, model.score(main_text.features([page])).tolist())
        assert all(label[p] or not label[i] for i, p in enumerate(page.parent) if i)


def test_decoding_is_the_best_labelling():
    page = main_text.Page("<div><p>a</p><p>b</p></div><ul><li>c</li></ul>")
    rng, n = np.random.default_rng(3), len(page.parent)
    for _ in range(20):
        score = rng.normal(size=n).tolist()

        def value(label, score=score):
            return sum(s for s, ok in zip(score, label, strict=True) if ok) - sum(label[i] != label[page.parent[i]] for i in range(1, n))

        allowed = [[True, *(bool(m >> i & 1) for i in range(n - 1))] for m in range(1 << (n - 1))]
        allowed = [x for x in allowed if all(x[page.parent[i]] or not x[i] for i in range(1, n))]
        assert value(main_text.decode(page, score)) == pytest.approx(max(map(value, allowed)))


def test_tolerant_reading():
    def texts(source):
        return [t for t in main_text.Page(source).text if t]

    assert texts("<p>a<p>b<b>c<br>d<p>e &amp; f &#233;&nbsp;g") == ["a", "bc d", "e & f é g"]
    assert texts("<script>var a = '<p>x</p>';</script><!-- <p>y</p> --><style>p{}</style>z") == ["z"]
    assert texts("<ul><li>a<li>b</ul></div></b>c <p title='1 > 2'>d</p><p unfinished") == ["a", "b", "c", "d"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<a href=x>l</a>") == ["l"]


@pytest.mark.parametrize("tag", sorted(main_text.RAW - main_text.CODE))
def test_elements_without_end_tag_lose_nothing(tag):
    def texts(source):
        return [t for t in main_text.Page(source).text if t]

    assert texts(f"<div><{tag} id=x></div><article><p>a</p></article>") == ["a"]
    assert texts(f"<{tag} src='x' /><p>a</p><{tag}/><p>b</p><{tag}>no</{tag}>c") == ["a", "b", "c"]
    assert texts(f"<{tag}>no</{tag}><p>a</p><{tag} x='/'>no</{tag} >b") == ["a", "b"]
    if tag not in main_text.LITERAL:
        assert texts(f"<p>a</p><{tag}><p>b</p><{tag}>no</{tag}>c") == ["a", "b", "c"]
        assert texts(f"<{tag}>no<{tag}>no</{tag}><b>no</{tag}>a<script>'<{tag}>'</script>b") == ["a b"]


def test_references_are_decoded_by_run_and_reading_is_linear():
    def texts(source):
        return [t for t in main_text.Page(source).text if t]

    import time

    assert texts("&am<b>p;lt</b>") == ["&amp;lt"] and texts("a &lt;b&gt; &amp;amp;") == ["a <b> &amp;"]
    assert texts("<p><b>a<i>b</b>c</i>d</p>") == ["abcd"] and texts("<p><a>x</p></a><p>y</p></b>") == ["x", "y"]
    start = time.thread_time()
    texts("<b>x" * 40_000 + "</i>" * 40_000)
    texts("<i>" * 20_000 + "<b>" * 20_000 + "</i>" * 20_000)
    texts("<b>" * 20_000 + "<li>x" * 20_000 + "<div>" * 5_000 + "</p>" * 20_000)
    assert time.thread_time() - start < 20


#: Pages as they are found, written by hand, without use of the lists of tokens: (html, words of the main text, words of the rest)
LABELLED = [
    ("""<!doctype html><html><head><title>T</title><style>.x{}</style></head><body class=pg><div id=hd><a href=/>Gazette</a> <a href=/a>World</a> <a href=/b>Sport</a></div>
    <div id=wrapper><div class=col1><h1>River levels fall after dry spring</h1><p>Levels in the upper valley have dropped by a third since March, according to the water board, which measures them each week.</p>
    <p>Farmers said on Monday that they had begun to take water from wells, something that has not been necessary for twenty years.</p></div>
    <div class=col2><ul><li><a href=1>Top stories</a><li><a href=2>Weather tomorrow</a><li><a href=3>Puzzle of the day</a></ul></div></div><div id=ft>Gazette Ltd. All rights reserved</div></body></html>""",
     "River levels fall valley water board Farmers wells twenty years", "Sport Top stories Puzzle rights reserved"),
    ("""<body><nav><ul><li><a href=x>Start</a><li><a href=y>Blog</a></ul></nav><main><article><header><h1>How I repaired a clock</h1></header><p>The spring was broken, and two teeth of the second wheel were bent.</p>
    <blockquote>Never force a wheel, my teacher used to say.</blockquote><p>I made a new spring from an old one and filed the teeth until they ran freely again.</p><ul><li>file</li><li>tweezers</li></ul></article>
    <section id=respond><h3>3 thoughts</h3><div><b>Ann</b><p>Great post, thank you so much for sharing it with us!</p></div></section></main><footer>Powered by nothing</footer></body>""",
     "repaired clock spring broken teeth teacher filed freely tweezers", "Start Blog thoughts Great sharing Powered"),
    ("""<body><div class="cookie-bar">We use cookies to give you the best experience. <button>Accept</button></div><div class=top><form action=/s><input name=q><label>Find</label></form></div>
    <section class=story><h2>Council votes for new bridge</h2><p>With nine votes to four the council decided on Tuesday to build a second bridge over the canal.</p><p>Work is to begin next year and to take eighteen months, the mayor said after the vote.</p></section>
    <aside><h4>More from this town</h4><a href=1>School opens new wing</a> <a href=2>Market moves to the square</a></aside></body>""",
     "Council votes bridge canal eighteen months mayor", "cookies experience Find School wing Market"),
    ("""<html><body><table><tr><td><a href=1>Home</a><br><a href=2>Products</a><br><a href=3>Contact</a></td><td><h1>Care of wooden floors</h1>Sweep the floor once a week with a soft broom. Do not use much water, since wood swells when it gets wet.
    <p>Twice a year the floor should be oiled. Let the oil dry for a night before you walk on it again.</p></td></tr></table></body></html>""",
     "Care wooden floors Sweep broom swells oiled night walk", "Products Contact"),
]


def test_pages_written_by_hand():
    model, right, n = main_text.train(), 0, 0
    for source, main, rest in LABELLED:
        words = set(main_text.extract([source], model)[0].replace(".", " ").replace(",", " ").split())
        marks = [w in words for w in main.split()] + [w not in words for w in rest.split()]
        right, n = right + sum(marks), n + len(marks)
    print("words rightly kept or left out:", right, "of", n)
    assert right / n > 0.8


def test_values_of_any_length():
    def texts(source):
        return [t for t in main_text.Page(source).text if t]

    for quote, n in (("'", 3000), ("'", 5000), ('"', 200_000)):
        value = "x" * n + "<p>leak</p>" + ("'" if quote == '"' else '"') + ">"
        assert texts(f"<p data-x={quote}{value}{quote}>a</p>b") == ["a", "b"]
    assert texts('<p title="a>b</p>c') == ["b", "c"] and texts("<p 5\" tall>b</p>c <i x=\"1\">d") == ["b", "c d"]
    assert texts("<script src=x /><p>a</p>") == ["a"] and texts("<p>a</p><script>var p = '<p>b</p>'") == ["a"]
    assert len(texts("<button>a" * 20_000)) == 20_000 and texts("<title>a" * 20_000) == [" ".join("a" * 20_000)]


def test_tokens_do_not_depend_on_what_was_seen(monkeypatch):
    tokens = ["sidebarleft", "commentlist", "sidebar" + "x" * 50, "nothing", "ad"]
    before = [main_text._token_bits(t) for t in tokens]
    monkeypatch.setattr(main_text, "REMEMBERED", 0)
    for k in range(50):
        assert main_text._token_bits(f"footer{'qz' * k}") == main_text._TOKEN_BIT["footer"]
    monkeypatch.setattr(main_text, "_TOKEN_BIT", {t: main_text._TOKEN_BIT[t] for g in main_text.TOKEN_GROUPS for t in g.split()})
    assert [main_text._token_bits(t) for t in tokens] == before
    assert before[:2] == [main_text._TOKEN_BIT["sidebar"], main_text._TOKEN_BIT["comment"]] and before[3] == 0


def test_odd_pages(spark):
    long = "<article>" + "<p>word and more words.</p>" * 20_000 + "</article>"
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, "<" * 5000, "x"), (5, long, "x"), (5, long, "x")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in main_text.main_text(frame, keep=["page_id", "text"], n_pages=100).collect()]
    by_id = dict(got)
    assert len(got) == 6 and by_id[1] == by_id[2] == "" and by_id[5].count("\n") == 19_999
    assert main_text.main_text(frame.limit(0), n_pages=20).count() == 0


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = BoostedTrees(30, 3).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.95

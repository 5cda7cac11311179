import base64
import hashlib
import random
import time

import numpy as np
import pytest

from gondola.llm import metric_tree, templates, warc
from gondola.llm.metric_tree import Settings
from gondola.session import scratch_path

ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body class="page">
<div id="header"><a href="/">Site</a></div>
<nav><ul><li>Home</li><li>News</li></ul></nav>
<div class="sidebar"><p>Side words</p></div>
<article><header><h1>Title &amp; more</h1></header><p>One   two<br>three <b>four</b>
<p>Five<ul><li>six<li>seven</ul><div class="share-buttons">Share!</div>
<div class="ad">Buy</div><aside>aside</aside><form><p>mail<input></form>
<script>var a = "</p>";</script><!-- gone --></article>
<section id="comments"><article class="comment"><p>a long reader comment, longer than the article itself, so it seems</p></article></section>
<footer>&copy; us</footer></body></html>"""


def test_main_text_of_an_article():
    assert templates.main_text(ARTICLE) == "Title & more\n\nOne two three four\n\nFive\n\nsix\n\nseven"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<p>a<p>b", "a\n\nb"),
        ("<<p>x", "<\n\nx"),
        ("<p>cut off <b", "cut off <b"),
        ("<script>never ends", ""),
        ("<div hidden>no</div><div style='display: none'>no</div><p>yes</p>", "yes"),
        ("<main><p>m</p></main><p>out</p>", "m"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ],
)
def test_odd_markup(page, text):
    assert templates.main_text(page) == text


def test_very_deep_pages_are_read():
    assert templates.main_text("<div>" * 20_000 + "deep") == "deep"


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000, '<a "' * 250_000 + "'>", "<a" * 500_000 + ' ">', "<a " * 300_000 + '">',
     "<div>" * 100_000 + "</span>" * 70_000, "<b>" * 100_000 + "<div></div>" * 60_000,
     "<ul><li><ul>" + "<b>" * 100_000 + "<li></li>" * 60_000, "<table><tr><td>" * 60_000, "<article>" * 100_000,
     "<div>" * 60_000 + "<article>" * 60_000],
)
def test_hostile_pages_take_time_in_proportion(page):
    def seconds(text):
        began = time.thread_time()
        templates.main_text(text, frozenset({1}))
        return time.thread_time() - began

    assert seconds(page) < 20 * max(0.05, seconds(page[: len(page) // 8]))


def menus(k, body):
    """A page without article, main, class or id: only what recurs tells the menu from the text."""
    links = "".join(f"<li><a href='/{n}'>section {n}</a></li>" for n in range(4))
    return f"<body><div><ul>{links}</ul></div><div><p>{body}</p></div><div><p>All of this is ours</p></div></body>"


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_templates_decide_where_no_tag_does(spark, bound):
    """The result changes with the template step, is the same by broadcast and by join, and for any order of rows."""
    rows = [(k, f"http://h{k % 3}/{k}", menus(k, f"own words of {k}")) for k in range(60)]
    # copies of one text with other surroundings: which of them counts must not depend on the order
    rows += [(100 + k, "http://h0/c", menus(0, "a copied text").replace("All", f"All{k}")) for k in range(5)]
    settings = templates.Settings(broadcast_bytes=bound)

    def run(rows, parts, settings=settings):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        return {r.page_id: r.text for r in templates.extract(pages, settings).collect()}

    found = run(rows, 1)
    assert all(found[k] == f"own words of {k}" for k in range(60))
    without = run(rows, 1, templates.Settings(min_pages=10_000, broadcast_bytes=bound))
    assert "section 0" in without[0] and "All of this is ours" in without[0]
    assert run(rows[::-1], 7) == found


def test_templates_are_found_by_host(spark):
    def page(k, body):
        return f"<body><div><p>Welcome to our site</p><a>menu</a></div><div>{body}</div><div>Imprint {k % 2}</div></body>"

    rows = [(k, f"https://User@Site.example:80/{k}", page(k, f"<p>own words {k}</p>"), "x") for k in range(12)]
    rows += [(100, "https://other.example/", page(0, "<p>alone</p>"), "x"), (101, None, None, None), (102, "no host", "<p>y</p>", None)]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = {r.page_id: r for r in templates.extract(pages, templates.Settings(min_pages=3)).collect()}
    assert templates.extract(pages).count() == len(rows)
    assert all(out[k].text == f"own words {k}" for k in range(12))
    assert out[100].text == "Welcome to our site menu\n\nalone\n\nImprint 0" or "Welcome to our site" in out[100].text
    assert (out[101].text, out[102].text) == ("", "y")
    assert templates.extract(pages.limit(0)).collect() == []


def test_article_sentences_that_recur_stay(spark):
    rows = [(k, "http://h/", f"<article><p>We say this each time.</p><p>news {k}</p></article><p>foot</p>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in templates.extract(pages).collect()} == {f"We say this each time.\n\nnews {k}" for k in range(9)}


@pytest.mark.parametrize(
    "body",
    [
        "<div><article><p>own words</p><p>more</p></article></div>",
        "<article><div>own words</div><section>more</section></article>",
        "<div class='a'><div><p>own words</p></div><ul><li>more</li></ul></div>",
    ],
)
def test_copies_of_a_page_count_once(spark, body):
    rows = [(k, "http://h/", f"<head><title>{k // 3}</title></head><body><p>menu</p><div>{body}</div></body>") for k in range(6)]
    rows += [(100 + k, "http://h/", f"<body><p>menu</p><article><p>page {k}</p></article></body>") for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in templates.extract(pages).collect()}
    assert {out[k] for k in range(6)} == {"own words\n\nmore"}
    assert [out[100 + k] for k in range(4)] == [f"page {k}" for k in range(4)]


def test_a_template_around_the_only_article():
    page = "<body><p>menu</p><div><article><p>own</p></article></div></body>"
    root = templates.parse(page)
    templates.hash_subtrees(root)
    every = frozenset(e.hash for e in templates.elements(root))
    assert templates.main_text(page, every) == "own"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>part one, longer</p></article><hr><article><p>part two</p></article>", "part one, longer\n\npart two"),
        ("<main><p>one</p></main><main><p>second</p></main>", "one\n\nsecond"),
        ("<article><p>a</p><article><p>inner</p></article></article><article>b</article>", "a\n\ninner\n\nb"),
        ("<div class='has-sidebar'><article><p>own</p></article></div>", "own"),
        ("<div id='page-with-nav'><article><p>own</p></article></div>", "own"),
        ("<div class='sidebar-left'><h2>Site</h2><article><p>own words</p></article></div>", "own words"),
        ("<div id='page' class='comments-open'><article><p>own</p></article></div>", "own"),
        ("<form><div><article><p>own</p></article></div><input></form>", "own"),
        ("<form><main><p>own</p></main></form>", "own"),
        ("<p>the words of a page</p><div class='comments'><article><p>reader</p></article></div>", "the words of a page"),
        ("<article><p>own</p></article><div class='related'><article><p>other</p></article></div>", "own"),
        ("<article><p>own</p></article><aside><article><p>other</p></article></aside>", "own"),
        ("<div hidden><article><p>no</p></article></div><p>yes</p>", "yes"),
    ],
)
def test_every_live_article_whatever_its_wrapper_is_called(page, text):
    assert templates.main_text(f"<body>{page}</body>") == text


def brute_top(vectors, scale, k, queries):
    whole = {i: np.floor(np.array(v, float) * scale).astype(int) for i, v in vectors.items()}
    out = []
    for q in queries:
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    clouds = draw.normal(size=(5, 8))
    vectors = {i: (clouds[i % 5] + 0.02 * draw.normal(size=8) if i % 3 else draw.normal(size=8)).tolist() for i in range(900)}
    vectors |= {1000 + i: vectors[0] for i in range(50)}  # ties
    vectors |= {2000: [0.0] * 8, 2001: [9.0] * 8}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(5)
    whole = metric_tree.whole_vectors(rows, 1024)
    index = metric_tree.build_index(whole, Settings(pivots=4, tree_rows=100, page=8))
    found = metric_tree.top_k(index, whole.where("id % 50 = 0"), 10).collect()
    queries = [i for i in vectors if i % 50 == 0]
    assert sorted(map(tuple, found)) == brute_top(vectors, 1024, 10, queries)


def test_pruning_saves_distances():
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(size=(200, 4)) * 0.01 + c for c in draw.normal(size=(20, 4)) * 10])
    whole = np.floor(points * 1024).astype(np.int64)
    matrix = metric_tree._lifted(whole, float((whole**2).sum(axis=1).max()))
    root = metric_tree.build(matrix, np.arange(len(whole)), 16, draw)
    pages = [metric_tree.load_page(p) for p in metric_tree.pages_of(root, matrix, np.arange(len(whole)))]
    opened = []

    class Spy(list):
        def __getitem__(self, number):
            opened.append(number)
            return super().__getitem__(number)

    best = int((whole**2).sum(axis=1).argmax())
    found = metric_tree.search(Spy(pages), whole[best], best, 10)
    scores = sorted(((-int(v @ whole[best]), i) for i, v in enumerate(whole) if i != best))[:10]
    assert found == scores
    assert len(opened) < len(pages) / 2


def test_queries_go_to_few_trees(spark, monkeypatch):
    """On clustered vectors the rings' bounds rule out most trees before any query is sent there."""
    draw = np.random.default_rng(5)
    clouds = draw.normal(size=(12, 8)) * 3
    vectors = {i: (clouds[i % 12] + 0.05 * draw.normal(size=8)).tolist() for i in range(1800)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(4)
    whole = metric_tree.whole_vectors(rows, 1024)
    index = metric_tree.build_index(whole, Settings(pivots=16, tree_rows=40, rings=8, page=8, blocks=3))
    sent = []

    def counted(index, asked):
        out = metric_tree_pairs(index, asked)
        sent.append(out.count())
        return out

    metric_tree_pairs = metric_tree.pairs_to_search
    monkeypatch.setattr(metric_tree, "pairs_to_search", counted)
    found = metric_tree.top_k(index, whole.where("id % 20 = 0"), 10).collect()
    queries = [i for i in vectors if i % 20 == 0]
    assert sorted(map(tuple, found)) == brute_top(vectors, 1024, 10, queries)
    trees = index.rings.count()
    assert trees > 30
    assert sent[0] + len(queries) < len(queries) * trees / 2


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
        (5, [1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0]), (7, []), (100, [-1.0, 0.25]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "v_id")
    whole = metric_tree.whole_vectors(table, 4, key="v_id")
    assert sorted(r.id for r in whole.collect()) == [0, 5, 6, 7, 100]
    index = metric_tree.build_index(whole)
    found = sorted(map(tuple, metric_tree.top_k(index, whole.where("id % 100 = 0"), 3).collect()))
    assert found == [(0, 1, 6, 80), (0, 2, 5, 16), (0, 3, 7, 0), (100, 1, 7, 0), (100, 2, 0, -8), (100, 3, 6, -8)]
    assert metric_tree.build_index(whole.limit(0)) is None


def test_archive_round_trip(spark):
    big = "é☃ text\r\n\r\nWARC/1.1\r\n" * 5000
    rows = [
        (3, "https://a/3", "same", "x"), (1, "https://a/1", "same", "x"), (2, None, None, "x"), (4, "u\r\nEvil: 1", "", "x"),
        (5, "https://b/5", big, "x"), (6, "https://b/6", big, "x"), (None, "https://n", "same", None), (None, "https://n2", "lone", None),
        (7, "https://c/7", "twice", "x"), (7, "https://c/7", "twice", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)
    folder = scratch_path(spark, "warc")
    index = warc.write_archive(pages, folder, max_file_bytes=2000)
    assert index.select("file").distinct().count() > 1
    found = warc.read_records(index, folder, gap=0, most=1000).collect()
    assert len(found) == len(rows)

    def digest(text):
        return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()

    smallest = {"same": 1, "": 2, big: 5, "lone": None, "twice": 7}
    expected = []
    for page_id, url, html, _ in rows:
        html = html or ""
        first = smallest[html]
        revisit = first is not None and page_id != first
        n = len(html.encode())
        expected.append((page_id, url, "revisit" if revisit else "response", digest(html), n, first if revisit else None, None if revisit else html))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    some = warc.read_records(index.where("page_id = 5"), folder).collect()
    assert [r.payload for r in some] == [big]
    large = warc.write_archive(pages, scratch_path(spark, "warc"), min_revisit_bytes=100)
    assert large.where("record_type = 'revisit'").count() == 1
    empty = warc.write_archive(pages.limit(0), folder)
    assert warc.read_records(empty, folder).collect() == []


def test_ranges_are_merged_within_bounds():
    draw = random.Random(4)
    places, at = [], 0
    for _ in range(300):
        at += draw.choice([0, 0, 5, 200])
        n = draw.randint(1, 50)
        places.append((at, n))
        at += n
    seen = []
    for start, length, inside in warc.merged_ranges(places, gap=10, most=120):
        seen += inside
        assert all(start <= places[k][0] and places[k][0] + places[k][1] <= start + length for k in inside)
        assert length <= 120 or len(inside) == 1
    assert seen == list(range(300))
    assert list(warc.merged_ranges([], 1, 1)) == []

"""Main text of pages and exact search."""

import re
from html import unescape

import numpy as np
import pytest

from checks.compare import compare, oracle_connection
from support import SF
from tallywork.llm import html, queries, topk

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) x="</p>";</script></head><body class="page-12">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><div class="content c7"><h2>Head &amp; line</h2><p>First <b>par</b>agraph &lt;1&gt;
 with  space.<p>Second<br>one.<aside>Beside</aside><ul><li>item a<li>item b</ul>
<form><input value="x">Send</form><div class="comments"><p>Nice post</p></div></div><footer>&copy; foot</footer></body></html>"""
TEXT = "Head & line First paragraph <1> with space. Second one. item a item b"


def test_op4_page():
    root = html.parse(PAGE)
    assert html.best_path(root).endswith("/div.c.content")
    assert html.main_text(PAGE, html.best_path(root)) == TEXT and html.main_text(PAGE, "/html/other") == TEXT


@pytest.mark.parametrize("cut", range(0, len(PAGE), 7))
def test_op4_pages_cut_anywhere(cut):
    text = html.main_text(PAGE[:cut], None)
    assert "cookies" not in text and "Buy" not in text and "<b" not in text


def test_op4_whole_article_around_the_best_container(spark):
    body = "<p>" + "Body words of the article here. " * 40 + "</p>"
    whole = "Body words of the article here. " * 39 + "Body words of the article here."
    nav, foot = "<nav><a href='/'>Home</a></nav>", "<footer>foot</footer>"
    inner = f"<article><h1>Title</h1><p>A lead.</p><div class='share'>Share</div><div class='entry-content'>{body}</div></article>"
    wrap = f"<div class='wrap'><div class='text'>{body}</div><div class='quote'>{'<p>Quoted words.</p>' * 12}</div></div>"
    links = "<div class='more'><a href='/a'>Another page</a> <a href='/b'>One more page</a></div>"
    quote = " ".join(["Quoted words."] * 12)
    cases = [
        (nav + inner + foot, f"Title A lead. {whole}"),
        (nav + wrap + foot, f"{whole} {quote}"),
        (f"<div id='page'>{nav}{wrap}<div class='x'>Odd box.</div>{foot}</div>", f"{whole} {quote}"),
        (nav + wrap.replace("<div class='quote'>", links + "<div class='quote'>") + foot, f"{whole} {quote}"),
        (f"{nav}<h1>Title</h1><p>A lead.</p><div class='content'>{body}</div>{foot}", f"Title A lead. {whole}"),
    ]
    for page, text in cases:
        assert html.main_text(f"<html><body>{page}</body></html>", None) == text
    # pages of a host: a short body on the winning path, and an article with next to nothing on it
    rows = [(i, "http://a.example/", f"<html><body>{nav}{inner}{foot}</body></html>") for i in range(4)]
    rows.append((4, "http://a.example/", f"<html><body>{nav}{inner.replace(body, '<p>Brief.</p>').replace('A lead.', body)}</body></html>"))
    rows += [(i, "http://b.example/", f"<html><body><div class='intro'>{body}</div></body></html>") for i in range(5, 8)]
    rows.append((8, "http://b.example/", f"<html><body><div class='intro'>Hi.</div><article>{body}</article></body></html>"))
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert [got[i] for i in range(4)] == [f"Title A lead. {whole}"] * 4 and got[4] == f"Title {whole} Brief."
    assert got[5] == got[8] == whole


def test_op4_hosts_agree_and_edges(spark):
    short = "<html><body><div class='content c9'>Brief.</div><div class='x'><p>" + "Longer words in a box. " * 20 + "</p></div></body></html>"
    rows = [(i, f"http://Host.example:80/{i}", PAGE) for i in range(5)] + [
        (10, "https://user@host.example/x", short),
        (11, None, PAGE),
        (12, "no address", PAGE),
        (13, "http://host.example/n", None),
        (14, "http://host.example/e", ""),
        (14, "http://host.example/e", ""),
        (None, "http://other.example/", "plain text, no tags &amp; so on"),
        (15, "http://other.example/long", "<html><body><article>" + "<p>word</p>" * 30_000 + "</article></body></html>"),
    ]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "'x' AS host", "'y' AS path", "1 AS text", "2 AS votes")
    got = sorted(((-1 if r.page_id is None else r.page_id), r.url, r.text) for r in html.extract(pages).collect())
    texts = {i: t for i, _, t in got}
    assert len(got) == len(rows) and [texts[i] for i in range(5)] == [TEXT] * 5
    # the host's consensus wins over the longer box of one page
    assert texts[10] == "Brief." and texts[11] == texts[12] == TEXT and texts[13] == texts[14] == ""
    assert texts[-1] == "plain text, no tags & so on" and texts[15] == " ".join(["word"] * 30_000)
    assert html.extract(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")).count() == 0


def test_op4_deep_nesting():
    deep = "<html><body>" + "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert html.main_text(deep, None) == "deep text"


@pytest.mark.parametrize("classes", ["lg:w-1/2 flex-col items-center " * 3 + "justify-between", "a-very-long-utility-class/of-its-own " * 30, ""])
def test_op4_long_paths_stay_apart(spark, classes):
    depth = 8 if classes else 100
    words = " ".join(["Words of the article."] * 60)
    inner = f"<div class='odd'>Odd box. {'Side words. ' * 40}</div><article><header><h1>Title</h1></header><p>{words}</p></article>"
    page = "<html><body>" + "".join(f"<div class='{classes} {chr(97 + i % 26)}'>" for i in range(depth)) + inner + "</div>" * depth + "</body></html>"
    assert html.main_text(page, None) == f"Title {words}"
    assert html.best_path(html.parse(page)).endswith("/article") and len(html.best_path(html.parse(page))) <= html.PATH_LENGTH
    named = page.replace("<article>", f"<div class='content {classes}'>").replace("</article>", "</div>").replace("header>", "b>")
    assert html.best_path(html.parse(named)).rsplit("/", 1)[-1].startswith("div.") and "content" in html.best_path(html.parse(named)).rsplit("/", 1)[-1]
    rows = [(i, "http://a.example/", page) for i in range(3)]
    got = html.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()
    assert {r.text for r in got} == {f"Title {words}"}


KEPT_INSIDE = [
    '<h2 id="search">words kept</h2>', '<section id="related-work"><h2>words</h2><p>kept</p></section>', '<div class="market-share">words kept</div>',
    '<figure class="social-graph">words kept</figure>', '<section id="search"><p>words kept <a href="#">x</a></p></section>', '<h3 class="notice" id="comments">words kept</h3>',
    '<p id="share">words kept</p>', '<div class="form-factor">words kept</div>', '<ul id="tags"><li>words</li><li>kept</li></ul>', '<header><p>words kept</p></header>',
    '<table class="toolbar-comparison"><tr><td>words<td>kept</table>', '<div role="img">words kept</div>', '<div class="banner-history">words kept</div>',
]
GONE_INSIDE = [
    '<div class="related-posts">words gone</div>', '<div class="ad ad-728x90">words gone</div>', '<div class="share-buttons">words gone</div>', "<aside>words gone</aside>",
    '<section id="comments"><p>words gone</p></section>', '<ul class="comment-list"><li>words gone</ul>', '<div id="comment-12">words gone</div>', '<div class="cookieNotice">words gone</div>',
    '<p class="notice">words gone</p>', '<div role="navigation">words gone</div>', '<form>words gone</form>', '<div class="newsletter-signup">words gone</div>', "<footer>words gone</footer>",
    '<section id="related"><a href="/a">words</a> <a href="/b">gone</a></section>', '<div class="sidebar sidebar-left">words gone</div>', '<div hidden>words gone</div>', "<nav>words gone</nav>",
]


@pytest.mark.parametrize("inside", KEPT_INSIDE + GONE_INSIDE)
def test_op4_names_inside_the_article(spark, inside):
    """Inside the article a word in a name is no reason to drop text; names made of such words alone, roles and tags are."""
    text = "Some running text of the article, long enough to win. " * 5
    page = f"<html><body><div class='top-nav'>x</div><article><h1>T</h1><p>{text}</p>{inside}<p>end</p></article></body></html>"
    (row,) = html.extract(spark.createDataFrame([(1, "http://a.example/", page)], "page_id BIGINT, url STRING, html STRING")).collect()
    kept = " ".join(re.findall("words|kept", inside)) if inside in KEPT_INSIDE else ""
    assert row.text.replace(" x ", " ") == " ".join(f"T {text} {kept} end".split())


def test_op4_query(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op4_main_text(spark, SF).collect()
    assert len(rows) == len(source)
    for row in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[row.page_id], re.S)[1]
        article = re.sub(r"<(?:/?[a-zA-Z!][^>]*(?:>|\Z))", lambda m: "" if re.match(r"</?(?:b|a)\b", m[0]) else " ", article)
        assert row.text == " ".join(unescape(article).split()) and row.n_chars == len(row.text)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, vector ARRAY<DOUBLE>").selectExpr("*", "1 AS dim", "2 AS low", "'x' AS queries", "3 AS score")


def plain_search(rows, asked, k):
    """Every row but the query's own, one of its id and vector."""
    out = []
    for q, v in asked:
        pool = [r for r in rows if None not in r]
        if (q, v) in pool:
            pool.remove((q, v))
        scored = [(-int(np.dot(v, w)), i) for i, w in pool if len(w) == len(v)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 1024, 2048), (16, 3, 4)])
def test_op2_equals_brute_force_with_ties(spark, monkeypatch, sizes):
    for name, value in zip(("CANDIDATES", "QUERIES", "BINS"), sizes, strict=True):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.integers(-300, 300, 4).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, [5.0, 5.0, 5.0, 5.0]) for i in range(60)]
    asked = [r for r in rows if r[0] % 9 == 0]
    got = sorted(map(tuple, topk.search(vectors(spark, rows), vectors(spark, asked), 5).collect()))
    assert got == plain_search(rows, asked, 5)


def test_op2_edges(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (None, [9.0, 9.0]), (4, [1.0, 2.0, 3.0]), (5, [0.0, 0.0]), (6, []), (7, [])]
    got = sorted(map(tuple, topk.search(vectors(spark, rows), vectors(spark, rows), 5).collect()))
    assert got == plain_search(rows, [r for r in rows if None not in r], 5)
    nothing = vectors(spark, [])
    assert topk.search(nothing, nothing, 5).count() == 0 and topk.search(vectors(spark, rows), nothing, 5).count() == 0


def test_op2_repeated_query_ids(spark):
    """Rows of one id are queries of their own, and each other's candidates."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [3.0, 5.0]), (8, [-1.0, 2.0])]
    got = sorted(map(tuple, topk.search(vectors(spark, rows), vectors(spark, rows[:3]), 5).collect()))
    assert got == plain_search(rows, rows[:3], 5)
    assert (50, 1, 7, 3) in got and got.count((50, 1, 7, 5)) == 2


def test_op2_query_leaves_out_broken_vectors(spark, tmp_path):
    rows = [(0, [0.5, -0.25], 1), (50, [float("nan"), 0.0], 1), (100, None, 1), (3, [float("inf"), 1.0], 1), (4, [None, 1.0], 1), (5, [0.25, 0.0], 1), (6, [-0.001, 0.7], 2)]
    spark.createDataFrame(rows, queries.SCHEMAS["embeddings"]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in queries.op2_exact_top_k(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(0, 1, 5, 8192), (0, 2, 6, -128 - 64 * 179)]


def test_op2_matches_sql(spark):
    result = compare(queries.op2_exact_top_k(spark, SF).toArrow(), oracle_connection(SF).sql(queries.SQL["op2_exact_top_k"]).to_arrow_table())
    assert result.same and not result.type_differences

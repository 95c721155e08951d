"""Main text: markup rules, the tree's importances against a plain version, and edge cases."""

import html
import math
import re

import pytest

from sievework.llm import sitestyle
from sievework.llm.sitestyle import Page, StyleSpec

PAGE = "page_id long, url string, html string, host string, key string, text int, noisy int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "k", 1, 2) for r in rows], PAGE)


def extracted(spark, rows, spec=StyleSpec()):
    return sorted(((r.page_id, r.url, r.text) for r in sitestyle.extract(pages(spark, rows), spec).collect()), key=repr)


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<p>One</p><p>Two  \n three</p>", "One\nTwo three"),
        ("<article><h1>Title</h1><p>a<br>b <b>bold</b>,<i>it</i><p>c</article>", "Title\na b bold,it\nc"),
        ("<nav>menu</nav><header>Site</header><main><p>Text &amp; more&nbsp;&copy; &amp</p></main><footer>foot</footer>", "Text & more © &"),
        ("<article><header><h2>Kept</h2><p>by me</p></header><p>Body</p><aside>side</aside><form><label>x</label><button>go</button></form></article>", "Kept\nBody"),
        ("<article><p>Text</p><section class='reader-comments'><p>First!</p></section><div id='cookieNotice'>ok?</div></article>", "Text"),
        ("<article>A</article><article class='comment'>B</article><article>C</article>", "A\nC"),
        ("<div class=ad>Buy</div><div class='badge'>Stay</div><div role=banner>x</div><div style='display: none'>y</div><div hidden>z</div>", "Stay"),
        ("<script>var a='</p>';</script>x<style>p{}</style>y<!-- c -->z<noscript>n</noscript>", "xyz"),
        ("<html><head><title>T</title><p>body text<script>unclosed", "body text"),
        ("<p>cut <b>in a tag</b> &am", "cut in a tag &am"),
        ("<p>before <a href='x", "before"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "one\ntwo\nin\nthree"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a\nb\nc"),
        ("<div><a href=1>only links</a> <a href=2>here</a></div><p>Text with <a href=3>a link</a>.</p>", "Text with a link."),
        ("a < b and c > d <3 </ p>", "a < b and c > d <3"),
        ("</div></p>stray<div></span>ends</div>", "stray\nends"),
        ("<P CLASS=x>Upper</P><DIV>case", "Upper\ncase"),
        ("<p>one <span class='ad'>buy</span>two</p>", "one two"),
        ("", ""),
        ("   \n ", ""),
    ],
)
def test_markup(markup, text):
    assert Page(markup).text() == text


def test_deep_and_broken_markup_is_linear():
    assert Page("<div>" * 20_000 + "deep" + "</div>" * 20_000).text() == "deep"
    assert Page("<b>" * 20_000 + "x").text() == "x"
    assert Page('<a href="' * 5_000).text() == ""
    assert Page("<" * 50_000 + " x").text() == "<" * 50_000 + " x"
    long = " ".join(f"w{i}" for i in range(200_000))
    assert Page(f"<article><p>{long}").text() == long


def site(n=30):
    """A host whose pages name nothing: the same banner line and links on each, other text in the middle."""
    out = []
    for i in range(n):
        middle = "".join(f"<p>Story {i} part {j} has its own words {i * j + 7}.</p>" for j in range(i % 4 + 1))
        out.append(f"<body><div id='x'><p>Welcome to the site</p></div><div><div>{middle}</div></div><div class='q'><p>All rights reserved</p><p>Made here</p></div></body>")
    return out


def test_tree_removes_what_repeats_on_a_host(spark):
    rows = [(i, f"http://a.net/{i}", h) for i, h in enumerate(site())] + [(100, "http://b.net/1", site(1)[0])]
    got = {i: t for i, _, t in extracted(spark, rows)}
    for i in range(30):
        assert got[i] == "\n".join(f"Story {i} part {j} has its own words {i * j + 7}." for j in range(i % 4 + 1))
    # The same markup on a host of one page says nothing about it.
    assert got[100].startswith("Welcome to the site\nStory 0") and got[100].endswith("Made here")


def test_copies_of_an_article_are_not_a_menu(spark):
    copy = "<body><div><p>The same story on every page of the host.</p><p>It has two paragraphs.</p></div></body>"
    rows = [(i, f"http://a.net/{i}", copy) for i in range(40)]
    assert {t for _, _, t in extracted(spark, rows)} == {"The same story on every page of the host.\nIt has two paragraphs."}
    rows = [(i, f"http://a.net/{i}", f"<nav>{i}</nav><article><p>Same.</p></article>") for i in range(40)]
    assert {t for _, _, t in extracted(spark, rows)} == {"Same."}


def plain_importances(htmls, host, decay):
    """Importance and the largest below, by recursion over the merged pages."""
    distinct = {}
    for h in htmls:
        page = Page(h, host)
        distinct.setdefault(page.text(), []).append(page)
    name = {}
    styles, parts, texts = {}, {}, {}
    for text, same in distinct.items():
        for page in same:
            for node, n in page.nodes.items():
                name[node] = n.path
                style = tuple(n.children)
                siblings = len(page.nodes[n.parent].children) if n.parent in page.nodes else 1
                parts.setdefault((node, style, text), []).append(1 / siblings)
                styles.setdefault(node, {}).setdefault(style, set()).add(text)
                for t in n.texts:
                    texts.setdefault(node, {}).setdefault(t, set()).add(text)
    share = {}
    for (node, _, _), p in parts.items():
        share[node] = share.get(node, 0) + sum(p) / len(p)
    out = {}

    def visit(node):
        m = sum(map(len, styles[node].values()))
        below = {c for s in styles[node] for c in s}
        found = [visit(c) for c in below]
        if m == 1:
            own = 1.0
        elif name[node].endswith("#text"):
            df = [len(v) for v in texts.get(node, {}).values()]
            own = 1 - sum(math.log(c, m) for c in df) / len(df) if df else 1.0
        else:
            p = [len(v) / m for v in styles[node].values()]
            own = -sum(x * math.log(x, m) for x in p)
            if below:
                mean = sum(share[c] * out[c][1] for c in below) / m
                own = (1 - decay ** len(p)) * own + decay ** len(p) * min(1.0, mean)
        out[node] = (m, own, max([own, *found]))
        return out[node][2]

    for node in [n for n, path in name.items() if " " not in path]:
        visit(node)
    return {name[n]: v for n, v in out.items()}


def test_importances_equal_a_plain_version(spark):
    htmls = site(17) + site(5) + ["<body><div><p>Other</p><div><ul><li>a<li>b</ul></div></div></body>", "<p>loose</p>tail"]
    keyed = spark.createDataFrame([(bytes([i]), h, t) for h in ("a", "b") for i, t in enumerate(htmls[: 20 if h == "a" else 99])], "key binary, host string, html string")
    got = sitestyle.importances(sitestyle.node_rows(keyed, StyleSpec())).collect()
    for host, own in (("a", htmls[:20]), ("b", htmls)):
        want = plain_importances(own, host, StyleSpec().decay)
        mine = {r.path: (r.pages, r.importance, r.top) for r in got if r.host == host}
        assert set(mine) == set(want)
        for path, values in want.items():
            assert mine[path] == pytest.approx(values, abs=1e-9), path


def test_edge_cases(spark):
    long = "<p>" + "long " * 100_000 + "</p>"
    rows = [(1, None, None), (1, None, None), (None, "", "<p>x</p>"), (2, "no scheme", "plain"), (3, "http://h/", long), (3, "http://h/", "other"), (4, "http://h/", "<p> Ünïcode\x00</p>")]
    got = extracted(spark, rows)
    assert got == sorted([(1, None, ""), (1, None, ""), (None, "", "x"), (2, "no scheme", "plain"), (3, "http://h/", ("long " * 100_000).strip()), (3, "http://h/", "other"), (4, "http://h/", "Ünïcode\x00")], key=repr)
    assert extracted(spark, []) == []


def test_given_pages_give_their_article(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in sitestyle.extract(df).collect()}
    for r in df.collect():
        inside = re.search("(?s)<article>(.*)</article>", r.html)[1]
        assert got[r.page_id].text.split() == html.unescape(re.sub("<[^>]*>", " ", inside)).split()
        assert got[r.page_id].n_chars == len(got[r.page_id].text)

"""Main-text extraction: recovery, named noise, the style tree's statistics, edge cases."""

import html
import math
import re

import pytest

from tallyloom.llm import htmltree, queries
from tallyloom.llm.htmltree import main_text
from tests.conftest import same_as_sql


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b</p>c", "a b c"), ("<p>a<b>b</b>c<br>d</p>", "abc d"),
        ("<article><h1>T</h1><p>x &amp; y&nbsp;&lt;z&gt;</p></article><footer>f</footer>", "T x & y <z>"),
        ("<body><nav>n</nav><div class=ad>buy</div><p>keep</p><aside>s</aside></body>", "keep"),
        ("<article><p>one</p><div class='comments'><p>c</p></div><p>two</p></article><p>outside</p>", "one two"),
        ("<article><header><h1>Title</h1></header><p>x</p></article>", "Title x"), ("<header>h</header><p>x</p>", "x"),
        ("<p>a<script>var t='</p><p>no';</script>b</p>", "ab"), ("<p>a<!-- <p>no</p> -->b</p>", "ab"), ("<p>a <style>p{}</style", "a"),
        ("<p>cut <a href='x", "cut"), ("<article><p>open <b>bold<p>next", "open bold next"), ("<ul><li>a<li>b</ul>", "a b"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p title='a>b'>t</p>", "t"), ("<form><p>f</p></form><p>x</p>", "x"), ("a < b and c > d", "a < b and c > d"),
        ("<div role='navigation'>n</div><main><p>m</p></main>", "m"), ("<div id='cookie-notice'>c</div><p>x</p>", "x"), ("</p></div>x", "x"), ("<div class='entry-content comments-open'><p>x</p></div><div class='article-comments'>c</div>", "x"),
        ("<div class='post-header'><h2>T</h2></div><p>x</p><ul class='breadcrumb'><li>b</ul>", "T x"), ("<p don't>x</p><p>y</p>", "x y"), ("<p title=\"a>b</p><p>c</p>", "b c"),
        ("<article class='post-content'><p>x</p></article>", "x"), ("<P>Upper</P><SCRIPT>no</SCRIPT>", "Upper"), ("<p>a\x0c\tb</p>\n<p> c </p>", "a b c"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_deep_nesting_keeps_text():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<p>" + "<span>" * 3000 + "x") == "x"


def test_pathological_markup_is_linear():
    import time

    began = time.time()
    main_text("<a " * 3000 + "x")
    main_text("<!--" * 3000)
    main_text("<a \"" * 5001)
    main_text("<a '\"" * 5000)
    main_text("<p>" * 30_000)
    assert time.time() - began < 20


def test_table_against_plain_expressions(spark):
    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in queries.table(spark, path, "pages").collect()}
    got = {r.page_id: r for r in queries.op8_html_extraction(spark, path).collect()}
    assert set(got) == set(pages)
    for i, h in pages.items():
        body = re.search(r"<article>(.*?)(?:</article>|$)", h, re.S)[1]
        text = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))
        assert got[i].text == " ".join(html.unescape(text).split()) and got[i].n_chars == len(got[i].text)


def test_query_equals_sql(spark, duck):
    same_as_sql(spark, duck, queries.op8_html_extraction, queries.SQL["op8_html_extraction"])


def site(n, extra=""):
    return [(i, f"http://host.example/{i}", f"<body><div class='top'>Home About Contact</div><div class='x'><p>story {i} of its own words {i * 7}</p>{extra}</div><div class='end'>All rights kept here</div></body>") for i in range(n)]


def test_repeated_branches_go_and_content_stays(spark):
    rows = site(12) + [(100 + i, f"http://few.example/{i}", "<div class='top'>same</div>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltree.extract(df).collect()}
    assert all(got[i] == f"story {i} of its own words {i * 7}" for i in range(12))
    assert all(got[100 + i] == "same" for i in range(3))  # three pages are no evidence


def plain_div(n):
    """A site without regions and without telling names: menu, story, a teaser that uses article, a closing line."""
    return [
        (i, f"http://plain.example/{i}", f"<div class='a1'><p>Home</p><p>About us</p></div><div class='b2'><h1>Story {i}</h1><p>Own words {i} {i * 7} of some length</p></div>"
         "<div class='c3'><article>Teaser</article></div><div class='d4'>All rights kept</div>") for i in range(n)
    ]


def inside(n):
    """Noise without a telling name inside the region, in a branch that every page repeats."""
    return [(1000 + i, f"http://inside.example/{i}", f"<article><h1>Title {i}</h1><div class='q9'><p>Read this first</p></div><p>Own words {i}</p></article>") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_the_tree_decides_without_regions_and_inside_them(spark):
    got = {r.page_id: r.text for r in htmltree.extract(frame(spark, plain_div(20) + inside(25))).collect()}
    assert all(got[i] == f"Story {i} Own words {i} {i * 7} of some length" for i in range(20))
    assert all(got[1000 + i] == f"Title {i} Own words {i}" for i in range(25))
    few = {r.page_id: r.text for r in htmltree.extract(frame(spark, inside(10))).collect()}
    assert few[1003] == "Title 3 Read this first Own words 3"  # ten pages don't outweigh a region


def test_without_the_tree_the_noise_stays():
    assert main_text(plain_div(1)[0][2]) == "Home About us Story 0 Own words 0 0 of some length Teaser All rights kept"
    assert "Read this first" in main_text(inside(1)[0][2])


def test_every_node_low_leaves_nothing():
    for _, _, h in plain_div(2) + inside(2):
        nodes = {row[0] for row in htmltree.style_rows(h)}
        assert main_text(h, nodes, nodes) == ""


def test_a_region_wins_with_a_tenth_of_the_text():
    assert main_text("<article>short</article><div>" + "a much longer story " * 3 + "</div>") == "short" + " a much longer story" * 3
    assert main_text("<article>a story</article><div>a much longer remark</div>") == "a story"


def test_deep_pages_lose_nothing_by_the_tree(spark):
    rows = [(i, f"http://deep.example/{i}", "<article>" + "<div>" * 300 + f"deep {i}" + "</div>" * 300 + f"<p>last {i}</p></article><nav>n</nav>") for i in range(30)]
    got = {r.page_id: r.text for r in htmltree.extract(frame(spark, rows)).collect()}
    assert all(got[i] == f"deep {i} last {i}" for i in range(30))


def slow_tree(rows):
    """Lists of low nodes by site, from plain dictionaries."""
    sites = {}
    for _, url, h in {(u.split("/")[2], h): (i, u, h) for i, u, h in rows}.values():
        sites.setdefault(url.split("/")[2], []).append(htmltree.style_rows(h))
    low = {}
    for host, pages in sites.items():
        importance, m_of = {}, {}
        for node in {r[0] for p in pages for r in p}:
            own = [{r for r in p if r[0] == node} for p in pages]
            m = sum(any(r[1] == 0 for r in p) for p in own)
            count = lambda kind, own=own: [sum((node, kind, f) in p for p in own) for f in {r[2] for p in own for r in p if r[1] == kind}]  # noqa: B023, E731
            shapes, texts = count(1), count(2)
            shown = 1.0 if m == 1 else -sum(c / sum(shapes) * math.log(c / sum(shapes), m) for c in shapes)
            if texts:
                content = 1.0 if m == 1 else 1 - sum(math.log(c, m) for c in texts) / len(texts)
                importance[node], m_of[node] = 0.9 * content + 0.1 * shown, m
        whole = importance.get(0, 0)
        for node, x in importance.items():
            rel = min(1.0, x / whole) if whole > 0 else 1.0
            for k, prior in enumerate((2, 8)):
                if node and x < 0.3 and (prior + m_of[node] * rel) / (prior + m_of[node]) < 0.3:
                    low.setdefault(host, (set(), set()))[k].add(node)
    return low


def test_whole_extraction_equals_slow_tree(spark):
    import random

    rng = random.Random(6)
    rows = plain_div(9) + inside(30) + [(2000 + i, "http://few.example/1", "<div class='top'>same</div>") for i in range(3)]
    for i in range(150):
        parts = [f"<div class='k{k}'>{rng.choice(['x', 'y', f'own {i}', f'part {i % 3}'])} {k}</div>" for k in rng.sample(range(8), 4)]
        rows.append((3000 + i, f"http://h{i % 5}.example/{i}", rng.choice(["{}", "<main>{}</main>", "<section>{}</section>"]).format("".join(parts))))
    rows += [(4000 + i, u, h) for i, (_, u, h) in enumerate(rng.sample(rows, 40))]
    low = slow_tree(rows)
    want = {i: main_text(h, *low.get(u.split("/")[2], ())) for i, u, h in rows}
    assert sum(want[i] != main_text(h) for i, _, h in rows) > 40
    assert {r.page_id: r.text for r in htmltree.extract(frame(spark, rows)).collect()} == want


def test_copies_of_articles_stay(spark):
    same = [(i, "http://h.example/a", "<nav>m</nav><article><p>the very same story</p></article>") for i in range(30)]
    menus = [(100 + i, "http://g.example/a", f"<nav>menu {i}</nav><article><h2>Head</h2><p>the very same story</p></article>") for i in range(30)]
    got = htmltree.extract(frame(spark, same + menus)).collect()
    assert {r.text for r in got} == {"the very same story", "Head the very same story"}


def test_importance_equals_loop(spark):
    rows = site(8)
    for i in range(4):
        rows[i] = (rows[i][0], rows[i][1], rows[i][2].replace("<div class='end'>", "<p>more</p><div class='end'>"))
    got = {r.node: r for r in htmltree.style_tree(frame(spark, rows)).collect()}
    pages, features, shapes = {}, {}, {}
    for _, _, h in rows:
        for node, kind, feature in htmltree.style_rows(h):
            if kind == 0:
                pages[node] = pages.get(node, 0) + 1
            else:
                of = (shapes, features)[kind - 1].setdefault(node, {})
                of[feature] = of.get(feature, 0) + 1
    assert set(got) == set(pages)
    for node, m in pages.items():
        total = sum(shapes[node].values())
        shown = 1.0 if m == 1 else -sum(c / total * math.log(c / total, m) for c in shapes[node].values())
        text = 1.0 if m == 1 or node not in features else 1 - sum(math.log(c, m) for c in features[node].values()) / len(features[node])
        r = got[node]
        assert r.pages == m and r.presentation == pytest.approx(shown) and r.content == pytest.approx(text)


def test_join_with_salt_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(site(12), "page_id long, url string, html string")
    want = sorted(tuple(r) for r in htmltree.extract(df).collect())
    monkeypatch.setattr(htmltree, "BROADCAST_ROWS", -1)
    assert sorted(tuple(r) for r in htmltree.extract(df).collect()) == want


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (None, "http://a/", "<p>x</p>"), (3, "http://a/", "<p>x</p>"), (3, "http://a/", "<p>x</p>"), (4, "http://a/", "w " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS host", "2 AS low")
    out = htmltree.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars) for r in out.collect()) == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("4", 199_999), ("None", 1)]
    assert htmltree.extract(df.limit(0)).count() == 0


def test_elements_beyond_the_depth_close_themselves():
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    page = f'<body><div id="wrap"><article>first {deep} last</article></div>outside</body>'
    assert htmltree.main_text(page) == "first deep last"
    nav = "<div>" * 300 + "<nav>links</nav><p>kept</p>" + "</div>" * 300
    assert htmltree.main_text(f"<body><article>first {nav} last</article></body>") == "first kept last"
    assert htmltree.main_text("<body><article>" + "<b>" * 400 + "a</article>outside</body>") == "a"

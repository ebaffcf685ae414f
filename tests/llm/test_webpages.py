import random

import pytest

from rowloom.llm.webpages import Page, main_text, names_boilerplate, op10_html_extraction, style_nodes, style_tree

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Head&shy;line</h1></header><p>One <b>b</b>old &amp;  caf&eacute;&nbsp;x<p>Two<br>lines <!-- no --> <i>a</i>b</p><form>f</form><div class="ad-box ads">ad</div>
<ul><li>i1<li>i2</ul><aside>side</aside><table><tr><td>c1<td>c2</table><section id="comments"><p>nice!</p></section><pre>a
 b</pre></article><footer>&copy; me</footer></body></html>"""


def test_article():
    assert Page(PAGE).text() == "Head\u00adline One bold & café x Two lines ab i1 i2 c1 c2 a b"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain &lt;text", "plain <text"), ("<p>a<p>b", "a b"), ("<div>a</div><div>b</div>c", "a b c"), ("<article>a <p", "a"), ("<article>a &am", "a &am"), ("<article>a &amp", "a &"), ("a < b > c", "a < b > c"),
        ("<main>x<script>if (a<b) {}", "x"), ("<article>x<!-- cut", "x"), ('<article><a href="x>y">l</a>ink', "link"), ("<article><p class='a\"b'>q", "q"), ("<body><p>t</p><footer>f", "t"), ("<nav>n", ""), ("<div hidden>h</div>s", "s"),
        ("<div style='display: none'>h</div>s", "s"), ("<article>a<article class=comment>c</article>b</article>", "a b"), ("<p>x</div>y</p>z", "x y z"), ("<b>a<p>b</b>c", "a bc"), ("<b>x<article>a</b> b</article>c", "a b"),
    ],
)
def test_cases(html, text):
    assert Page(html).text() == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='content has-sidebar'><p>x</p><article>a</article></div>", "a"), ("<div id=page-no-comments><main>a</main></div>", "a"), ("<article class='post comments-open'>a</article>", "a"), ("<main><div class=with-nav><article>a</article></div></main>", "a"),
        ("<div class=widget><article>a</article></div>", "a"), ("<div class=comments-open><article>a<div class=ad-box>ad</div></article></div>", "a"), ("<nav class=has-sidebar><article>a</article></nav>b", "b"), ("<div class=has-sidebar><nav><article>n</article></nav><article>a</article></div>", "a"),
        ("<article>a</article><div class=related-posts><article>b</article></div>", "a"), ("<main><article>a</article><ol class=comment-list><li><article class=comment-body>c</article></ol></main>", "a"), ("<article>a</article><article class=comment>c</article>", "a"), ("<div class='sidebar'>s</div><article>a</article>", "a"), ("<div class=widget><article>a<article class=comment>c</article></article></div>", "a"),
    ],
)
def test_names_around_articles(html, text):
    assert Page(html).text() == text


def test_style_tree_removes_what_a_site_repeats(spark):
    rng = random.Random(4)
    pages = [(i, "http://same.test/p", f"<body><div class='top'><p>Welcome to our site</p></div><div class='text'><p>{' '.join(str(rng.random()) for _ in range(9))}</p></div></body>") for i in range(20)]
    pages += [(100 + i, f"http://h{i}.test/", "<div class='top'><p>Welcome to our site</p></div>") for i in range(3)]
    out = {r["page_id"]: r["__rl_text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all("Welcome" not in out[i] and len(out[i].split()) == 9 for i in range(20))
    assert all(out[100 + i] == "Welcome to our site" for i in range(3))  # too few pages to tell
    tree = {r["path"]: r for r in style_tree(style_nodes(spark.createDataFrame([("h", i, p[2]) for i, p in enumerate(pages[:20])], "host string, page long, html string"))).collect()}
    paths = dict(zip(Page(pages[0][2]).style, (int.from_bytes(x, "big", signed=True) for x in Page(pages[0][2]).paths()), strict=True))
    assert tree[paths["div.top"]]["content"] == 0 and tree[paths["div.text"]]["content"] == 1 and tree[paths["div.text"]]["presentation"] == 0
    assert all("Welcome" in r["__rl_text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), by_tree=False).collect())


def test_style_tree_judges_what_lies_beside_articles(spark):
    """Main text in a div beside a teaser stays, what the site repeats goes; articles count in the body that holds them."""
    page = lambda i, x: f"<body><div class='top'><p>Welcome</p></div><article>teaser {i}</article><div class='text'><p>main <i>text {i}</i></p></div>{x}</body>"
    pages = [(i, "http://same.test/p", page(i, "<div class='ad'>ad</div>")) for i in range(20)] + [(100, "http://few.test/", page(100, ""))]
    pages += [(200 + i, "http://other.test/p", f"<body><div class='top'><p>Welcome</p></div><article>piece {i}</article></body>") for i in range(20)] + [(300, "http://other.test/q", "<body><div class='text'>alone</div></body>")]
    out = {r["page_id"]: r["__rl_text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"teaser {i} main text {i}" and out[200 + i] == f"piece {i}" for i in range(20))
    assert out[100] == "teaser 100" and out[300] == "alone"  # too few pages to tell; a body whose articles vary is no notice


def test_copied_articles_stay(spark):
    pages = [(i, "http://same.test/p", "<nav>n</nav><article><p>The same text</p></article>") for i in range(30)]
    assert {r["__rl_text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"The same text"}


def test_query(spark, tmp_path):
    rows = [(1, "http://a.test/x", PAGE), (1, "http://a.test/x", PAGE), (None, None, "<p>x"), (3, "nothing", None), (4, "http://b.test", ""), (5, "http://b.test", "<article>" + "<p>w " * 20_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as host").write.parquet(str(tmp_path / "pages.parquet"))
    out = op10_html_extraction(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in out}
    assert by[3, "nothing"]["text"] == "" and by[4, "http://b.test"]["n_chars"] == 0 and by[None, None]["text"] == "x" and by[5, "http://b.test"]["n_chars"] == 39_999
    assert by[1, "http://a.test/x"]["n_chars"] == len(by[1, "http://a.test/x"]["text"])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none/pages.parquet"))
    assert op10_html_extraction(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article>Now <span class="share-price">42 USD</span>.</article>', "Now 42 USD."), ('<article><p>a<div class="reply-rate">50 %</div></article>', "a 50 %"), ('<article><section class="notices-of-motion">m</section></article>', "m"), ('<article class="social">s</article>', "s"),
        ("<article>x <math><mi>y</mi></math></article>", "x y"), ('<article>a<div class="ad ad-300x250">ad</div><div id="relatedPosts">r</div><div class="share">s</div></article>', "a"), ("<article> </article><p>x</p>", "x"),
    ],
)
def test_articles_keep_what_only_mentions_boilerplate(html, text):
    assert Page(html).text() == text


def test_names():
    assert all(map(names_boilerplate, ["ad", "ad-box", "adSlot_2", "comments-list", "cookie-notice", "newsletter-signup-form", "NavBar"]))
    assert not any(map(names_boilerplate, ["", "content", "share-price", "has-sidebar", "page-no-comments", "comments-open", "reply-rate", "adept", "42"]))


def test_the_tree_decides_within_articles_too(spark):
    """A box that a site repeats in all its articles goes, running text and boxes that vary stay; copied articles stay whole."""
    page = lambda t: f"<body><article><h1>Daily report</h1><div class='lead'>lead {t}</div><p>text</p><div class='end'>Call us <b>now</b></div></article></body>"
    pages = [(i, "http://same.test/p", page(i)) for i in range(20)] + [(100 + i, "http://copies.test/p", page("x")) for i in range(20)] + [(200, "http://few.test/", page("y")), (201, "http://few.test/", page("z"))]
    out = {r["page_id"]: r["__rl_text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Daily report lead {i} text" and out[100 + i] == "Daily report lead x text Call us now" for i in range(20))
    assert out[200] == "Daily report lead y text Call us now"
    bare = [(i, "http://bare.test/p", "<div>all the same</div><p>p") for i in range(20)]
    assert {r["__rl_text"] for r in main_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()} == {"all the same p"}


def test_deep_pages_take_linear_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for source in ("<div>x" * 40_000, "<b>" * 40_000 + "<hr>" * 20_000 + "t", "<div class=c>" * 20_000 + "</p></section>" * 20_000 + "x" + "</div>" * 20_000, "<article>" + "<div>a" * 40_000, "<b><p>" * 20_000 + "</b>" * 20_000):
        p = Page(source)
        tree = {x[0]: (30, 0.9) for x in p.nodes()}
        assert p.text() == " ".join(p.text().split()) and isinstance(p.text(tree), str)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_pages_without_boxes_of_their_own_give_no_nodes():
    assert len(list(Page(PAGE).nodes())) == 2  # the header in the article, and the article for comparison
    for source in ("<article><p>a<br>b<hr><img></article><wbr>", "<html><body><nav>n</nav><div class=ad>a</div><article><h1>h</h1><p><b>x<br><p>y</article><footer>f</footer>"):
        assert list(Page(source).nodes()) == []

import html
import re

from tessera.llm import html_text
from tessera.llm.queries import op5_html_extraction


def test_query_against_named_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op5_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        body = re.sub(r"<[^>]*(>|$)", " ", re.sub("</?b>", "", body))
        assert r.text == " ".join(html.unescape(body).split())
        assert r.n_chars == len(r.text)


PLAIN = """<html><head><title>T</title></head><body><div class="header"><p>Site name here</p></div>
<div class="cookie-notice">We use cookies a lot, please accept them all now or later on.</div>
<div id="content"><h1>Title of it</h1><p>First para with <b>bo</b>ld &amp; more&nbsp;words.</p>
<div class="ad">Buy now cheap things for everyone today</div><form><input>Sign up</form>
<p>Second para <!-- <p>no</p> -->goes on
a bit, as they do.</p></div><div class="comments"><p>Great article friend, I liked it a lot and more</p></div><footer>bye</footer></body></html>"""


def learned(sf_dir):
    import duckdb

    pages = [r[0] for r in duckdb.connect().execute(f"SELECT html FROM '{sf_dir}/pages.parquet' ORDER BY page_id").fetchall()]
    return pages, html_text.fit_pages(pages)


def test_articles_that_nothing_names(sf_dir):
    """The article's tags are taken away, or made plain containers: recall and precision of words."""
    pages, weights = learned(sf_dir)
    for change in (lambda p: re.sub("</?article>", "", p), lambda p: p.replace("<article>", "<div>").replace("</article>", "</div>"), lambda p: p.replace("<article>", '<section class="story-body">').replace("</article>", "</section>")):
        found = [html_text.extract(change(p), weights) for p in pages]
        wanted = [html_text.extract(p, weights) for p in pages]
        assert min(html_text.agreement(a, b) for a, b in zip(found, wanted)) >= 0.9
        assert sum(a == b for a, b in zip(found, wanted)) >= 0.9 * len(pages)


LINKS = "<div>" + "".join(f"<span><a href='/{k}'>Go {k}</a></span>" for k in range(8)) + "</div>"


def test_scan_decides_where_nothing_is_named(sf_dir):
    """A block of links without any name goes by the scan alone."""
    _, weights = learned(sf_dir)
    article = "<h1>A title of some words</h1><p>" + "Words of the text go on and on here. " * 12 + "</p><p>" + "More of them follow, as they do. " * 9 + "</p>"
    page = f"<html><body>{LINKS}{article}{LINKS}</body></html>"
    with_scan, without = (html_text.extract(page, weights, scan=x) for x in (True, False))
    assert with_scan == html_text.extract(article, weights) and without != with_scan and "Go 3" in without
    assert html_text.extract(page, html_text.Weights()) == without  # what links cost is learned


def test_containers_with_telling_words(sf_dir):
    """A word of a name is evidence, not a verdict."""
    _, weights = learned(sf_dir)
    for w in (weights, html_text.Weights()):
        text = "The body of a long enough article, with its words."
        for name in ("legal-analysis", "job-search-guide", "popular-science", "related-work", "notice-board"):
            assert html_text.extract(f'<body><div class="{name}"><article><p>{text}</p></article></div></body>', w) == text, name
            assert html_text.extract(f'<body><article><div class="{name}"><p>{text}</p></div></article></body>', w) == text, name
        for name in ("comments", "comment-list", "cookie-notice", "ad", "sidebar", "newsletter-signup", "share-buttons"):
            inner = f'<div class="{name}"><p>Not a part of it, however long it may be.</p></div>'
            assert html_text.extract(f"<body><article><p>{text}</p>{inner}<p>{text}</p></article>{inner}</body>", w) == f"{text} {text}", name
        assert html_text.extract(f'<body><article><p>{text}</p></article><section class="comments"><article><p>I liked it so much.</p></article></section></body>', w) == text
        assert html_text.extract(f"<body><form id='page'><main><p>{text}</p></main></form></body>", w) == text
        assert html_text.extract(f"<body><p>Site name</p><article><ul><li>{text}</li><li>{text}</li></ul></article><p>Imprint</p></body>", w) == f"{text} {text}"


def test_names_are_learned():
    """What labelled pages hold outside of their content is known on pages that name nothing."""
    page = '<body><div class="qx-teaser">{0}</div><{1}><p>{2}</p></{1}><div class="qx-teaser">{0}</div></body>'
    words = lambda n, k: " ".join(f"{k}{i}" for i in range(n)) + "."
    weights = html_text.fit_pages([page.format(words(30, f"t{k}"), "article", words(60, f"a{k}")) for k in range(40)])
    assert weights.of(".qx-teaser") < -html_text.STRONG < 0 == html_text.Weights().of(".qx-teaser")
    assert html_text.extract(page.format(words(30, "x"), "div", words(60, "y")), weights) == words(60, "y")
    assert html_text.extract(page.format(words(30, "x"), "div", words(60, "y")), html_text.Weights()) != words(60, "y")


def test_page_without_article():
    expected = "Title of it First para with bold & more words. Second para goes on a bit, as they do."
    assert html_text.extract(PLAIN, html_text.Weights()) == expected
    inside = PLAIN.replace('<div id="content">', '<article><header><h2>Head</h2></header>').replace("today</div>", "today</div>")
    assert html_text.extract(inside, html_text.Weights()).startswith("Head Title of it First para")


def test_broken_markup():
    w = html_text.Weights()
    assert html_text.extract(None, w) == "" and html_text.extract("", w) == "" and html_text.extract("<p></p>", w) == ""
    assert html_text.extract("just some words", w) == "just some words"
    assert html_text.extract("<article><p>one two<script>x", w) == "one two"
    assert html_text.extract("<article><p>one two <a href='", w) == "one two"
    assert html_text.extract("<article>a &lt;b&gt; c<!-- open", w) == "a <b> c"
    for page in ("<" * 50_000, "<a " * 30_000, "<div>" * 30_000, '<p class="' * 20_000, "<script>" * 20_000):
        html_text.extract(page, w)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<article>hi you</article>", "y"), (None, "u", "", "z")], "page_id long, url string, html string, text string")
    rows = html_text.main_text(df, html_text.learn(df)).collect()
    assert sorted(r.text for r in rows) == ["", "", "hi you"]
    assert html_text.main_text(df.limit(0), html_text.learn(df.limit(0))).count() == 0

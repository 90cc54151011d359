from __future__ import annotations

import re
from html import unescape

from quern.llm import wrappers

SCHEMA = "page_id long, url string, html string"


def article_of(html):
    body = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))
    return " ".join(t for t in (re.sub(r"\s+", " ", unescape(b)).strip() for b in blocks) if t)


def test_small_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = wrappers.op7_wrapper_extraction(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text)


def test_constant_nodes_are_template():
    """A site without any helpful tag: what all pages say in one place goes."""
    page = "<body><div>Best shop</div><div><p>{0} one.</p><p>{0} two.</p></div><div>Call us</div></body>"
    names = [f"Story {i}" for i in range(8)]
    assert wrappers.extracted([page.format(n) for n in names]) == [f"{n} one. {n} two." for n in names]
    # Too few pages to tell: everything but named parts stays.
    assert wrappers.extracted([page.format("S")]) == ["Best shop S one. S two. Call us"]


def test_named_parts_go():
    page = (
        "<html><head><title>T</title></head><body><header>H</header><div class='side-bar sidebar'>S</div>"
        "<div id=cookie-notice>C</div><form>F</form><script>if (a<b) '</p>'</script><style>p{}</style>"
        "<!-- <p>no</p> --><article><header><h1>Head&nbsp;line</h1></header><p>It&#39;s a<b>b</b>\n c &lt; d"
        "<aside>A</aside><p>last<br>line</p><div class='comments'><p>Me too</p></div></article>"
        "<div role=navigation>N</div><footer>E</footer></body></html>"
    )
    assert wrappers.extracted([page]) == ["Head line It's ab c < d last line"]


def test_matching_is_the_largest():
    a = wrappers.tree("<div><p>1</p><ul><li>a</li><li>b</li></ul><p>2</p></div>")[0]
    b = wrappers.tree("<div><ul><li>a</li><li>b</li><li>c</li></ul><h2>x</h2><p>2</p></div>")[0]
    size, pairs = wrappers.matched(a, b)
    assert size == len(pairs) == 6  # root, div, ul, two li, p


def test_rough_pages(spark):
    rows = [
        (1, None, None),
        (2, "http://a.example/x", ""),
        (None, "http://a.example/y", "<p>unclosed <b>bold <i>text"),
        (3, "no address", "plain & simple < text"),
        (3, "no address", "plain & simple < text"),
        (4, "http://u@a.example:80/z", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (5, "http://a.example/z", "</p></div><a href='x>y' cut"),
        (6, "http://b.example/", "<p>" + "long text " * 40_000 + "</p>"),
        (7, "http://b.example/", '<a "' * 2000),
    ]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' AS host", "1 AS mark", "2 AS text")
    got = sorted(((r.page_id, r.text) for r in wrappers.main_texts(pages).collect()), key=repr)
    texts = dict(got)
    assert len(got) == len(rows)
    assert texts[1] == texts[2] == "" and texts[None] == "unclosed bold text"
    assert texts[3] == "plain & simple < text" and texts[4] == "deep"
    assert len(texts[6]) == 10 * 40_000 - 1


def test_empty_table(spark):
    assert wrappers.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_host_is_cut_into_groups(spark, monkeypatch):
    page = "<body><p>Shop</p><article><p>Story {0}</p><p>Ends.</p></article></body>"
    rows = [(i, "http://one.example/", page.format(i)) for i in range(700)]
    got = wrappers.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    # "Ends." is told on all pages of the host, in every group alike.
    assert {r.text for r in got} == {f"Story {i}" for i in range(700)}

"""Page features against an independent tree walker (stdlib html.parser)."""
import random

import pytest

import walker
from veilscan.operators import dom

EDGE_PAGES = [
    '<html><head><title> T &amp; x</title><meta name="description" content="Desc &lt;b&gt;"></head><body>'
    '<div class="my-modal" style="position: fixed">Sticky <b>deal</b> now</div>'
    '<form action="/buy" method=POST><input type="checkbox" name="nl" checked><input type=hidden name=k value="a>b">'
    '<input name="x" value="checked"></form><input checked name=outside>'
    '<button> Buy <b>Brand#1</b></button><button></button><a href="/a?x=1&amp;y=2">l</a><a>no</a><a href>bare</a>'
    '<small>this is small print text</small><p style="font-size: 10px">tiny legal text here</p>'
    '<p style="font-size:10.5px">not tiny text here</p><p style="font-size:11px">eleven px text</p>'
    '<p style="font-size:12px">twelve px text!</p>'
    '<span>$ 12.50</span> and 1,299.99 USD and £5 and $1,299.99 <sub>short</sub> 10 USD'
    '<div style="position:sticky"><div>inner</div>outer tail</div><img style="position:fixed">'
    '</body></html>',
    "<p>no close <b>bold &copy 2024",
    '<HTML><BODY><A HREF="/UP">Up</A><DIV ID="popup">x</DIV><DIV CLASS="Modal">y</DIV></BODY></HTML>',
    '<html><head><title></title><meta name="description"></head><body>x<!-- <b>c</b> -->y</body></html>',
    '<body><script>var s="</p><b>";</script><style>p{}</style>A&#65;&#x42;&nbsp;C</body>',
    '<body><a href=\'single\'>s</a><a href=unq>u</a><input type=hidden name="h1"></body>',
    '<body><form><input name="a" checked="false" type="radio"></form><form action="x"></form></body>',
    '<body><span>٣ USD</span><span>$ 5</span><span>€ 7,5</span></body>',
]


def test_edge_pages(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(EDGE_PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.asDict(recursive=True) for r in dom.page_features(pages).collect()}
    for i, h in enumerate(EDGE_PAGES):
        exp = walker.features(h)
        for k, v in exp.items():
            assert got[i][k] == v, (i, k, got[i][k], v)


def test_fixture_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    htmls = {r.page_id: r.html for r in pages.collect()}
    for r in dom.page_features(pages).collect():
        exp = walker.features(htmls[r.page_id])
        got = r.asDict(recursive=True)
        for k, v in exp.items():
            assert got[k] == v, (r.page_id, k)


def test_failed_pages_are_kept(spark):
    pages = spark.createDataFrame([(1, "a", None), (2, "b", "")], "page_id long, url string, html string")
    out = dom.page_features(pages).collect()
    assert len(out) == 2
    assert all(not r.scrape_success and r.scrape_error for r in out)
    assert all(r.title == "" and r.links == [] for r in out)


@pytest.mark.parametrize("n", [5, 6, 30, 31, 50, 51])
def test_caps(spark, n):
    body = "".join(f'<a href="/{i}">x</a><button>b{i}</button>' for i in range(n))
    pages = spark.createDataFrame([(1, "u", f"<body>{body}</body>")], "page_id long, url string, html string")
    r = dom.page_features(pages, **dom.AUDIT_LIMITS).collect()[0]
    whole = dom.page_features(pages).collect()[0]
    assert len(whole.links) == len(whole.buttons) == n
    assert len(r.links) == min(n, 50)
    assert len(r.buttons) == min(n, 30)


HARD_PAGES = [
    "<p>" + "x" * 100_000 + "</p><small>" + "fine print " * 9_000 + "</small>",   # long text runs
    "a <b " + "y" * 100_000 + ">bold</b>",                                        # a long tag
    "<div " + " ".join(f'a{i}="{i}>"' for i in range(10_000)) + ' style="position:fixed">many</div>',
    "<p>one</p><head-line>two</head-line><script-x>three</script-x><style-guide>four</style-guide><p>five</p>",
    "<a-card href='no'>x</a-card><button-bar>y</button-bar><form-x><input-y name=z></form-x><a href=yes>z</a>",
    "<form><button>Buy now</form><p>after</p>",
    '<div class="a"style="position:fixed">glued</div>',
    "<p>plain</p>",
    "<div style='position:sticky'>" * 60 + "deep" + "</div>" * 60,
]


def test_hard_pages(spark):
    """Long runs, odd names and unclosed elements neither fail nor swallow the page."""
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(HARD_PAGES)], "page_id long, url string, html string")
    for r in dom.page_features(pages).collect():
        got, want = r.asDict(recursive=True), walker.features(HARD_PAGES[r.page_id])
        for k, v in want.items():
            assert got[k] == v, (r.page_id, k)
    assert {r.page_id for r in dom.dom_tokens(pages).collect()} == set(range(len(HARD_PAGES)))


def test_crawler_error_is_kept(spark):
    pages = spark.createDataFrame([(1, "a", "<p>x</p>", "timeout"), (2, "b", "<p>y</p>", None)], "page_id long, url string, html string, why string")
    got = {r.page_id: (r.scrape_success, r.scrape_error) for r in dom.page_features(pages, error_col="why").collect()}
    assert got == {1: (False, "timeout"), 2: (True, None)}


UNCLOSED_PAGES = [
    "<div><small>tiny print here</div><p>rest of the page</p>",
    "<ul><li>one<li style='font-size:9px'>two is small enough<li>three</ul><p>after</p>",
    "<table><tr><td style='font-size: 8px'>cell one is tiny<td>cell two</table>tail",
    "<p style='position:fixed'>first<p style='position:sticky'>second</div><div>third",
    "</div></small><small>alone to the very end",
    "<div style='position:fixed'><div style='position:fixed'>a<br>b</span>c</div>d<small>not closed small</div>e</small>f",
    "<small><sup>inner most text<sub>inner again text</small>outer",
    "<p>" * 300 + "<small>deep inside of it</small>" + "x",
    "<ul>" + "<li style='position:fixed'>item" * 200 + "</ul>rest",
    "<b><small style='font-size:10px'/>nothing<img style='font-size:10px'>more text here</b>",
]


def test_unclosed_elements(spark):
    """Every element ends where its parent ends, as an independent walker of the page finds."""
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(UNCLOSED_PAGES)], "page_id long, url string, html string")
    for r in dom.page_features(pages).collect():
        got, want = r.asDict(recursive=True), walker.features(UNCLOSED_PAGES[r.page_id])
        for k, v in want.items():
            assert got[k] == v, (r.page_id, k, got[k], v)


def test_random_markup(spark):
    rnd = random.Random(7)
    names = ["p", "div", "small", "li", "td", "span", "br"]
    htmls = []
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(1, 40)):
            kind = rnd.random()
            if kind < 0.45:
                style = rnd.choice(["", "", " style='font-size:9px'", " style='position:fixed'"])
                parts.append(f"<{rnd.choice(names)}{style}>")
            elif kind < 0.75:
                parts.append(f"</{rnd.choice(names)}>")
            else:
                parts.append(f"words number {rnd.randrange(99)} ")
        htmls.append("".join(parts))
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    for r in dom.page_features(pages, fields=["small_print", "sticky_elements"]).collect():
        want = walker.features(htmls[r.page_id])
        assert r.small_print == want["small_print"], htmls[r.page_id]
        assert r.sticky_elements == want["sticky_elements"], htmls[r.page_id]

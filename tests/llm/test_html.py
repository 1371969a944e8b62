import html
import re

from conftest import SF
from helpers import table

from skerry.llm.common import read_table
from skerry.llm.html import Page, main_text, templates
from skerry.llm.queries_html import op3_html

PAGES = "page_id long, url string, html string"


def test_structure():
    t = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div><main><article class="post"><header><h1>Title &amp; &#233;</h1></header>
    <p>One<br>two <a href=x>link</a>.<p>Three <b>x</b>y<aside>side</aside><div class="ad">ad</div><form><p>f</p></form><ul><li>a<li>b</ul><script>var t="</p>";</script><style>p{}</style>
    <section id="comments"><article class="comment"><p>c</p></article></section></article></main><footer>f</footer></body>"""
    assert Page(t).text() == "Title & é\nOne two link.\nThree xy\na\nb"


def test_odd_sources():
    assert Page("").text() == "" and Page("a < b & c <i>x</i>").text() == "a < b & c x"
    assert Page("<article><p>one &am").text() == "one &am" and Page("<article><p>one</p><p cla").text() == "one"
    assert Page("<article></article><p>outside</p>").text() == ""
    assert Page("<!-- <article>no</article> --><main><p>yes</p></main>").text() == "yes"
    assert Page("<div id=menu><a href=1>x</a></div><div class=c1><p>Long text here</p></div><div class=sidebar>zzz</div>").text() == "Long text here"
    assert Page("<p hidden>a</p><p style='display: none'>b</p><p>c</p>").text() == "c"
    deep = "<div>" * 3000 + "x"
    assert Page(deep).text() == "x"


def test_deep_pages_stay_small():
    """A megabyte of nested tags is read within 300 MB: a path is a node with its parent."""
    import tracemalloc

    for inner in ("<div>", "<div class=a>", "<span>"):
        n = 1_000_000 // len(inner)
        tracemalloc.start()
        page_ = Page(inner * n + "x" + "</div>" * 10)
        text, size = page_.text(), tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert text == "x" and size < 300_000_000 and max(page_.depths) == n


def simple(h):
    """For pages whose article holds nothing but headings and paragraphs."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)
    body = re.sub(r"<[^>]*\Z", "", m[1]) if m else ""
    return "\n".join(y for y in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", z)).split()) for z in re.split(r"</?(?:p|h1)\b[^>]*>", body)) if y)


def test_all_pages(spark):
    got = {r["page_id"]: r for r in op3_html(spark, SF).collect()}
    for p, u, h in read_table(spark, SF, "pages").collect():
        assert got[p]["text"] == simple(h) and got[p]["url"] == u and got[p]["n_chars"] == len(simple(h))


def page(i, extra=""):
    return f"<html><body><div class=x1><p>Our house style: always on top</p></div><div class=x2><p>Story {i} begins here and goes on {extra}</p><p>Part two of {i}</p></div><div class=x3><a href=/a>one</a></div></body></html>"


def test_template_of_a_host(spark):
    rows = [(i, "https://h.example/x", page(i)) for i in range(8)] + [(100 + i, "https://copies.example/", page(1)) for i in range(8)] + [(200, "https://single.example/", page(5))]
    df = spark.createDataFrame(rows, PAGES)
    known = {r["host"]: r for r in templates(df).collect()}
    assert len(known["h.example"]["constants"]) >= 1
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got[3] == "Story 3 begins here and goes on\nPart two of 3"
    assert "Story 1" in got[103] and "Story 5" in got[200]


def test_template_survives_odd_pages_and_repeats(spark):
    """A stub, a cut page, optional and repeated blocks and small hosts: each page is read by the classes that it has."""
    often = "<div class=x4><p>Read our other tales</p></div>"
    far = 'and tells of many a far land beyond the sea'
    rows = [(i, "https://h.example/x", page(i, far) + often * 2) for i in range(8)] + [(20 + i, "https://h.example/x", page(20 + i, far).replace("<div class=x2>", often + "<div class=x2>")) for i in range(4)]
    rows += [(90, "https://h.example/x", "<p>moved</p>"), (91, "https://h.example/x", page(91, far)[: page(91, far).index("<p>Part")])] + [(100 + i, "https://few.example/", page(i, far)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in [*range(8), *range(20, 24)]:
        assert got[i] == f"Story {i} begins here and goes on {far}\nPart two of {i}"
    assert got[90] == "moved" and got[91] == f"Story 91 begins here and goes on {far}"
    assert all(got[100 + i] == f"Story {i} begins here and goes on {far}\nPart two of {i}" for i in range(3))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (None, "not a url", "<article>x</article>"), (2, "http://[bad", ""), (3, "https://a.b/", "<article>y</article>"), (3, "https://a.b/", "<article>y</article>"), (4, "u", "<p>" + "long " * 200_000)]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in op3_html(spark, table(spark, tmp_path, "pages", rows, PAGES)).collect()), key=str)
    assert got == sorted([(1, "", 0), (None, "x", 1), (2, "", 0), (3, "y", 1), (3, "y", 1), (4, "long " * 199_999 + "long", 999_999)], key=str)
    assert op3_html(spark, table(spark, tmp_path, "pages", [], PAGES)).count() == 0

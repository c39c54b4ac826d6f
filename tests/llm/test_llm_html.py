import pytest

from groundscope.llm import html_text
from groundscope.llm.html_text import extract

CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a\n b<p>c &lt;d&gt; &#233;&nbsp;x &bogus;", "a b\n\nc <d> é x &bogus;"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>H</h1><p>one <b>two</b>"
     " th<i>ree</i>.<br>four</p><script>var a='</p>';</script><!-- no --></article><footer>f</footer></body></html>", "H\n\none two three. four"),
    ("<main><header><h1>Kept</h1></header><p>t</p><aside>no</aside><form><p>no</p></form></main>", "Kept\n\nt"),
    ("<article><p>a</p><div class=comments><p>no</p></div><div id='cookie-notice'>no</div><div class='comment-free'>no?</div></article>", "a"),
    ("<body><header>no</header><div class='content'><p>yes</p><ul><li>1<li>2</ul></div><div role=navigation>no</div></body>", "yes\n\n1\n\n2"),
    ("<p>unclosed <b>bold", "unclosed bold"), ("</div></p>stray<p/>x", "stray\n\nx"), ("<p>a < b and c</p>", "a < b and c"),
    ("<textarea><p>no</p></textarea><p>y</p><script>never closed <p>z", "y"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_extract(source, text):
    assert extract(source or "") == text


NAMES = [
    ('<div class="content with-sidebar"><article><p>real text</p></article></div>', "real text"),
    ('<div class="has-cookie-notice"><main><p>real text</p></main></div>', "real text"),
    ('<article><p>a</p><h2 id="related-work">b</h2><section id="legal">c</section><p class="social-history">d</p></article>', "a\n\nb\n\nc\n\nd"),
    ('<article><p>a</p><p class="x advert">no</p><section class="comments">no</section><section id="comments">no</section></article>', "a"),
    ('<div class="sidebar"><article>no</article></div><p>a</p>', "a"),
    ('<div class="with-sidebar"><article>no</article></div><article>a</article>', "a"),
]


@pytest.mark.parametrize("source, text", NAMES)
def test_names_of_elements(source, text):
    assert extract(source) == text


SILENT = [
    ("<article><p>a <svg class=x viewBox='0'/> b</p><p>c</p></article>", "a b\n\nc"), ("<p>x <math/> y</p><p>z</p>", "x y\n\nz"),
    ("<p>see <math><mi>n</mi><mo>+</mo><mn>1</mn></math> here</p>", "see n+1 here"), ("<p>a<object data=f>fallback</object></p>", "afallback"),
    ("<div><object><p>b</div><p>c</p>", "b\n\nc"), ("<div><select><option>no</div><p>yes</p>", "yes"),
    ("<div><select><option>no<option>no<p>yes</p></div><select><option>no</select>z", "yes\n\nz"),
    ("<p>a<svg><title>no</title><g><text>no</text><svg><g/></svg></g></svg>b</p>", "ab"), ("<svg><path><p>a</p><svg><text>no</text></svg><p>b</p>", "a\n\nb"),
    ("<svg><title/><foreignObject><p>no</p></foreignObject></svg><p>a</p>", "a"), ("<iframe src=x><p>a</p><iframe>no</iframe>b", "a\n\nb"),
    ("<noscript><p>a</p>", "a"), ("<noscript></div><p>no</p></noscript><template><div>no<template>no</template></template>a", "a"),
    ("a<svg><text>no</text>", "a"), ("<iframe/>a<svg/>b", "ab"),
]


@pytest.mark.parametrize("source, text", SILENT)
def test_silent_elements(source, text):
    assert extract(source) == text


@pytest.mark.parametrize("tag", ["font", "div", "li"])
def test_deep_pages(tag):
    n = 100_000
    for source in (f"<{tag}>" * n + "a" + "</b>" * n, f"<b><article><p>a</p>" + f"<{tag}>" * n + "</b>" * n):
        assert extract(source) == "a" and extract(source, frozenset([0])) == "a"
        assert len(html_text.subtrees(source)[1]) <= n + 1


def test_site_templates(spark):
    box = "<div><p>Read our other stories</p><p>every day</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<div><p>text {i}</p></div></body>") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body>{box}<p>other {i}</p></body>") for i in range(3)]
    rows += [(200 + i, "http://c.example/x", "<article><p>quoted everywhere</p></article>") for i in range(15)]
    rows += [(300, None, "<p>no url</p>"), (301, "no url", None), (301, "no url", None)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    assert got[3]["text"] == "text 3"
    assert got[101]["text"] == "Read our other stories\n\nevery day\n\nother 1"
    assert got[205]["text"] == "quoted everywhere" and got[300]["text"] == "no url" and got[301]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and html_text.main_text(pages).count() == len(rows)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_templates_of_a_large_host(spark):
    box = "<div><p>Offices are closed on Monday</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box if i < 15 else ''}<div><p>text {i}</p></div></body>") for i in range(200)]
    rows += [(300 + i, f"http://b.example/{i}", "<body><div><p>one page, fetched often</p></div></body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}" for i in range(200))
    assert all(got[300 + i] == "one page, fetched often" for i in range(20))


def test_pages_of_the_tables(spark):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks.append("") if tag in ("p", "h1", "article") else None
            self.blocks[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.blocks.append("") if tag in ("p", "h1", "article") else None

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r["html"])
        assert got[r["page_id"]] == "\n\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)

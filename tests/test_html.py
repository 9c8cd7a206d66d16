import random
import re
import time

import pytest
from pyspark.sql import functions as F

from crawlspark.functions.html import anchor_hrefs, boilerplate_chunks, boilerplate_mask, outside_boilerplate
from crawlspark.plans.export import with_text_and_title

X = F.col("x")

PAGES = {
    # html: (title, text)
    "<title>t</title><body>hi</body>": ("t", "hi"),
    "<html><head><title> T </title></head><body><h1>A <b>B</b></h1><p>x</p></body></html>": ("AB", "A\nB\nx"),
    "<body><nav>n<nav>deep</nav>still</nav><main>keep<footer>f</footer>it</main>after</body>": ("", "keep\nit"),
    "<title>t</title><body><article>a<article>inner</article>b</article><p>out</p></body>": ("t", "a\ninner\nb"),
    "<title>t</title><body><main></main><p>x</p></body>": ("t", ""),
    "<body><header><h1>gone</h1></header><h1></h1><h1>second</h1>x</body>": ("", "second\nx"),
    "<title>a<b>c</b></title><body>x</body>": ("", "x"),
    "<title>only</title>": ("only", ""),
    "": ("", ""),
    "<p>bare</p>text": ("", "bare\ntext"),
    "<body>a<!-- c -->b<script>if (a < b) '<p>'</script>c<style>x{}</style></body>": ("", "a\nb\nc"),
    "<body><!-- <script> -->kept<!-- </script> --></body>": ("", "kept"),
    "<body><script>var s = '<!--';</script>kept</body>": ("", "kept"),
    "<body>a\n\n\n\nb <p>&nbsp;</p><p>  </p>1 &lt; 2 &amp;amp; 3</body>": ("", "a\n\nb\n1 < 2 &amp; 3"),
    "<body><img alt=\"a > b\" src='x'>t < u<br/>v</body>": ("", "t < u\nv"),
    "<BODY><NAV>n</NAV><MAIN CLASS=\"m\">Big</MAIN></BODY>": ("", "Big"),
    "<body></nav>stray<noscript>no</noscript></body>": ("", "stray"),
    "<body><navigation>n</navigation><mainframe>m</mainframe></body>": ("", "n\nm"),
    "<body><header><nav>x</header>after header</body>": ("", "after header"),
    "<main>one</main><main>two</main>": ("", "one"),
    "<body><article>a<h1>H</h1></article></body>": ("H", "a\nH"),
    "<body>before<article>a</article><h1>outside</h1></body>": ("", "a"),
}


def test_titles_and_texts(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)], "i int, html string")
    got = [(r.title, r.text) for r in with_text_and_title(df).orderBy("i").collect()]
    wrong = [(h, g, w) for (h, w), g in zip(PAGES.items(), got) if g != w]
    assert wrong == []


def test_long_inputs_do_not_recurse(spark):
    """Attribute lists, blanks and unclosed elements of a megabyte stay linear."""
    big = 300_000
    pages = [
        "<body><p " + "a='1' " * big + ">x</p></body>", "<body>" + " " * (3 * big) + "x</body>",
        "<body>y<script>" + "<" * big, "<a " + "x " * big, "<body>" + "<p>z</p>" * 50_000 + "</body>",
        "<body>" + "<nav>" * 2000 + "n" + "</nav>" * 2000 + "w</body>",
    ]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, html string").repartition(4)
    rows = with_text_and_title(df.withColumn("n", F.size(anchor_hrefs(F.col("html"))))).orderBy("i").collect()
    assert [r.text for r in rows[:3]] == ["x", "x", "y"] and rows[4].text.count("z") == 50_000
    assert rows[5].text == "w" and all(r.n == 0 for r in rows)


@pytest.mark.parametrize("html,hrefs", [
    ("<a href=\"/x\">1</a><a class='c' href='y?a=1&amp;b=2'>2</a><A HREF=/z>3</A>", ["/x", "y?a=1&b=2", "/z"]),
    ("<a name=n>no</a><a data-href='d'>no</a><a title=\" href='q'\" href=\"r\">yes</a>", ["r"]),
    ("<!-- <a href='c'> --><script>'<a href=\"s\">'</script><nav><a href=''>e</a></nav>", [""]),
    ("<a\nhref = \"sp ace\" >x</a><abbr href='n'>", ["sp ace"]),
    ("<a href='1' href='2'>", ["1"]),
])
def test_anchors(values, html, hrefs):
    assert values(anchor_hrefs(X), [html]) == [hrefs]


PAGES_SILENT = {
    "<body>a<template>t<p>u</p></template>b</body>": "a\nb",
    "<body><ruby>kan<rp>(</rp><rt>ka</rt><rp>)</rp></ruby> x</body>": "kan\nx",
    "<body><ruby>kan<rt>ka</ruby> x<rtc>y</rtc></body>": "kan\nx\ny",
    "<body>a<template>never closed <b>x</b></body>": "a",
}


def test_silent_elements(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES_SILENT)], "i int, html string")
    assert [r.text for r in with_text_and_title(df).orderBy("i").collect()] == list(PAGES_SILENT.values())


def plain_outside(html):
    """The stack of boilerplate elements, tag by tag."""
    parts, stack, out = re.split(r"(?i)<(?=/?(?:nav|header|footer|noscript)[\s/>])", html), [], []
    for i, p in enumerate(parts):
        if i:
            name = re.match(r"/?(\w+)", p)[1].lower()
            if not p.startswith("/"):
                stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
        if not stack:
            out.append(p)
    return "<".join(out)


def test_boilerplate_against_a_stack(spark):
    rng = random.Random(1)
    tags = ["<nav>", "</nav>", "<header a='b'>", "</header>", "<FOOTER>", "</footer>", "<noscript>", "</noscript >", "t", "<p>"]
    pages = ["".join(rng.choice(tags) for _ in range(n)) for n in [*range(60), 5000, 5000, 9000]]
    pages += ["<nav>" * 3000 + "</nav>" * 2999 + "x</nav>y", "<nav>" * 2000 + "<header>" * 3000 + "</nav>" * 1999 + "</nav>y"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, html string")
    cut = df.withColumn("c", boilerplate_chunks(F.col("html"))).withColumn("m", boilerplate_mask(F.col("c")))
    got = [r.o for r in cut.select("i", outside_boilerplate(F.col("c"), F.col("m")).alias("o")).orderBy("i").collect()]
    assert got == [plain_outside(p) for p in pages]


@pytest.mark.parametrize("tag", ["h1", "title", "main", "article", "body", "nav", "header", "footer", "noscript", "template", "rt"])
def test_time_grows_with_the_number_of_tags(spark, tag):
    def seconds(n, shape):
        df = spark.createDataFrame([("<body>" + shape * n,)], "html string")
        start = time.perf_counter()
        with_text_and_title(df).collect()
        return time.perf_counter() - start

    for shape in (f"<{tag}>x</{tag}>", f"<{tag}>x"):
        seconds(100, shape)
        few, many = seconds(4_000, shape), seconds(64_000, shape)
        assert many < 32 * max(few, 0.25), (shape, few, many)

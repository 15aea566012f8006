import time

import pytest

from tonescope.sources.headlines import elements, headlines, page_headlines


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<h2>Intro words here <a>inner link words</a> and the rest of it</h2>", [("h2", "Intro words here inner link words and the rest of it"), ("a", "inner link words")]),
        ("<a href='x'><h3>Inside a link</h3> more</a> out", [("a", "Inside a link more"), ("h3", "Inside a link")]),
        ("<h1>One <em>two</em>three<br>four</h1>", [("h1", "One twothree four")]),
        ("<a><div>one</div><div>two</div></a>", [("a", "one two")]),
        ("<h1>Tom &amp; Jerry&nbsp;&#8211; caf&eacute; &lt;b&gt; &amp;lt; &am</h1>", [("h1", "Tom & Jerry – café <b> &lt; &am")]),
        ("<h1>wrong end</h2><p>text</p>", [("h1", "wrong end")]),
        ("<h1>first<h2>second</h2>", [("h1", "first"), ("h2", "second")]),
        ("<h1><div>outer <h2>inner</h2> tail</div> end</h1>x", [("h1", "outer inner tail end"), ("h2", "inner")]),
        ("<a>one <a>two</a> three", [("a", "one"), ("a", "two")]),
        ("<div><h1>open to the end of its box</div>after", [("h1", "open to the end of its box")]),
        ("<h1>open <b>to the end</h1> of <i>it", [("h1", "open to the end")]),
        ("<h1>never closed <b>at all", [("h1", "never closed at all")]),
        ("<b><h1>bold end inside</b> goes on</h1>", [("h1", "bold end inside goes on")]),
        ("<h1>a<script>var t = '</h1>';</script>b<style>h1{}</style><!-- </h1> -->c</h1>", [("h1", "abc")]),
        ('<a title="a > b" data-x=it\'s href=\'"\'>one > two</a><img alt="x>">', [("a", "one > two")]),
        ("<H1 class=x>Upper</H1 ><h1/>self closing is open</h1>", [("h1", "Upper"), ("h1", "self closing is open")]),
        ("<h4>not wanted</h4><abbr>x</abbr><h10>x</h10><h1></h1>", [("h1", "")]),
        ("</h1></a></p>stray<h1>ends</h1></div>", [("h1", "ends")]),
        ("<h1>less < than <3 and <", [("h1", "less < than <3 and <")]),
        ("<h1>cut <a href=", [("h1", "cut <a href=")]),
        ("<!-- <h1>no</h1> --><!doctype html><?x <h1>?><h1>yes</h1><!-- <h1>never closed</h1>", [("h1", "?>"), ("h1", "yes")][1:]),
        ("", []),
    ],
)
def test_nested_and_broken_pages(page, expected):
    assert elements(page) == expected


def test_lengths_and_places():
    long_, link = "w" * 201, "five whole words in this link"
    page = f"<h1>{'x' * 200}</h1><h1>{long_}</h1><h2>short</h2><a>{link}</a><a>four words fourteenlettersx</a><a>{long_} <h3>a heading in a link that is too long</h3></a>"
    assert headlines(page) == [("h1", "x" * 200), ("a", link), ("h3", "a heading in a link that is too long")]
    assert headlines(f"<h1>{'w ' * 101}</h1>") == []  # 201 characters with its spaces
    assert headlines(f"<h1> {'  w  ' * 100}</h1>") == [("h1", " ".join("w" * 100))]
    assert len(headlines("<h3>Another heading that is long enough</h3>" * 50)) == 40


def test_odd_pages_take_linear_time():
    began = time.time()
    for page in ("<a " * 200_000, "<a href=\"" * 100_000, "<h1><div>" * 50_000 + "text " * 50_000, "</div>" * 200_000, "<!--" * 200_000, "<h1>&amp" * 50_000):
        elements(page)
    assert time.time() - began < 20


def test_rows_of_pages(spark):
    html = "<H1>A heading with <b>many</b> useful\n words</H1><h2>short</h2><a href=x>one two three fourteenlettersx</a><a>five whole words in this link</a>" + "<h3>Another heading that is long enough</h3>" * 50
    df = spark.createDataFrame([("p", html), ("q", None), ("p", html), (None, html)], "page_id string, html string").selectExpr("page_id", "html", "1 AS tag")
    rows = page_headlines(df).collect()
    assert len(rows) == 120 and sum(r["page_id"] is None for r in rows) == 40 and {r["place"] for r in rows} == set(range(40))
    assert {(r["tag"], r["headline"]) for r in rows if r["place"] < 2} == {("h1", "A heading with many useful words"), ("a", "five whole words in this link")}
    assert page_headlines(df.limit(0)).count() == 0

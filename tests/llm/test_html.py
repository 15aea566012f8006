import numpy as np
import pytest

from tonescope.llm import html_extract as H

P = "<p>A paragraph of the article, with commas, and a full stop. It goes on for a while, as they do.</p>"


@pytest.fixture(scope="module")
def trees():
    return H.train_extractor()


def text_of(html, trees):
    return H.main_text([html], trees)[0]


def test_held_out_pages(trees):
    maker = H._Maker(12345)
    same = kept = dropped = wrong_kept = wrong_dropped = 0
    for _ in range(300):
        page, main = H.labelled_page(maker.page())
        found = H.decode(page.parent, trees.log_odds(H.features(page)))
        same += page.text(found) == page.text(main)
        size = np.bincount(np.array(page.piece_node, np.int64), weights=[len(p.strip()) for p in page.piece], minlength=len(page.parent))
        kept, dropped = kept + size[main].sum(), dropped + size[~main].sum()
        wrong_dropped, wrong_kept = wrong_dropped + size[main & ~found].sum(), wrong_kept + size[~main & found].sum()
    assert same >= 265 and wrong_dropped < 0.02 * kept and wrong_kept < 0.05 * dropped


BOXES = {
    "menu": '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a>Sport.</a></li></ul></nav>',
    "header": "<header><h2>The Daily Site</h2><p>News for all.</p></header>",
    "advert": '<div class="ad">Buy two, get one free.</div>',
    "sidebar": '<aside class="sidebar"><h3>Latest</h3><p>Something else happened, somewhere.</p></aside>',
    "notice": '<div id="cookie-notice"><p>We use cookies, as everyone does.</p><button>Accept</button></div>',
    "form": '<form action="/s"><label>Your mail</label><input name=q><button>Sign up</button></form>',
    "comments": '<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this a lot, thanks for writing it.</p></div><div class="comment"><p>Well, I did not. Not at all.</p></div></section>',
    "footer": "<footer>&copy; 2024 The Site &middot; All rights reserved.</footer>",
}


@pytest.mark.parametrize("name", sorted(BOXES))
@pytest.mark.parametrize("place", ["before", "after"])
@pytest.mark.parametrize("shell", ["<article><h1>The title</h1>{}</article>", '<div class="content"><h1>The title</h1>{}</div>'])
def test_boilerplate_goes(trees, name, place, shell):
    main = shell.format(P * 3)
    body = BOXES[name] + main if place == "before" else main + BOXES[name]
    want = "The title " + " ".join([H.Page(P).text(np.ones(9, bool))] * 3)
    assert text_of(f"<html><head><title>T</title></head><body>{body}</body></html>", trees) == want


def test_articles_of_one_word(trees):
    page = '<body><nav><ul><li><a href="/a">That</a></li><li><a href="/b">and</a></li></ul></nav><div class="ad">Ouan un ouer enleon de.</div><article><h1>Éaux.</h1><p>Éaux.</p></article><footer>&copy; a.example.com &middot; Ist der die ein.</footer></body>'
    assert text_of(page, trees) == "Éaux. Éaux."


def test_text_rules():
    def everything(html):
        page = H.Page(html)
        return page.text(np.ones(len(page.parent), bool))

    assert everything("a&amp;b &lt;i&gt; &#233;&#x20AC;&nbsp;x") == "a&b <i> é€ x"
    assert everything("<p>one<br>two<p>three <b>bo</b>ld</p>") == "one two three bold"
    assert everything("<script>x('</p>')</script>a<style>b</style><!-- c --><title>d</title>e<template>f</template>") == "ae"
    assert everything("<div title='a > b'>x</div><a href=\"y>z\">k</a><input value='<p>'>") == "x k"
    assert everything("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"
    assert everything("<p>never <b>closed") == "never closed" and everything("<!-- open") == "" and everything("a <script>b") == "a"
    assert everything("1 < 2 <3 a<") == "1 < 2 <3 a<" and everything("</p>x</div>") == "x" and everything("<![CDATA[a b]]>") == "a b"
    assert everything("<h2>a</h3>b<p>c") == "a b c" and H.Page("<h2>a</h3><p>c").parent == [-1, 0, 0]  # any heading's end tag ends the open one
    assert everything("") == everything(None) == "" and everything("<p title=\"open>text") in ("text", "")


def test_deep_and_long_pages(trees):
    assert text_of("<div>" * 3000 + "x" + "</div>" * 3000, trees) in ("x", "")
    assert len(text_of("<article>" + P * 3000 + "</article>", trees)) > 200_000


def test_decoding_is_closed_and_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 9
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.normal(size=n)
        kept = H.decode(parent, odds)
        best = max((sum(odds[i] for i in range(n) if m >> i & 1) for m in range(1, 2**n, 2) if all(m >> parent[i] & 1 for i in range(1, n) if m >> i & 1)))
        assert all(kept[parent[i]] for i in range(1, n) if kept[i]) and odds[kept].sum() == pytest.approx(best)


def test_boosting_equals_a_plain_version():
    rng = np.random.default_rng(5)
    n, rate, l2, depth = 300, 0.3, 2.0, 3
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 5, n), rng.integers(0, 2, n), rng.integers(0, 7, n)]).astype(np.float32)
    y = ((x[:, 0] + x[:, 1] > 2) ^ (rng.random(n) < 0.2)).astype(np.float64)
    weight = rng.uniform(5, 9, n)

    def grow(rows, g, h, level, out):
        best, split = 1e-6, None
        for j in range(x.shape[1]) if level else ():
            for v in np.unique(x[rows, j])[:-1]:
                low = rows & (x[:, j] <= v)
                high = rows & ~low
                if min(h[low].sum(), h[high].sum()) >= 1:
                    gain = sum(g[r].sum() ** 2 / (h[r].sum() + l2) * s for r, s in ((low, 1), (high, 1), (rows, -1)))
                    if gain > best + 1e-9:
                        best, split = gain, (low, high)
        if split is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        else:
            for part in split:
                grow(part, g, h, level - 1, out)

    share = (weight * y).sum() / weight.sum()
    z = np.full(n, np.log(share / (1 - share)))
    for _ in range(6):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(n)
        grow(np.ones(n, bool), weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), depth, step)
        z += step
    assert H.boost(x, y, weight, 6, depth, rate, l2=l2).log_odds(x) == pytest.approx(z, abs=1e-9)


def test_repeated_rows_and_one_hot_url(spark, trees):
    page = f"<nav><a href=/>Home</a></nav><article><h1>Title here</h1>{P}</article>"
    df = spark.createDataFrame([(1, "u", page)] * 40 + [(i, "u", None) for i in range(20)], "page_id long, url string, html string")
    rows = H.extract_main_text(df, trees=trees).collect()
    assert len(rows) == 60 and sum(r["text"].startswith("Title here A paragraph") for r in rows) == 40 and sum(r["text"] == "" for r in rows) == 20


def test_operator(spark, trees):
    df = spark.createDataFrame([(1, "u", f"<article><h1>Title here</h1>{P}</article>", "old"), (2, None, None, None), (3, "v", "", "x")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in H.extract_main_text(df, trees=trees).collect()}
    assert rows[1]["text"].startswith("Title here A paragraph") and rows[2]["text"] == "" == rows[3]["text"] and rows[1]["url"] == "u"
    assert H.extract_main_text(df.where("page_id > 9"), trees=trees).count() == 0


#: Pages written and labelled by hand, whose shapes the grammar learned after it had failed on them: (html, main text).
HAND = {
    "layout table": (
        "<html><head><title>Harbour</title></head><body><table width=100%><tr><td colspan=2><a href=/>Start</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr>"
        "<tr><td class=nav><ul><li><a href=/1>Boats</a><li><a href=/2>Weather</a><li><a href=/3>Tides</a></ul></td>"
        "<td class=content><h1>Old crane leaves the harbour</h1><p>The crane, which had stood at the northern quay since 1931, was taken apart on Monday. Workers needed four days for it.</p>"
        "<p>Its steel goes to a foundry inland, the harbour office said, and the winch to the museum.</p></td></tr><tr><td colspan=2><font size=1>&copy; Harbour Gazette. <a href=/i>Imprint</a></font></td></tr></table></body></html>",
        "Old crane leaves the harbour The crane, which had stood at the northern quay since 1931, was taken apart on Monday. Workers needed four days for it."
        " Its steel goes to a foundry inland, the harbour office said, and the winch to the museum.",
    ),
    "blog": (
        '<body><div id="masthead"><a href="/">My garden</a></div><div id="wrap"><div class="post"><h2>Beans again</h2><div class="entry"><p>I sowed the beans too early this year, and the frost took half of them in one night.</p>'
        "<blockquote><p>Never before the saints of ice, my grandmother used to say.</p></blockquote><ul><li>Runner beans: seven left, all of them small.</li><li>Bush beans: none, so I bought new seed.</li></ul></div></div>"
        '<div class="comments" id="comments"><h3>2 comments</h3><div class="comment"><p>Same here, sadly!</p></div><div class="comment"><p>Try fleece next time, it works for me.</p></div></div></div>'
        '<div class="sidebar widget"><h3>Archive</h3><ul><li><a href="/05">May</a></li><li><a href="/04">April</a></li></ul></div><script>track()</script></body>',
        "Beans again I sowed the beans too early this year, and the frost took half of them in one night. Never before the saints of ice, my grandmother used to say."
        " Runner beans: seven left, all of them small. Bush beans: none, so I bought new seed.",
    ),
    "main": (
        '<body><nav class="top"><a href="/">Home</a><a href="/w">World</a><a href="/s">Science</a></nav><div class="cookie-banner"><p>This site uses cookies.</p><button>OK</button></div><main><h1>Bats find their way by old roads</h1>'
        "<p>Bats that hunt at dusk follow hedges and old roads, a team reports, even where the hedges were cut down years ago.</p><h2>Maps in memory</h2>"
        "<p>The animals seem to keep a map, said the biologist who led the work; young ones learn it from flights with others.</p></main>"
        '<aside class="related"><h3>Read next</h3><ul><li><a href="/a">Owls in town</a></li></ul></aside><footer><p>All rights reserved.</p></footer></body>',
        "Bats find their way by old roads Bats that hunt at dusk follow hedges and old roads, a team reports, even where the hedges were cut down years ago. Maps in memory"
        " The animals seem to keep a map, said the biologist who led the work; young ones learn it from flights with others.",
    ),
}


@pytest.mark.parametrize("name", sorted(HAND))
def test_pages_labelled_by_hand(trees, name):
    html, main = HAND[name]
    assert text_of(html, trees) == main

#: More pages written and labelled by hand, before the grammar learned the shapes above; nothing was tuned on them. One fails.
OTHER = {
    "nested divisions": (
        '<html><body><div class="page"><div class="top"><div class="logo">Valley Post</div><div class="menu"><a href="/1">Local</a> <a href="/2">Sport</a> <a href="/3">Weather</a></div></div><div class="columns"><div class="left"><div class="story">'
        "<h1>Bridge opens after two years</h1><div><p>The bridge over the Lenn was opened to traffic on Friday, two years after the flood that carried off its middle pier.</p><p>Drivers had to take the road by the mill, eleven kilometres longer.</p></div>"
        '<div class="advert"><p>Tyres at half price, this week only!</p></div><div><p>The council paid a third of the cost. The rest came from the land, whose minister cut the ribbon.</p></div></div></div>'
        '<div class="right"><div class="widget"><h3>Most read</h3><ul><li><a href="/4">Cow on the line</a></li><li><a href="/5">New baker</a></li></ul></div></div></div><div class="bottom"><p>Copyright Valley Post. <a href="/6">Contact</a></p></div></div></body></html>',
        "Bridge opens after two years The bridge over the Lenn was opened to traffic on Friday, two years after the flood that carried off its middle pier. Drivers had to take the road by the mill, eleven kilometres longer."
        " The council paid a third of the cost. The rest came from the land, whose minister cut the ribbon.",
    ),
    "manual": (
        '<body><header><a href="/">tool</a><form action="/find"><input name="q"><button>Find</button></form></header><div class="layout"><nav class="toc"><ol><li><a href="#a">Install</a></li><li><a href="#b">Options</a></li></ol></nav><main id="content">'
        "<h1>Using the tool</h1><section><h2>Install</h2><p>Copy the archive to a folder of your own and unpack it there.</p><pre>tar xf tool.tar\ncd tool</pre></section>"
        "<section><h2>Options</h2><dl><dt>-v</dt><dd>Tells what is done, one line for each file.</dd><dt>-n</dt><dd>Does nothing, but tells what it would do.</dd></dl></section></main></div><footer><p>Made by hand.</p></footer></body>",
        "Using the tool Install Copy the archive to a folder of your own and unpack it there. tar xf tool.tar cd tool Options -v Tells what is done, one line for each file. -n Does nothing, but tells what it would do.",
    ),
    "old page": (
        "<HTML><BODY BGCOLOR=white><CENTER><A HREF=index.html>Back</A> | <A HREF=mail.html>Mail me</A></CENTER><HR><H1>My trip to the salt lakes</H1><P>We left at six in the morning, with two cars and too much water.<P>By noon the ground was white as far as one could see, and nobody spoke."
        "<P>The second car stayed behind at the well. Its driver, who knew the place, waited for us until night fell.<HR><FONT SIZE=-1>Last changed in May. <A HREF=mail.html>Write to me</A></FONT></BODY></HTML>",
        "My trip to the salt lakes We left at six in the morning, with two cars and too much water. By noon the ground was white as far as one could see, and nobody spoke."
        " The second car stayed behind at the well. Its driver, who knew the place, waited for us until night fell.",
    ),
    "comments inside": (
        '<body><div id="cookie"><p>We use cookies to count readers.</p><button>Fine</button></div><article class="post"><h1>Why bread rises</h1><p>Yeast eats sugar and gives off gas, and the dough keeps the gas in <em>bubbles</em> of gluten.</p><h3>Salt</h3><p>Salt slows the yeast, so it goes in late.</p>'
        '<ul><li>Two parts of water</li><li>Three parts of flour</li></ul><aside class="newsletter"><form><p>Get a letter each week.</p><input name="m"><button>Yes</button></form></aside><p>Let it stand overnight, covered, in a cool room.</p>'
        '<section class="comments"><h2>What readers say</h2><div class="comment"><p>Mine never rises, whatever I do with it.</p></div></section></article><footer>&copy; Kitchen notes</footer></body>',
        "Why bread rises Yeast eats sugar and gives off gas, and the dough keeps the gas in bubbles of gluten. Salt Salt slows the yeast, so it goes in late. Two parts of water Three parts of flour Let it stand overnight, covered, in a cool room.",
    ),
}


@pytest.mark.parametrize("name", [pytest.param(n, marks=[pytest.mark.xfail(strict=True, reason="bare links and lines between rules, in no element of their own")] * (n == "old page")) for n in sorted(OTHER)])
def test_other_pages_labelled_by_hand(trees, name):
    html, main = OTHER[name]
    assert text_of(html, trees) == main

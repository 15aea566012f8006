"""Headings and links of web pages with their whole texts, by a reader of tags that keeps the open elements on a stack."""

from __future__ import annotations

import html as references
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What counts as a headline on a page.
SHORTEST, LONGEST, LINK_WORDS, MOST = 25, 200, 5, 40
WANTED = frozenset(("h1", "h2", "h3", "a"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements without content, those whose content is no text of the page, those that misnested end tags leave open, and those that begin a line. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style title textarea noscript iframe noembed noframes template xmp".split())
FORMATTING = frozenset("b big code em font i nobr s small strike strong tt u".split())
LINES = HEADINGS | frozenset("address article aside blockquote br center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>""", re.S)


class Text:
    """The page's text as it is read, in parts; white space is one part at most between others."""

    def __init__(self):
        self.parts: list[str] = []
        self.solid = [0]  # characters other than white space before each part

    def add(self, text: str) -> None:
        solid = len("".join(text.split()))
        if solid or not self.parts or self.solid[-1] > self.solid[-2]:
            self.parts.append(text if solid else " ")
            self.solid.append(self.solid[-1] + solid)

    def between(self, begin: int, end: int, most: int) -> str | None:
        """White space collapsed; none if it is longer."""
        if self.solid[end] - self.solid[begin] > most:
            return None
        out = " ".join("".join(self.parts[begin:end]).split())
        return out if len(out) <= most else None


def elements(page: str, most: int = LONGEST) -> list[tuple[str, str]]:
    """(tag, text) of a page's h1, h2, h3 and a elements in the order in which they begin; none whose text is over ``most``.

    Each has its whole text, that of elements inside it too; a heading in a link and the link both count. Elements that
    begin a line part words, others don't; references are decoded; comments, scripts, styles and hidden texts are left out.
    Any heading's end tag ends the open heading and what is open in it, a link ends where another begins, other ends as
    HTML has them where tags nest; what is never closed goes on to the end of what it is in.
    """
    stack: list[tuple[str, int] | None] = []  # open elements with their number in ``found``; none where one was closed below others
    where: dict[str, list[int]] = defaultdict(list)  # the places of open elements by name
    found: list[list] = []  # tag, first part, part behind the last
    read = Text()

    def close(at: int) -> None:
        name, number = stack[at]
        stack[at] = None
        where[name].pop()  # the last of its name: it is what closes
        if number >= 0:
            found[number][2] = len(read.parts)
        while stack and stack[-1] is None:
            stack.pop()

    def close_down_to(at: int) -> None:
        while len(stack) > at:
            close(len(stack) - 1)

    at, end, closed = 0, len(page), page.rfind(">")
    while at < end:
        tag = TAG.search(page, at) if at <= closed else None
        if (raw := page[at : tag.start() if tag else end]) and any(where[w] for w in WANTED):
            read.add(references.unescape(raw) if "&" in raw else raw)
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in LINES:
            read.add(" ")
        if tag[1]:
            if name in HEADINGS:
                if (below := max((where[h][-1] for h in HEADINGS if where[h]), default=-1)) >= 0:
                    close_down_to(below)
            elif where[name]:
                if name == "a" or name in FORMATTING:
                    close(where[name][-1])
                else:
                    close_down_to(where[name][-1])
            continue
        if name in SILENT:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            continue
        if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if name == "a" and where["a"]:
            close(where["a"][-1])
        where[name].append(len(stack))
        stack.append((name, len(found) if name in WANTED else -1))
        if name in WANTED:
            found.append([name, len(read.parts), -1])
    close_down_to(0)
    texts = ((tag, read.between(begin, stop, most)) for tag, begin, stop in found)
    return [(tag, t) for tag, t in texts if t is not None]


def headlines(page: str, most: int = MOST) -> list[tuple[str, str]]:
    """The first elements of a page that look like headlines: of 25 to 200 characters, links of five words or more."""
    found = [(tag, t) for tag, t in elements(page) if len(t) >= SHORTEST and (tag != "a" or t.count(" ") >= LINK_WORDS - 1)]
    return found[:most]


def page_headlines(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = MOST) -> DataFrame:
    """(key, tag, headline, place): headings and links of a page that look like headlines, the first ``most`` of it.

    A null page has none. Rows go through Arrow batch by batch; nothing is shuffled.
    """
    kind = next(f for f in pages.schema if f.name == key)
    schema = T.StructType([T.StructField(key, kind.dataType), T.StructField("tag", T.StringType()), T.StructField("headline", T.StringType()), T.StructField("place", T.LongType())])

    def task(batches):
        for b in batches:
            at, tags, texts, places = [], [], [], []
            for i in range(b.num_rows):
                for place, (tag, text) in enumerate(headlines(b.column(1)[i].as_py() or "", most)):
                    at.append(i)
                    tags.append(tag)
                    texts.append(text)
                    places.append(place)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(tags, pa.string()), pa.array(texts, pa.string()), pa.array(places, pa.int64())], [key, "tag", "headline", "place"])

    return pages.select(key, html).mapInArrow(task, schema)

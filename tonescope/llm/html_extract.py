"""Main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page becomes a tree of its block elements (and of inline ones that carry a class, an id or a role). Every node gets
features: kind of tag, tokens of its attributes and of those above it, depth, text and link densities of its subtree,
and how it compares with its siblings. Boosted trees give each node's log-odds of holding main text. Decoding picks,
over whole trees, the labels with the greatest sum of log-odds in which no node is kept below one that is dropped.

The trees are trained here, on pages that a grammar makes with known labels: many layouts, with and without telling
tags and names, and with adverts, notices, forms and reader comments. Nothing is read from a corpus for it.

Text. Character references are decoded; scripts, styles, heads and comments are no text. Block boundaries and line
breaks part words; white space becomes one space; ends are trimmed. Defined results: a null or empty page, or one
without main text, gives an empty string; text that no element holds is kept; tags that never end run to the page's end.
"""

from __future__ import annotations

import functools
import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tune

# --- the tree -------------------------------------------------------------------------------

_QUOTED = r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:({_QUOTED})>|([^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@-][^\s=/>]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HEAD_END = re.compile(r"</head(?=[\s>])|<body(?=[\s>])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No text of theirs is ever shown as text.
SILENT = frozenset("script style template noscript title svg iframe canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag ends these open elements.
_LISTS, _CELLS = frozenset(("ul", "ol", "menu", "dl")), frozenset(("table",))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ENDS = {"li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), _LISTS), "dd": (frozenset(("dt", "dd")), _LISTS), "tr": (frozenset(("tr", "td", "th")), _CELLS), "td": (frozenset(("td", "th")), _CELLS), "th": (frozenset(("td", "th")), _CELLS), "option": (frozenset(("option",)), frozenset(("select",)))}

#: Kinds of tags that features tell apart.
KINDS = ["root html body", "article", "main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody thead tfoot tr td th caption", "nav", "header", "footer", "aside", "form fieldset", "figure figcaption picture", "blockquote pre", "button select option textarea input legend", "a", "span b i em strong label small"]
KIND_OF = {t: k for k, ts in enumerate(KINDS) for t in ts.split()}
#: Groups of tokens of class, id and role.
TOKENS = {
    "main": "article articlebody content main story entry post blogpost maincontent bodycopy hentry",
    "text": "body text copy paragraph prose intro lead summary caption",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip sitemap topbar toolbar",
    "head": "header masthead logo brand site sitename tagline hero",
    "foot": "footer foot copyright legal imprint colophon bottom credits",
    "side": "sidebar side aside rail widget widgets column secondary complementary",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp adbox adslot partner",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay dialog message toast banner privacy paywall",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reader readers responses thread",
    "share": "share sharing social follow twitter facebook like likes print",
    "related": "related recommended recommend more popular trending latest teaser teasers readmore also",
    "form": "form search login signin signup subscribe newsletter register contact input subscription mailing",
    "meta": "meta byline author date tags tag category categories timestamp info",
    "hidden": "hidden invisible none sr offscreen",
}
TOKEN_GROUP = {}
for _k, _ts in enumerate(TOKENS.values()):
    for _t in _ts.split():
        TOKEN_GROUP[_t] = TOKEN_GROUP.get(_t, 0) | 1 << _k
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
N_GROUPS = len(TOKENS)


@functools.lru_cache(maxsize=20_000)
def token_groups(attributes: str) -> int:
    """The groups, as bits, of the tokens in class, id, role and the like."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-component", "data-role"):
            value = m[2] or m[3] or m[4] or ""
            for part in _PARTS(value):
                found |= TOKEN_GROUP.get(part.lower(), 0)
        elif name == "aria-hidden" and "true" in (m[2] or m[3] or m[4] or ""):
            found |= TOKEN_GROUP["hidden"]
    return found


class Page:
    """Nodes in page order (node 0 is the root), and the page's pieces of text with their nodes."""

    def __init__(self, text: str | None):
        self.parent, self.tag, self.groups = [-1], ["root"], [0]
        self.inline = [False]
        self.piece_node: list[int] = []
        self.piece: list[str] = []
        self.linked: list[bool] = []
        if text:
            self._read(text)

    def _add(self, node: int, text: str, linked: bool) -> None:
        self.piece_node.append(node)
        self.piece.append(text)
        self.linked.append(linked)

    def _read(self, text: str) -> None:
        open_tags, open_nodes, link, at, end = ["root"], [0], 0, 0, len(text)
        match = _TOKEN.search
        lower = None
        while at < end:
            m = match(text, at)
            begin = m.start() if m else end
            if begin > at:
                s = text[at:begin]
                self._add(open_nodes[-1], html.unescape(s) if "&" in s else s, link > 0)
            if m is None:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._add(open_nodes[-1], m[0][9:-3], link > 0)
                continue
            tag, rest = tag.lower(), m[3] if m[3] is not None else m[4] or ""
            if m[1]:
                if tag == "a":
                    link = 0
                if tag in HEADINGS and tag not in open_tags:  # any of them ends the open one
                    tag = next((t for t in reversed(open_tags) if t in HEADINGS), tag)
                if tag in ("p", "br") and tag not in open_tags:
                    self._add(open_nodes[-1], " ", False)
                elif tag in open_tags[1:]:
                    k = len(open_tags) - 1 - open_tags[::-1].index(tag)
                    if tag not in INLINE:
                        self._add(open_nodes[-1], " ", False)
                        link = 0
                    elif any(t not in INLINE for t in open_tags[k + 1 :]):
                        continue  # an inline end tag does not close blocks
                    del open_tags[k:], open_nodes[k:]
                    if tag not in INLINE:
                        self._add(open_nodes[-1], " ", False)
                continue
            if tag in SILENT or tag == "head":
                if rest.endswith("/") and tag not in ("script", "style", "title", "head"):
                    continue
                if lower is None:
                    lower = text.lower()
                    if len(lower) != end:  # a letter whose small form is longer
                        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                if tag == "head":  # its end tag may be left out
                    found = _HEAD_END.search(lower, at)
                    if found is None:
                        continue
                    if found[0] == "<body":
                        at = found.start()
                        continue
                close = found.start() if tag == "head" else lower.find(f"</{tag}", at)
                stop = text.find(">", close) if close >= 0 else -1
                at = stop + 1 if stop >= 0 else end
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    self._add(open_nodes[-1], " ", False)
                continue
            block = tag not in INLINE
            if tag == "a":
                link = 1
            if block:
                closes, within = ENDS.get(tag, (frozenset(("p",)), frozenset(("td", "th", "button", "object"))))
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k] in closes:
                        del open_tags[k:], open_nodes[k:]
                        if tag not in ENDS or open_tags[-1] not in closes:
                            break
                    elif open_tags[k] in within or (closes == {"p"} and open_tags[k] not in INLINE):
                        break
                if tag != "a":
                    link = 0
                self._add(open_nodes[-1], " ", False)
            groups = token_groups(rest) if "=" in rest else 0
            if rest.endswith("/") and not block:
                continue
            node = open_nodes[-1]
            if block or groups:
                node = len(self.parent)
                self.parent.append(open_nodes[-1])
                self.tag.append(tag)
                self.groups.append(groups)
                self.inline.append(not block)
            open_tags.append(tag)
            open_nodes.append(node)
            if block:
                self._add(node, " ", False)

    def text(self, kept: np.ndarray) -> str:
        return " ".join("".join([p for n, p in zip(self.piece_node, self.piece) if kept[n]]).split())


# --- features -------------------------------------------------------------------------------

NUMBERS = ["depth", "log_text", "log_own", "link_share", "text_share", "log_nodes", "text_per_node", "children", "paragraphs", "stops", "place", "before", "siblings", "sibling_ratio", "same_tag", "parent_link_share", "own_share", "controls", "items", "has_h1", "words_per_stop", "next_text", "previous_text"]
N_FEATURES = 2 * len(KINDS) + 2 * N_GROUPS + len(NUMBERS)


def features(page: Page) -> np.ndarray:
    n = len(page.parent)
    parent = np.array(page.parent)
    kind = np.array([KIND_OF.get(t, 4) for t in page.tag])
    bits = np.array(page.groups, np.int64)
    node = np.array(page.piece_node, np.int64)
    size = np.array([len(p) - p.count(" ") for p in page.piece], np.float64)
    stops = np.array([p.count(".") + p.count(",") + p.count("!") + p.count("?") for p in page.piece], np.float64)
    linked = np.array(page.linked, bool)
    own = np.bincount(node, weights=size, minlength=n)
    whole = np.stack([own, np.bincount(node, weights=size * linked, minlength=n), np.bincount(node, weights=stops, minlength=n), np.ones(n), kind == 5, kind == 18, kind == 9, kind == 6]).astype(np.float64)
    depth, above, groups_above = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, 0, -1):  # children come after their parents
        whole[:, parent[i]] += whole[:, i]
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | 1 << int(kind[p])
        groups_above[i] = groups_above[p] | bits[p]
    text, links, stop, nodes, paras, controls, items, h1 = whole
    children = np.bincount(parent[1:], minlength=n)
    up = np.maximum(parent, 0)
    total = max(text[0], 1.0)
    share = links / np.maximum(text, 1)
    # siblings, in order
    order = np.lexsort([np.arange(n), parent])
    place, following, previous = np.zeros(n), np.zeros(n), np.zeros(n)
    same = np.roll(parent[order], 1) == parent[order]
    same[0] = False
    previous[order[1:]] = np.where(same[1:], text[order[:-1]], 0)
    following[order[:-1]] = np.where(same[1:], text[order[1:]], 0)
    firsts = np.flatnonzero(~same)
    place[order] = np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))
    key = up * 64 + kind
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    before = np.zeros(n)
    piece_before = np.cumsum(size) - size
    seen = np.full(n, -1.0)
    firsts = np.unique(node, return_index=True)
    seen[firsts[0]] = piece_before[firsts[1]]
    last = 0.0
    for i in range(n):
        last = seen[i] if seen[i] >= 0 else last
        before[i] = last
    sib = np.maximum(children[up], 1)
    mean_other = (text[up] - own[up] - text) / np.maximum(sib - 1, 1)
    numbers = np.stack([
        depth, np.log1p(text), np.log1p(own), share, text / total, np.log1p(nodes), np.log1p(text / nodes), np.log1p(children), np.log1p(paras), stop / np.maximum(text, 1),
        place / sib, before / total, np.log1p(sib), np.log1p(text) - np.log1p(np.maximum(mean_other, 0)), count[inverse] / sib, share[up], own / np.maximum(text, 1), np.log1p(controls), items / nodes, h1 > 0, np.log1p(text / (stop + 1)), np.log1p(following), np.log1p(previous),
    ], 1)
    k, g = np.arange(len(KINDS)), np.arange(N_GROUPS)
    return np.concatenate([kind[:, None] == k, (above[:, None] >> k) & 1, (bits[:, None] >> g) & 1, (groups_above[:, None] >> g) & 1, numbers], 1).astype(np.float32)


# --- boosted trees --------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: feature and threshold of inner nodes, and the leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int, depth: int, rate: float, bins: int = 32, l2: float = 2.0) -> Trees:
    """Second-order boosting for the logistic loss on binned features; no randomness."""
    n, d = x.shape
    flags = np.array([bool(np.isin(x[:, j], (0, 1)).all()) for j in range(d)])
    edges = [np.array([0.5]) if flags[j] else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    numbers = np.flatnonzero(~flags)
    cell = np.stack([np.searchsorted(edges[j], x[:, j], side="left") + j * bins for j in numbers], 1)
    # of flags only the set ones are counted: few of a row are
    set_row, set_flag = np.nonzero(x * flags)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    share = float((weight * y).sum() / weight.sum())
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node, above = np.zeros(n, np.int64), None
        for level in range(depth):
            width = 2**level
            place = node - (width - 1)
            # the smaller child of each node is counted; the other is what the node has besides
            rows_of = np.bincount(place, minlength=width).reshape(-1, min(width, 2))
            counted = np.arange(width) % 2 == np.repeat(rows_of.argmin(1), min(width, 2))
            some, some_set = counted[place], counted[place[set_row]]
            slot = (place[some][:, None] * d * bins + cell[some]).ravel()
            slot_set = (place[set_row] * d * bins + set_flag * bins + 1)[some_set]
            whole = [np.bincount(place, weights=v, minlength=width)[:, None, None] for v in (g, h)]
            sums = []
            for k, v in enumerate((g, h)):
                c = np.bincount(slot, weights=np.repeat(v[some], len(numbers)), minlength=width * d * bins) + np.bincount(slot_set, weights=v[set_row[some_set]], minlength=width * d * bins)
                c = c.reshape(width, d, bins)
                c[:, flags, 0] = whole[k][:, :, 0] - c[:, flags, 1]
                if level:
                    c[~counted] = above[k] - c[counted]
                sums.append(c)
            above = sums
            left = [v.cumsum(2)[:, :, :-1] for v in sums]
            right = [w - v for w, v in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
            gain[(left[1] < 1) | (right[1] < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins - 1)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, width - 1 + k], threshold[t, width - 1 + k] = j, edges[j][b]
            rows = np.arange(n)
            node = 2 * node + 1 + (x[rows, feature[t][node]] > threshold[t][node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + l2)
        z += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


# --- decoding -------------------------------------------------------------------------------


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The labels of greatest total log-odds in which a kept node's parent is kept; the root is."""
    value = odds.astype(np.float64).copy()
    for i in range(len(parent) - 1, 0, -1):
        if value[i] > 0:
            value[parent[i]] += value[i]
    kept = np.zeros(len(parent), bool)
    kept[0] = True
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and value[i] > 0
    return kept


# --- training pages -------------------------------------------------------------------------


class _Maker:
    """Pages with known main text. Boilerplate is between the marks \\x01 and \\x02, which no page shows."""

    def __init__(self, seed: int):
        self.r, self.full_stop = random.Random(seed), "."
        self.syllables = ["ba", "co", "de", "fi", "gu", "ha", "ke", "li", "mo", "nu", "pre", "ra", "st", "ti", "un", "vo", "ä", "é", "on", "er"]

    def words(self, n: int) -> list[str]:
        return ["".join(self.r.choices(self.syllables, k=self.r.randint(1, 4))) for _ in range(n)]

    def title(self, low=2, high=9) -> str:
        return " ".join(self.words(self.r.randint(low, high))).capitalize() + self.r.choice(["", "", "", ".", "!", "?"])

    def prose(self, low=5, high=60) -> str:
        w, out = self.words(self.r.randint(low, high)), []
        while w:
            k = self.r.randint(3, 14)
            s = w[:k]
            if len(s) > 5 and self.r.random() < 0.5:
                s[self.r.randrange(2, len(s) - 1)] += ","
            out.append(" ".join(s).capitalize() + self.full_stop)
            w = w[k:]
        text = " ".join(out)
        if self.r.random() < 0.2:
            text = f"<b>{text}</b>" if self.r.random() < 0.5 else text.replace(" ", ' <a href="/x">', 1).replace(".", "</a>.", 1)
        elif self.r.random() < 0.08:
            text = text.replace(" ", self.r.choice([' <a class="external" href="/x">', ' <span class="caps">', ' <em class="x">']), 1) + self.r.choice(["</a>", "</span>", "</em>"])
        return text

    def attr(self, names: str, chance: float = 0.75) -> str:
        if self.r.random() > chance:
            return self.r.choice(["", "", f' class="{self.r.choice("abcxyz")}{self.r.randint(1, 99)}"', ' style="margin:0"'])
        name = self.r.choice(names.split())
        name = self.r.choice([name, name, f"{name}-{self.r.choice(['box', 'wrap', 'inner', 'area', 'block', 'list'])}", f"{self.r.choice(['page', 'site', 'js', 'c', 'the'])}-{name}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def drop(self, text: str) -> str:
        return f"\x01{text}\x02"

    def element(self, tag: str, names: str, inside: str, chance: float = 0.75) -> str:
        return f"<{tag}{self.attr(names, chance)}>{inside}</{tag}>"

    def links(self, low=2, high=12) -> str:
        ends = self.r.choice([[""], [""], ["", ".", ","], ["", "", "!", "?"]])
        words = [self.r.choice([w, w.capitalize(), w.upper()]) + self.r.choice(ends) for w in self.words(self.r.randint(low, high))]
        if self.r.random() < 0.3:
            words = [w + " " + self.title(1, 5) for w in words]
        items = [f'<a href="/{w}">{w}</a>' for w in words]
        if self.r.random() < 0.15:
            items = words  # entries that are no links
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if style < 0.75 else " " if style < 0.9 else "").join(items)

    def box(self) -> str:
        """One piece of boilerplate."""
        r = self.r
        return self.drop(r.choice([self.menu, self.advert, self.advert, self.sidebar, self.notice, self.form, self.comments, self.share, self.related, self.header, self.footer, self.meta])())

    def menu(self) -> str:
        return self.element(self.r.choice(["nav", "nav", "div", "ul"]), TOKENS["menu"], self.links(), 0.5) if self.r.random() < 0.6 else self.element("div", TOKENS["menu"], self.links(), 1)

    def advert(self) -> str:
        return self.element(self.r.choice(["div", "div", "aside", "section", "p"]), TOKENS["ad"], self.r.choice([self.prose(3, 40), f'<a href="/ad">{self.title()}</a>', f"<p>{self.prose(3, 30)}</p>", f'<h3>{self.title()}</h3><p>{self.prose(4, 30)}</p><a href="/buy">{self.title(1, 3)}</a>']), 1)

    def sidebar(self) -> str:
        inside = "".join(self.r.choice([f"<h3>{self.title()}</h3>{self.links()}", f"<p>{self.prose(4, 40)}</p>", f"<h4>{self.title()}</h4><p>{self.prose(4, 30)}</p>"]) for _ in range(self.r.randint(1, 4)))
        return self.element("aside", TOKENS["side"], inside, 0.6) if self.r.random() < 0.6 else self.element("div", TOKENS["side"], inside, 1)

    def notice(self) -> str:
        inside = self.r.choice([self.prose(5, 40), f"<p>{self.prose(5, 40)}</p>", f"<p>{self.prose(4, 25)}</p><button>{self.title(1, 2)}</button>"])
        return self.element(self.r.choice(["div", "div", "section", "aside", "p"]), TOKENS["notice"], inside, 1) if self.r.random() < 0.85 else f'<div role="{self.r.choice(["alert", "dialog"])}">{inside}</div>'

    def form(self) -> str:
        inside = f"<label>{self.title(1, 4)}</label><input type=text>" + self.r.choice(["", f"<p>{self.prose(3, 20)}</p>", f"<select><option>{self.title(1, 2)}<option>{self.title(1, 2)}</select>", f"<textarea>{self.title(1, 4)}</textarea>"]) + f"<button>{self.title(1, 2)}</button>"
        form = self.element("form", TOKENS["form"], inside, 0.5)
        return form if self.r.random() < 0.6 else self.element("div", TOKENS["form"], f"<p>{self.prose(3, 25)}</p>{form}", 1)

    def comments(self) -> str:
        r = self.r
        style = r.choice(["div", "li", "article", "p", "section"])
        each = [(f"<{style}{self.attr('comment reply')}>" + r.choice(["", f"<b>{self.title(1, 2)}</b>", f"<h4>{self.title(1, 3)}</h4>", f'<span class="author">{self.title(1, 2)}</span>']) + (self.prose(3, 60) if style == "p" else f"<p>{self.prose(3, 60)}</p>") + f"</{style}>") for _ in range(r.randint(1, 8))]
        inside = "".join(each)
        inside = f"<ol>{inside}</ol>" if style == "li" else inside
        return self.element(r.choice(["section", "div", "div", "aside"]), TOKENS["comment"], r.choice(["", f"<h2>{self.title(1, 3)}</h2>", f"<h3>{self.title(1, 3)}</h3>"]) + inside, 1)

    def share(self) -> str:
        return self.element("div", TOKENS["share"], self.links(2, 6), 1)

    def related(self) -> str:
        inside = f"<h3>{self.title(1, 3)}</h3>" + self.r.choice([self.links(), "".join(f'<div><a href="/r">{self.title()}</a><p>{self.prose(4, 15)}</p></div>' for _ in range(self.r.randint(2, 5)))])
        return self.element(self.r.choice(["div", "section", "aside"]), TOKENS["related"], inside, 1)

    def header(self) -> str:
        inside = self.r.choice([f"<h1>{self.title(1, 3)}</h1>", f'<a href="/">{self.title(1, 3)}</a>', f"<h2>{self.title(1, 3)}</h2><p>{self.title(3, 8)}.</p>", self.title(1, 4)]) + self.r.choice(["", f"<nav>{self.links()}</nav>", f"<p>{self.prose(3, 12)}</p>"])
        return self.element("header", TOKENS["head"], inside, 0.5) if self.r.random() < 0.7 else self.element("div", TOKENS["head"], inside, 1)

    def footer(self) -> str:
        inside = self.r.choice([f"&copy; {self.title(1, 3)} &middot; {self.prose(3, 20)}", f"<p>&copy; {self.prose(3, 20)}</p>", self.links(), f"<p>{self.prose(3, 30)}</p>{self.links(2, 6)}"])
        return self.element("footer", TOKENS["foot"], inside, 0.4) if self.r.random() < 0.7 else self.element("div", TOKENS["foot"], inside, 1)

    def meta(self) -> str:
        return self.element("div", TOKENS["meta"], self.r.choice([self.title(1, 5), self.links(1, 4)]), 1)

    def block(self) -> str:
        """One piece of main text."""
        r, k = self.r, self.r.random()
        if k < 0.68:
            p = self.prose(r.choice([1, 4, 8]), r.choice([8, 40, 120, 300]))
            return r.choice([f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"<div>{p}</div>" if r.random() < 0.3 else f"<p>{p}</p>"])
        if k < 0.78:
            level = r.randint(2, 4)
            return f"<h{level}>{self.title()}</h{level if r.random() < 0.95 else 2}>"
        if k < 0.86:
            kind = r.choice(["ul", "ul", "ol", "dl"])
            if kind == "dl":
                return "<dl>" + "".join(f"<dt>{self.title(1, 3)}</dt><dd>{self.prose(3, 25)}</dd>" for _ in range(r.randint(2, 5))) + "</dl>"
            return f"<{kind}>" + "".join(f"<li>{self.prose(3, 25)}" + r.choice(["", "</li>"]) for _ in range(r.randint(2, 6))) + f"</{kind}>"
        if k < 0.91:
            return f"<blockquote><p>{self.prose()}</p></blockquote>" if r.random() < 0.7 else f"<pre>{' '.join(self.words(r.randint(3, 20)))}</pre>"
        if k < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.title(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<figure><img src=a.png><figcaption>{self.prose(4, 15)}</figcaption></figure>"

    def bare(self) -> str:
        """Boilerplate that only its place, its shortness and its links tell."""
        r = self.r
        inside = r.choice([self.links(2, 5), f"&copy; {self.title(1, 4)}", f"&copy; {self.title(1, 3)} {self.links(1, 3)}", f"{self.title(2, 6)} {self.links(1, 2)}"])
        return r.choice(["<{0}>{1}</{0}>", "<{0}><font size=1>{1}</font></{0}>", "<{0}><small>{1}</small></{0}>"]).format(r.choice(["p", "div", "center"]), inside)

    def body(self) -> str:
        """The main text, with its headline, in its element."""
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6, 10, 18, 30]))]
        headline = f"<h{(level := r.choice([1, 1, 1, 2]))}>{self.title(2, 14)}</h{level}>" if r.random() < 0.8 else ""
        if r.random() < 0.08:  # pages of a few words
            headline, blocks = f"<h1>{self.title(1, 3)}</h1>", [r.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}"]).format(self.title(1, 4))]
        if r.random() < 0.35:
            for _ in range(r.randint(1, 2)):
                blocks.insert(r.randint(0, len(blocks)), self.drop(r.choice([self.advert, self.share, self.related, self.notice, self.sidebar, self.form])()))
        parted = r.random()
        if parted < 0.12:  # parts with headings of their own
            cuts = sorted(r.sample(range(len(blocks) + 1), min(len(blocks), r.randint(1, 3))))
            parts = [blocks[i:j] for i, j in zip([0, *cuts], [*cuts, len(blocks)])]
            tag = r.choice(["section", "section", "div"])
            blocks = [f"<{tag}{self.attr('section part chapter', 0.3)}>" + (f"<h2>{self.title()}</h2>" if r.random() < 0.7 else "") + "".join(p) + f"</{tag}>" for p in parts if p]
        text = "".join(blocks)
        if 0.12 < parted < 0.32:  # the headline stands beside the body
            text = self.element(r.choice(["div", "div", "section"]), TOKENS["main"] + " text body", text, 0.8)
        if r.random() < 0.12:
            text += self.drop(self.comments())
        text, shape = headline + text, r.random()
        if shape < 0.4:
            return self.element("article", "article post entry hentry story", text, 0.3)
        if shape < 0.58:
            return self.element("main", "content main", text, 0.4)
        return self.element(r.choice(["div", "section"]), TOKENS["main"] + " text body", text, 0.85) if shape < 0.9 else text

    def table(self, front: list[str], text: str, back: list[str]) -> str:
        """A page whose columns are cells of a table."""
        r = self.r
        end = r.choice(["</td>", "</td>", ""])
        row = [f"<td{self.attr(TOKENS['main'], 0.5)}>{text}</td>"]
        for _ in range(r.choice([0, 1, 1, 2])):
            side = r.choice([self.links, self.sidebar, self.menu, self.advert])()
            row.insert(r.randint(0, len(row)), f"<td{self.attr(TOKENS['menu'] + ' ' + TOKENS['side'], 0.5)}>{self.drop(side)}{end}")
        wide = "".join(f"<tr><td colspan={len(row)}>{x}{end}</tr>" for x in front)
        low = "".join(f"<tr><td colspan={len(row)}>{x}{end}</tr>" for x in back)
        return f"<table{r.choice(['', ' width=100%', ' border=0'])}>{wide}<tr>{''.join(row)}</tr>{low}</table>"

    def page(self) -> str:
        r = self.r
        self.full_stop = r.choice([".", ".", ".", ".", "", "!!", " |", "%%%"])
        text = self.body()
        front = [self.drop(f()) for f in (self.header, self.menu, self.advert, self.notice, self.form) if r.random() < 0.35]
        back = [self.drop(f()) for f in (self.comments, self.related, self.sidebar, self.share, self.form, self.notice, self.advert, self.footer) if r.random() < 0.3]
        if r.random() < 0.4:
            front, back = [self.drop(self.menu()), self.drop(self.advert())], [self.drop(self.footer())]
        r.shuffle(front)
        if r.random() < 0.15:
            back = [*[self.box() for _ in range(2)], *back]
        if r.random() < 0.12:
            front = [self.drop(r.choice([self.bare(), self.links(2, 6)])), *front]
        if r.random() < 0.12:
            back = [*back, self.drop(self.bare())]
        if r.random() < 0.1:
            text, front, back = self.table(front, text, back), [], []
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            if r.random() < 0.3:  # the nearest boxes share the main text's wrapper
                a, b = r.randint(0, len(front)), r.randint(0, len(back))
                text, front, back = "".join(front[a:]) + text + "".join(back[:b]), front[:a], back[b:]
            text = self.element(r.choice(["div", "div", "main", "section"]), "content main wrapper wrap container page site layout columns", text, 0.6)
        between = r.choice(["", "", "", "<hr>", "\n"])
        return f"<!DOCTYPE html><html><head><title>{self.title()}</title><style>p{{}}</style></head><body>{between.join([*front, text, *back])}" + r.choice(["</body></html>", "</body></html>", ""])


def labelled_page(text: str) -> tuple[Page, np.ndarray]:
    """A maker's page, and whether each node's subtree holds main text."""
    page = Page(text)
    level, main = 0, np.zeros(len(page.parent), bool)
    pieces = []
    for node, piece in zip(page.piece_node, page.piece):
        out = []
        for c in piece:
            if c == "\x01":
                level += 1
            elif c == "\x02":
                level -= 1
            else:
                out.append(c)
                if not level and not c.isspace():
                    main[node] = True
        pieces.append("".join(out))
    page.piece = pieces
    for i in range(len(page.parent) - 1, 0, -1):
        main[page.parent[i]] |= main[i]
    return page, main


def training_rows(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    maker = _Maker(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page, main = labelled_page(maker.page())
        held = np.bincount(np.array(page.piece_node, np.int64), weights=[len(p) for p in page.piece], minlength=len(page.parent))
        xs.append(features(page))
        ys.append(main)
        ws.append(1 + np.log1p(held) / 2)
    return np.concatenate(xs), np.concatenate(ys).astype(np.float64), np.concatenate(ws)


@functools.lru_cache(maxsize=2)
def train_extractor(pages: int = 1000, seed: int = 11) -> Trees:
    return boost(*training_rows(pages, seed), trees=100, depth=5, rate=0.2)


# --- the operator ---------------------------------------------------------------------------


def main_text(html_texts: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(t) for t in html_texts]
    rows = [features(p) for p in pages]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, x in zip(pages, rows):
        out.append(page.text(decode(page.parent, odds[at : at + len(x)])))
        at += len(x)
    return out


def extract_main_text(df: DataFrame, column: str = "html", keep: list[str] | None = None, trees: Trees | None = None) -> DataFrame:
    """df (or its columns ``keep``) with ``text``, the main text of each page, in place of a column of that name."""
    tune(df.sparkSession)
    names = [c for c in (df.columns if keep is None else keep) if c != "text"]
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField("text", T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(trees or train_extractor())

    def extract(batches):
        for b in batches:
            pages = b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, 64):
                some = pages.slice(at, 64)
                text = main_text(some.to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, 64) for c in b.columns[:-1]], pa.array(text, pa.string())], names=schema.names)

    return df.select(*names, df[column].cast("string").alias("_html")).mapInArrow(extract, schema)

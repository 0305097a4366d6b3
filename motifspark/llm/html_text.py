"""Operator 3: main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with every run of text as a leaf. Each node is content or not; its own features
(tag, hashed class, id and role words, links, length) and its parent's state decide. Sum-product messages upward and downward give the
exact marginal of each node, and runs of text with a marginal of at least one half are the main text. The weights are those
of a conditional random field fitted on labelled pages; `labelled_pages` makes such pages in many layouts.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML's element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist textarea button option optgroup".split())
HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# a tag ends at the first > outside of a quoted value; a quote that never ends is an ordinary character
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD_BUCKETS = 1 << 14  # of hashed class, id and role words


@dataclass
class Node:
    parent: int
    tag: str
    words: frozenset = frozenset()
    role: str = ""
    text: str | None = None  # of a leaf
    linked: int = 0
    chars: int = 0
    links: int = 0
    label: int | None = None
    kept: float = field(default=0, repr=False)


class Page:
    """Reads a page of any quality into nodes, parents before children; leaves are in page order.

    Takes time in proportion to the page: open elements are counted by tag, so tags that match nothing are told at once.
    """

    def __init__(self, label: str | None = None):
        self.nodes, self.open = [Node(-1, "body")], [0]
        self.opened: Counter[str] = Counter()  # tags of open elements
        self.hidden: list[str] = []  # open elements whose text is not seen, and block elements opened in those
        self.unseen: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked, self.in_link = 0, 0
        self.label, self.labels = label, [0]

    def read(self, html: str) -> list[Node]:
        at, size = 0, len(html)
        while at < size:
            left = html.find("<", at)
            left = size if left < 0 else left
            if left > at:
                self.data(html[at:left])
            if left == size:
                break
            if m := TAG.match(html, left + 1):
                at = m.end()
                end, tag = m[1], m[2].lower()
                if end:
                    self.end(tag)
                    continue
                self.start(tag, m[3])
                if tag in RAW:  # all up to its end tag is no markup
                    close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                    at = close.start() if close else size
            elif html.startswith("<!--", left):
                end = html.find("-->", left + 4)
                at = size if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), left):  # declarations of any kind
                end = html.find(">", left + 2)
                at = size if end < 0 else end + 1
            elif left + 1 < size and html[left + 1].isascii() and html[left + 1].isalpha():
                break  # a tag that the page ends in
            else:
                self.data("<")
                at = left + 1
        self._flush()
        return self.nodes

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.data(" ")
        if tag in ("body", "html") or self.hidden == ["head"] and tag not in HEAD:
            self._show()  # a head ends where its end tag should be
        if tag in ("body", "html"):
            return
        if tag in VOID or tag in UNSEEN or self.hidden:
            if tag in UNSEEN or self.hidden and tag not in VOID and tag not in INLINE:
                self.hidden.append(tag)
                self.unseen[tag] += 1
            elif tag == "hr" and not self.hidden:
                self._flush()
            return
        if tag in INLINE:
            self.in_link += tag == "a"
            return
        self._flush()
        self.in_link = 0
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], HOLDS[tag])
        have: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            have.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
        words = frozenset(x.lower() for k in ("class", "id") for x in WORDS.findall(have.get(k, "")))
        self.nodes.append(Node(self.open[-1], tag, words, have.get("role", "").lower()))
        self.open.append(len(self.nodes) - 1)
        self.opened[tag] += 1
        self.labels.append(int(have[self.label]) if self.label in have else self.labels[-1])

    def end(self, tag: str) -> None:
        if tag in INLINE:
            self.in_link -= tag == "a" and self.in_link > 0
        elif self.hidden and self.unseen[tag]:
            # an unseen element ends with all that was opened in it, another one up to the last of its kind
            while self.unseen[tag]:
                last = self.hidden.pop()
                self.unseen[last] -= 1
                if last == tag and tag not in UNSEEN:
                    break
        elif self.opened[tag]:
            self._show()  # what was opened in the element ends with it
            self._flush()
            self.in_link = 0
            while self.nodes[self.open[-1]].tag != tag:
                self._pop()
            self._pop()

    def _show(self) -> None:
        self.hidden.clear()
        self.unseen.clear()

    def _pop(self) -> None:
        self.opened[self.nodes[self.open.pop()].tag] -= 1
        self.labels.pop()

    def _close(self, tags: set[str], walls: set[str]) -> None:
        """End the innermost open elements of these kinds, up to an element that holds them apart."""
        if not any(self.opened[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[k]].tag
            if tag in walls:
                return
            if tag in tags:
                while len(self.open) > k:
                    self._pop()
            elif tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "tbody"):
                return

    def data(self, data: str) -> None:
        if not self.hidden:
            data = unescape(data)
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            leaf = Node(self.open[-1], "#", text=text, linked=min(self.linked, len(text)), label=self.labels[-1])
            self.nodes.append(leaf)
        self.parts, self.linked = [], 0


def read_page(html: str, label: str | None = None) -> list[Node]:
    nodes = Page(label).read(html)
    kept = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.text is not None:
            n.chars, n.links = len(n.text), n.linked
            kept[i] += n.chars * (n.label or 0)
        if n.parent >= 0:
            nodes[n.parent].chars += n.chars
            nodes[n.parent].links += n.links
            kept[n.parent] += kept[i]
    if label:
        for n, k in zip(nodes, kept, strict=True):
            n.label = int(2 * k > n.chars)
    return nodes


def features(n: Node, nodes: list[Node]) -> list[str]:
    share = n.links / n.chars if n.chars else 0.0
    link = "none" if share == 0 else "few" if share < 0.3 else "some" if share < 0.7 else "most"
    if n.text is not None:
        up = nodes[n.parent].tag
        size = min(8, int(math.log2(len(n.text) + 1)))
        ends = "leaf ends" if n.text[-1] in ".!?:;\"”»)" else "leaf open"
        return ["leaf", f"leaf link {link}", f"leaf size {size}", f"leaf in {_kind(up)}", ends, *["leaf sign"] * (n.text[0] == "©")]
    out = ["node", f"tag {_kind(n.tag)}", f"link {link}", f"{_kind(n.tag)} link {link}", f"{_kind(n.tag)} in {_kind(nodes[n.parent].tag) if n.parent >= 0 else '-'}", f"size {min(10, int(math.log2(n.chars + 1)))}"]
    out += ["named"] if n.words else ["unnamed"]
    return out + [_hashed("word", w) for w in n.words] + ([_hashed("role", n.role)] if n.role else [])


def _kind(tag: str) -> str:
    return "heading" if tag in HEADINGS else tag


def _hashed(kind: str, word: str) -> str:
    return f"{kind} {zlib.crc32(word.encode('utf-8', 'replace')) % WORD_BUCKETS}"


EDGES = ("leaf", "named", "plain")  # kinds of a node's bond with its parent: a part without a name rather follows its parent


def _edge(n: Node) -> str:
    return "leaf" if n.text is not None else "named" if n.words or n.role else "plain"


def marginals(nodes: list[Node], weights: dict[str, float], found: list[list[str]] | None = None) -> tuple[list[float], list[list[str]], list[tuple[str, list[float]]]]:
    """Probability of content of each node, the nodes' features, and the joint marginals (edge kind, 2x2) of the edges."""
    n = len(nodes)
    found = found or [features(x, nodes) for x in nodes]
    own = [[0.0, sum(weights.get(f, 0.0) for f in fs)] for fs in found]
    pair = {k: [[weights.get(f"{k} {a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)] for k in EDGES}
    up = [[0.0, 0.0] for _ in nodes]  # message to the parent
    below = [x[:] for x in own]
    for i in range(n - 1, 0, -1):
        p, t, b = nodes[i].parent, pair[_edge(nodes[i])], below[i]
        for a in (0, 1):
            x, y = b[0] + t[a][0], b[1] + t[a][1]
            up[i][a] = max(x, y) + math.log1p(math.exp(-abs(x - y)))
            below[p][a] += up[i][a]
    total = [x[:] for x in below]
    out, joints = [0.0] * n, []
    for i in range(n):
        if i:
            p, t = nodes[i].parent, pair[_edge(nodes[i])]
            rest = [total[p][a] - up[i][a] for a in (0, 1)]
            joint = [rest[a] + t[a][b] + below[i][b] for a in (0, 1) for b in (0, 1)]
            top = max(joint)
            e = [math.exp(x - top) for x in joint]
            z = sum(e)
            joints.append((_edge(nodes[i]), [x / z for x in e]))
            for b in (0, 1):
                x, y = rest[0] + t[0][b], rest[1] + t[1][b]
                total[i][b] = below[i][b] + max(x, y) + math.log1p(math.exp(-abs(x - y)))
        d = total[i][0] - total[i][1]
        out[i] = 1 / (1 + math.exp(min(700, d)))
    return out, found, joints


def fit(pages: list[str], label: str = "data-y", rounds: int = 10, rate: float = 0.3, shrink: float = 1e-3, seed: int = 4) -> dict[str, float]:
    """Weights by stochastic gradient ascent of the conditional likelihood; labels are an attribute of the pages' elements.

    A page at a time, with steps by the gradients that a feature has had (Duchi, Hazan, Singer 2011).
    """
    trees = [(nodes, [features(n, nodes) for n in nodes]) for nodes in (read_page(x, label) for x in pages)]
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(trees)
        for nodes, found in trees:
            p, _, joints = marginals(nodes, weights, found)
            gradient: dict[str, float] = {}
            for n, q, fs in zip(nodes, p, found, strict=True):
                for f in fs:
                    gradient[f] = gradient.get(f, 0.0) + n.label - q
            for n, (kind, joint) in zip(nodes[1:], joints, strict=True):
                seen = 2 * nodes[n.parent].label + n.label
                for j in range(4):
                    f = f"{kind} {j >> 1}{j & 1}"
                    gradient[f] = gradient.get(f, 0.0) + (j == seen) - joint[j]
            for f, g in gradient.items():
                g -= shrink * weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return weights


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The runs of text that are more likely content than not, joined by two line feeds."""
    nodes = read_page(html or "")
    p, _, _ = marginals(nodes, weights)
    return "\n\n".join(n.text for n, q in zip(nodes, p, strict=True) if n.text is not None and q >= 0.5)


# What sites call the parts of their pages. The pages below are made of these names; the model sees them only there.
PART_NAMES = {
    "nav": "nav navbar navigation menu main-menu menubar topnav breadcrumb breadcrumbs nav-links pagination pager toc skip-links tabs dropdown",
    "header": "header site-header masthead topbar page-header branding logo-bar banner-top",
    "footer": "footer site-footer bottom-bar colophon copyright legal imprint footer-links",
    "ad": "ad ads advert adverts advertisement ad-slot adsense banner promo promotion promoted sponsor sponsored commercial",
    "notice": "notice cookie-notice cookies consent gdpr alert announcement popup modal overlay paywall warning-bar",
    "form": "search search-form newsletter subscribe subscription signup login register contact-form feedback",
    "aside": "sidebar side widget widget-area rail right-column toolbar author-box info-box",
    "share": "share social sharing follow social-links share-buttons likes",
    "comments": "comments comment-list discussion replies responses respond disqus reader-comments guestbook",
    "related": "related recommended recommendations trending popular more-stories read-next also-like",
}
TEXT_NAMES = "article article-body content main main-content post post-body entry entry-content story story-text body text prose page-text document"
PLAIN_NAMES = "row col container wrapper inner outer grid box block left right center clearfix x7 css-1ab2c module panel"
PART_TAGS = {"nav": ["nav", "div", "ul", "p"], "header": ["header", "div"], "footer": ["footer", "div"], "ad": ["div", "aside", "section"], "notice": ["div", "section", "p"]}
PART_TAGS |= {"form": ["form", "div"], "aside": ["aside", "div", "td"], "share": ["div", "ul", "p"], "comments": ["section", "div", "ol"], "related": ["section", "aside", "div"]}
PART_ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "search", "notice": "alert"}


class Maker:
    """Makes labelled pages: parts in any order and nesting, named or not, with the attribute data-y on what is (1) or isn't (0) main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("ta ri mon el su ve dor ka in pe lo na ce".split()) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def lines(self, low: int, high: int, count: int = 1) -> str:
        return " ".join(self.words(low, high).capitalize() + self.r.choice("....?!") for _ in range(count))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def wrap(self, tag: str, inner: str, names: str = "", named: float = 0.75, more: str = "") -> str:
        own = f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names.split())}"' if names and self.r.random() < named else ""
        return f"<{tag}{own}{more}>{inner}</{tag}>"

    def listed(self, low: int, high: int) -> str:
        """Links as a list, as runs in a line, or as paragraphs."""
        links = [self.link() for _ in range(self.r.randint(low, high))]
        form = self.r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
        return " | ".join(links) if form < 0.85 else "".join(f"<div>{x}</div>" for x in links)

    def paragraph(self) -> str:
        """A block of main text."""
        r, form = self.r, self.r.random()
        if form < 0.1:
            return self.wrap(f"h{r.randint(2, 4)}", self.words(1, 8))
        if form < 0.2:
            return f"<p>{self.lines(5, 25)} {self.link(1, 4)} {self.lines(4, 20)}"  # with a tag left open
        if form < 0.27:
            return self.wrap(r.choice(("ul", "ol")), "".join(f"<li>{self.words(2, 14)}" for _ in range(r.randint(2, 6))))
        if form < 0.31:
            return f"<blockquote><p>{self.lines(8, 30)}</p></blockquote>"
        if form < 0.34:
            return f'<figure><img src="x.png"><figcaption>{self.lines(3, 10)}</figcaption></figure>'
        if form < 0.37:
            return "<table>" + f"<tr><td>{self.words(1, 3)}<td>{self.words(1, 3)}" * r.randint(1, 4) + "</table>"
        if form < 0.39:
            return f"<pre>{self.words(3, 14)}</pre>"
        if form < 0.42:
            return self.wrap("div", self.lines(4, 25, r.randint(1, 4)))
        if form < 0.47:
            return f"<p>{r.choice((self.words(2, 9), self.lines(1, 2), r.choice('abcxyz').upper() + '.'))}</p>"
        if form < 0.52:
            return f"<p><em>{self.lines(4, 14)}<br>{self.lines(3, 12)}</em>"
        return f"<p>{self.lines(4, 25, r.randint(1, 6))}</p>"

    def part(self, kind: str) -> str:
        """A part that is no main text."""
        r = self.r
        if kind in ("nav", "share", "related"):
            inner = (self.wrap("h3", self.words(1, 3)) if kind == "related" else self.words(0, 2)) + self.listed(2, 9)
        elif kind == "header":
            inner = f"{self.link(1, 2)}{self.wrap('p', self.words(2, 7))}{self.listed(2, 5) if r.random() < 0.4 else ''}"
        elif kind == "footer":
            sign = r.choice(("&copy;", "©", "(c)", "")) + f" {r.randint(1990, 2030)}"
            inner = r.choice((f"<p>{sign} {self.words(1, 4)}</p>", f"{sign} {self.lines(2, 9)}", self.listed(2, 5), f"{self.lines(3, 12)} {self.link()}"))
        elif kind == "ad":
            inner = r.choice((self.lines(2, 16), f"<p>{self.lines(3, 22)}</p>", self.link(2, 8), f"{self.lines(2, 9)} {self.link(1, 3)}"))
        elif kind == "notice":
            inner = f"<p>{self.lines(5, 25)}</p>{r.choice(('', '<button>ok</button>', self.link()))}"
        elif kind == "form":
            inner = f"<p>{self.words(2, 8)}</p><label>{self.words(1, 2)}</label><input name=q><button>{self.word()}</button>"
        elif kind == "aside":
            text = f"<p>{self.lines(5, 25)}</p>"
            inner = self.wrap("h3", self.words(1, 3)) + r.choice((self.listed(3, 7), text, text + self.listed(2, 4)))
        else:
            one = r.choice(("div", "li", "article", "p"))
            said = [f"<b>{self.word()}</b> {self.lines(3, 20, r.randint(1, 3))}" for _ in range(r.randint(1, 5))]
            said = [x if one == "p" else f"<{one}{' class=comment' * (r.random() < 0.5)}><p>{x}</p></{one}>" for x in said]
            inner = (self.wrap("h2", self.words(1, 3)) if r.random() < 0.7 else "") + "".join(x if one != "p" else f"<p>{x}</p>" for x in said)
        role = f' role="{PART_ROLES[kind]}"' if kind in PART_ROLES and r.random() < 0.2 else ""
        tag = r.choice(PART_TAGS[kind])
        return self.wrap(tag, inner, PART_NAMES[kind], 0.5 if tag in ("nav", "header", "footer", "form", "aside") else 0.85, role + " data-y=0")

    def parts(self, kinds: str, chance: float) -> list[str]:
        return [self.part(k) for k in kinds.split() if self.r.random() < chance]

    def page(self) -> str:
        r = self.r
        blocks = [self.paragraph() for _ in range(r.choice((0, 0, 1, 1, 1, 2, 2, 3, *range(1, 15))))]
        for _ in range(r.choice((0, 0, 1, 2))):
            blocks.insert(r.randrange(len(blocks) + 1), self.part(r.choice(("ad", "share", "form", "aside", "related"))))
        title = f"<h1>{self.words(2, 9)}</h1>" if r.random() < 0.85 or not blocks else ""
        text = (self.wrap("header", title) if title and r.random() < 0.15 else title) + "".join(blocks)
        form = r.random()
        if form < 0.45:
            text = self.wrap(r.choice(("article", "article", "main")), text, TEXT_NAMES, 0.4, " data-y=1")
        elif form < 0.82:
            text = self.wrap(r.choice(("div", "div", "section")), text, f"{TEXT_NAMES} {PLAIN_NAMES}", 0.8, r.choice((" data-y=1", ' data-y=1 role="main"')))
        else:
            text = self.wrap("td", text, TEXT_NAMES, 0.3, " data-y=1")
        before, after = self.parts("header nav notice ad nav form", 0.45), self.parts("share related comments aside form ad", 0.35)
        beside = self.parts("aside nav ad", 0.3)
        if text.startswith("<td"):
            cells = [x if x.startswith("<td") else f"<td data-y=0>{x}</td>" for x in beside]
            plain = [f"<td data-y=0>{r.choice((self.listed(1, 6), '<br>'.join(self.link() for _ in range(r.randint(2, 6)))))}</td>" for _ in range(3)]
            top = f"<tr>{plain[0]}</tr>" if r.random() < 0.5 else ""
            cells += [x for x in plain[1:] if r.random() < 0.4]
            text = f"<table>{top}<tr>{''.join(cells[:2])}{text}{''.join(cells[2:])}</tr></table>"
        else:
            text = "".join(beside[:1]) + text + "".join(beside[1:])
            for _ in range(r.choice((0, 0, 1, 2))):
                text = self.wrap("div", text, PLAIN_NAMES, 0.7)
        foot = self.part("footer") if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{''.join(before)}{text}{''.join(after)}{foot}</body></html>"


def labelled_pages(count: int = 600, seed: int = 9) -> list[str]:
    """Made-up pages with the attribute data-y: 1 on elements of the main text, 0 on the others."""
    maker = Maker(seed)
    return [maker.page() for _ in range(count)]


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """pages with a column text: the main text of the whole page, empty if there is none; null html counts as empty.

    Repeated rows are read one by one; the other columns are not looked at and stay (one named text is replaced).
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def text(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in htmls:
            yield pd.Series([main_text(x if isinstance(x, str) else None, shared.value) for x in some], dtype=object)

    return pages.withColumn("text", text(F.col(html_col)))

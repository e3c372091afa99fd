"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element is content or not. A node has a potential from its features (tag, words of class, id
and role, link density, length, sentences and a few telling words of its text, place among its
siblings), and every parent-child edge one from the two labels and the kind of the child. Sum-product
messages go up the tree and down again, which gives the exact marginal of each node; text is kept where
the element that holds it is more likely content than not. The weights are trained on labelled pages by
the gradient of the log likelihood (observed minus expected features, the expectations from the same
messages). The pages are drawn with telling, neutral and misleading names and with plain ``div`` layouts,
so that no single name decides.
"""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.common import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
#: Elements that never show text of the page itself.
HIDDEN = frozenset("head script style noscript template iframe object svg canvas math audio video select option datalist textarea title noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key closes an open element of these kinds (optional end tags).
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",),
}
BOUNDARY = frozenset("ul ol dl table article section aside nav main header footer div body html form blockquote td th".split())
SHUTS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP, NAME, EQUALS, BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}
NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
SPACE = re.compile(r"\s+")
#: Kinds of elements that edges tell apart.
KINDS = {tag: kind for kind, tags in {
    "text": "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary address",
    "group": "ul ol dl table tbody thead tfoot tr figure details fieldset menu", "box": "div section article main body html center", "side": "nav aside footer header form dialog button label",
}.items() for tag in tags.split()}
#: Telling words of short texts.
CUES = ("©", "copyright", "rights reserved", "cookie", "subscribe", "newsletter", "sign up", "log in", "advert", "sponsored", "share", "comment", "reply", "privacy", "imprint", "impressum", "datenschutz", "droits", "derechos", "read more", "follow us")
CUE = re.compile("|".join(map(re.escape, CUES)))
#: Short lines that announce what readers say: all that follows within the same box comes after one.
TALK = re.compile(r"(?:\d+\s+)?(?:leave a |post a |add a )?(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?|commentaires?|comentarios?)(?:\s*\(\d+\))?:?", re.IGNORECASE)
STOP = re.compile(r"[.!?…。！？](?=\s|$|[\"'”»)])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "chars", "linked", "talk", "beside")

    def __init__(self, tag: str, attrs: list[tuple[str, str]], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list[str | Node] = []  # text and block or hidden children, in page order
        self.chars = self.linked = 0  # characters of text below, and of those within links
        self.beside = 0  # characters of the largest other child of its parent
        self.talk = 0  # 1 behind a line that announces comments, 2 for an element that begins with one


def attributes(source: str, at: int) -> tuple[list[tuple[str, str]], bool, int] | None:
    """Attributes of a tag from ``at`` on, whether it closes itself, and where it ends; None where the page ends within it.

    The states are those of HTML: quotes only count at the start of a value. A value whose quote never
    ends, ends with the tag. Every character is passed once.
    """
    found: list[tuple[str, str]] = []
    while True:
        at = GAP.match(source, at).end()
        if at >= len(source):
            return None
        if source[at] == ">":
            return found, source[at - 1] == "/", at + 1
        m = NAME.match(source, at)
        name, at = m[0].lower(), m.end()
        eq, value = EQUALS.match(source, at), ""
        if eq:
            at = eq.end()
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote:
                stop = source.find(quote, at + 1)
                if stop < 0:
                    stop = source.find(">", at + 1)
                    if stop < 0:
                        return None
                    value, at = source[at + 1 : stop], stop
                else:
                    value, at = source[at + 1 : stop], stop + 1
            else:
                m = BARE.match(source, at)
                value, at = m[0], m.end()
        found.append((name, value))


class Path:
    """The open elements, with their places by tag, so that the nearest of a kind is found at once."""

    def __init__(self, root: Node) -> None:
        self.open = [root]
        self.places: dict[str, list[int]] = {}
        self.walls = [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BOUNDARY:
            self.walls.append(len(self.open))
        self.open.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in BOUNDARY:
                self.walls.pop()

    def nearest(self, tag: str, beyond: bool = False) -> int:
        """The place of the innermost open ``tag``, 0 if there is none (or only ``beyond`` a boundary)."""
        own = self.places.get(tag)
        return own[-1] if own and (beyond or own[-1] >= self.walls[-1]) else 0


def parse(source: str) -> Node:
    """The element tree of a page, tolerant of missing, stray and broken tags, in time linear in the page.

    Inline elements are folded into the element around them (their text, not their box, matters),
    except that text within links is counted. What follows an unfinished tag at the end is markup.
    """
    root = Node("#page", [], None)
    path, link, at, end = Path(root), 0, 0, len(source)

    def add(text: str) -> None:
        now = path.open[-1]
        now.parts.append(text)
        size = len(text) - text.count(" ")
        now.chars += size
        if link:
            now.linked += size

    while at < end:
        hit = source.find("<", at)
        if hit < 0:
            add(source[at:])
            break
        after = source[hit + 1 : hit + 2]
        shut = after == "/"
        name = TAG_NAME.match(source, hit + 1 + shut)
        if name is None and not (after in ("!", "?", "/") and after):
            add(source[at : hit + 1])
            at = hit + 1
            continue
        if hit > at:
            add(source[at:hit])
        if name is None:  # comments, declarations, and what is read like them
            for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if source.startswith(start, hit):
                    stopped = source.find(stop, hit + len(start))
                    at = stopped + len(stop) if stopped >= 0 else end
                    break
            continue
        tag = name[0].lower()
        if source[name.end() : name.end() + 1] == ">":
            attrs, selfclosed, at = [], False, name.end() + 1
        else:
            rest = attributes(source, name.end())
            if rest is None:
                break
            attrs, selfclosed, at = rest
        if shut:
            if tag == "a":
                link = 0
            if tag == "p" and not path.nearest("p"):
                now = path.open[-1]
                now.parts.append(_child(now, "p", []))  # a stray </p> is an empty paragraph
            elif tag not in INLINE and tag not in VOID and (place := path.nearest(tag, beyond=True)):
                path.cut(place)
                link = 0
            continue
        if tag == "a":
            link = 1
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                path.open[-1].parts.append(" " if tag != "wbr" else "")
            continue
        if tag in SHUTS_P and (place := path.nearest("p")):
            path.cut(place)
        for old in CLOSES.get(tag, ()):
            if place := path.nearest(old):
                path.cut(place)
        now = path.open[-1]
        child = _child(now, tag, attrs)
        now.parts.append(child)
        if tag in RAW:
            stopped = RAW_END[tag].search(source, at)
            at = stopped.end() if stopped else end
        elif tag not in VOID and not selfclosed:
            path.push(child)
            link = 0
    return root


def _child(parent: Node, tag: str, attrs: list[tuple[str, str]]) -> Node:
    child = Node(tag, attrs, parent)
    parent.children.append(child)
    return child


def in_order(root: Node) -> list[Node]:
    """All visible elements, parents before children; sums of characters are passed up."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag not in HIDDEN:
            out.append(node)
            stack += reversed(node.children)
    for node in reversed(out):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in out:
        behind = node.talk == 1
        sizes = sorted((c.chars for c in node.children), reverse=True)[:2]
        for k, child in enumerate(node.children):
            child.beside = sizes[child.chars == sizes[0]] if len(sizes) > 1 else 0
            said = child.chars <= 40 and TALK.fullmatch("".join(x for x in child.parts if isinstance(x, str)).strip()) is not None
            if behind or said:
                child.talk = 1
            if said and k == 0:
                node.talk = node.talk or 2
            behind = behind or said
    return out


def node_features(node: Node) -> tuple[str, ...]:
    """Features of an element; all words of its names count, however many there are."""
    parent = node.parent
    found = {"bias", f"tag={node.tag}", f"in={parent.tag if parent else ''}>{node.tag}"}
    for name, value in node.attrs:
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for token in value.split():
                words = [w.lower() for w in NAME_WORD.findall(token)]
                found.update(f"name={w}" for w in words)
                found.add("whole=" + "-".join(words))
        elif name in ("hidden", "aria-hidden"):
            found.add("hidden")
    density = node.linked / node.chars if node.chars else 0.0
    found.add(f"links={min(4, int(density * 5))}")
    size, other = ((n > 0) + (n > 15) + (n > 80) + (n > 400) for n in (node.chars, node.beside))
    found |= {f"chars={size}", f"chars={size}<{other}", f"{node.tag}={size}<{other}"}
    text = " ".join(x for x in node.parts if isinstance(x, str))
    stops = sum(1 for _ in STOP.finditer(text))
    found.add(f"stops={min(stops, 3)}")
    found.add(f"talk={node.talk}")
    if node.chars <= 240 and text and not text.isspace():
        found.update(f"cue={c}" for c in CUE.findall(text.lower()))
    if parent is not None and len(parent.children) > 1:
        if parent.children[0] is node:
            found.add(f"first={min(size, 2)}")
        if parent.children[-1] is node:
            found.add(f"last={min(size, 2)}")
    return tuple(sorted(found))


Label = tuple[str, int, int]


class TreeModel:
    """Weights of node features and of edges (kind of the child, parent label, child label)."""

    def __init__(self) -> None:
        self.node: dict[str, float] = {}
        self.edge: dict[Label, float] = {(kind, i, j): 0.5 if i == j else -0.5 for kind in ("other", *set(KINDS.values())) for i in (0, 1) for j in (0, 1)}
        self._known: dict[tuple[str, ...], float] = {}

    def potential(self, features: tuple[str, ...]) -> float:
        """Log potential of "content" (that of "not content" is 0)."""
        found = self._known.get(features)
        if found is None:
            if len(self._known) > 50_000:
                self._known.clear()
            found = self._known[features] = sum(self.node.get(f, 0.0) for f in features)
        return found

    def edges(self, node: Node) -> tuple[float, float, float, float]:
        """Log potentials of the edge above ``node`` for (parent, child) = 00, 01, 10, 11."""
        kind = KINDS.get(node.tag, "other")
        return self.edge[kind, 0, 0], self.edge[kind, 0, 1], self.edge[kind, 1, 0], self.edge[kind, 1, 1]

    def marginals(self, nodes: list[Node], features: list[tuple[str, ...]] | None = None) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """P(content) of each node, and P(parent, child) of its edge upward, by two passes of messages."""
        at = {id(n): i for i, n in enumerate(nodes)}
        above = [at[id(n.parent)] if n.parent is not None else -1 for n in nodes]
        own = [self.potential(f) for f in features or map(node_features, nodes)]
        edge = [self.edges(n) for n in nodes]
        size = len(nodes)
        up0, up1 = [0.0] * size, own[:]  # beliefs from below
        msg0, msg1 = [0.0] * size, [0.0] * size
        for i in range(size - 1, 0, -1):
            e00, e01, e10, e11 = edge[i]
            msg0[i] = _logsum(e00 + up0[i], e01 + up1[i])
            msg1[i] = _logsum(e10 + up0[i], e11 + up1[i])
            j = above[i]
            up0[j] += msg0[i]
            up1[j] += msg1[i]
        full0, full1 = up0[:], up1[:]  # beliefs from everywhere
        pairs = [(0.0, 0.0, 0.0, 0.0)] * size
        for i in range(1, size):
            e00, e01, e10, e11 = edge[i]
            j = above[i]
            rest0, rest1 = full0[j] - msg0[i], full1[j] - msg1[i]
            joint = (rest0 + e00 + up0[i], rest0 + e01 + up1[i], rest1 + e10 + up0[i], rest1 + e11 + up1[i])
            top = max(joint)
            weights = [math.exp(x - top) for x in joint]
            total = sum(weights)
            pairs[i] = tuple(w / total for w in weights)
            full0[i] = up0[i] + _logsum(rest0 + e00, rest1 + e10)
            full1[i] = up1[i] + _logsum(rest0 + e01, rest1 + e11)
        return [1 / (1 + math.exp(min(500.0, max(-500.0, a - b)))) for a, b in zip(full0, full1, strict=True)], pairs

    def fit(self, pages: list[tuple[list[Node], list[int]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Adagrad ascent on the log likelihood of the labels, page by page."""
        grown: dict = {}
        seen_features = [[node_features(n) for n in nodes] for nodes, _ in pages]

        def move(table: dict, key, d: float) -> None:
            d -= decay * table.get(key, 0.0)
            grown[key] = grown.get(key, 1.0) + d * d
            table[key] = table.get(key, 0.0) + rate * d / math.sqrt(grown[key])

        for _ in range(rounds):
            for (nodes, labels), features in zip(pages, seen_features, strict=True):
                self._known.clear()
                p, pairs = self.marginals(nodes, features)
                at = {id(n): i for i, n in enumerate(nodes)}
                for i, n in enumerate(nodes):
                    d = labels[i] - p[i]
                    if abs(d) > 1e-3:
                        for f in features[i]:
                            move(self.node, f, d)
                    if n.parent is not None:
                        kind, seen = KINDS.get(n.tag, "other"), (labels[at[id(n.parent)]], labels[i])
                        for k, (u, v) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                            move(self.edge, (kind, u, v), (((u, v) == seen) - pairs[i][k]) / 8)
        self._known.clear()


def _logsum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


#: Kinds of labelled pages: articles of paragraphs, boxes of bare text, articles that are lists of links, layout tables, comments in boxes without names.
PAGE_KINDS = ("article", "bare", "links", "table", "talk")


def labelled_page(seed: int, kind: str | None = None) -> tuple[str, set[str]]:
    """A page of a drawn (or given) kind from templates, and the ``data-n`` marks of its content elements.

    A third of the pages are plain: their boxes are ``div`` elements with neutral names or none. Content
    boxes of other pages have misleading names now and then.
    """
    r = random.Random(seed)
    content: set[str] = set()
    marks = iter(range(1 << 30))
    drawn = r.choices(PAGE_KINDS, (54, 11, 15, 10, 10))[0]
    kind = kind or drawn
    plain = r.random() < (0.35 if kind == "article" else 0.7)
    neutral = ("c1", "c2", "a", "b", "x", "box", "inner", "outer", "col", "block", "txt", "s3", "wrap", "row", "z9", "left", "main-2", "u", "grid", "cell")

    def letters() -> str:
        return "".join(r.choices("abcdefghilmnoprstuvé", k=r.randint(2, 9)))

    def words(least: int, most: int) -> str:
        return " ".join(letters() for _ in range(r.randint(least, most)))

    def sentence(least: int, most: int) -> str:
        w = words(least, most).split()
        return (" ".join(x + ("," if i < len(w) - 1 and r.random() < 0.08 else "") for i, x in enumerate(w))).capitalize() + r.choice((".", ".", ".", ".", "?", "!", ":"))

    def text(most: int) -> str:
        return " ".join(sentence(3, 22) for _ in range(r.randint(1, most)))

    def el(tag: str, inner: str, good: bool, attrs: str = "") -> str:
        mark = str(next(marks))
        if good:
            content.add(mark)
        if plain and tag in ("article", "main", "section", "nav", "aside", "header", "footer", "form"):
            tag = "div"
        if plain and tag == "div":
            attrs = f'{r.choice(("class", "id"))}="{r.choice(neutral)}"' if r.random() < 0.6 else ""
        return f'<{tag} data-n="{mark}"{" " + attrs if attrs else ""}>{inner}</{tag}>'

    def name(*options: str) -> str:
        many = " ".join(r.choices(("flex", "p-4", "mt-2", "text-sm", "w-full", "grid", "gap-2", "rounded", "bg-white"), k=r.randint(2, 14))) + " " if r.random() < 0.12 else ""
        return f'{r.choice(("class", "id", "class"))}="{many}{r.choice(options)}"'

    def good_name(*options: str) -> str:
        """A name of a content box: telling, neutral, misleading (a word of notices with another beside it), or none."""
        pick = r.random()
        if pick < 0.35:
            return name(*options)
        if pick < 0.6:
            return name(*neutral)
        if pick < 0.75:
            odd = r.choice(("cookie", "ad", "share", "social", "comment", "menu", "footer", "header", "sidebar", "banner", "notice", "related", "promo", "search", "tag", "popup", "widget", "newsletter"))
            return name(f"{odd}-{letters()}", f"{letters()}-{odd}")
        return ""

    def links(least: int, most: int) -> str:
        if r.random() < 0.2:
            return el("div", r.choice((" ", " | ", " · ")).join(f'<a href="/{letters()}">{words(1, 3)}</a>' for _ in range(r.randint(least, most))), False)
        return el("ul", "".join(el("li", f'<a href="/{letters()}">{words(1, 3)}</a>', False) for _ in range(r.randint(least, most))), False)

    def prose(good: bool) -> str:
        pick = r.random()
        if pick < 0.6:
            inner = text(r.choice((1, 2, 6))) if r.random() < 0.8 else words(1, 8)
            if r.random() < 0.12:  # telling words occur in articles too
                inner = r.choice(("", sentence(2, 9) + " ")) + r.choice(("All rights reserved.", "Copyright 2019 " + words(1, 3) + ".", "The cookie " + sentence(1, 5), "Please share " + sentence(1, 5), "A comment " + sentence(2, 6), "Reply to " + sentence(2, 6), "Privacy " + sentence(2, 5)))
            if r.random() < 0.3:
                inner += f' <a href="/x">{words(1, 2)}</a> ' + sentence(2, 20)
            return el("p", ("<b>" if r.random() < 0.1 else "") + inner + ("<br>" if r.random() < 0.1 else ""), good)
        if pick < 0.7:
            return el(r.choice(("h2", "h3", "h4")), words(2, 8), good)
        if pick < 0.78:
            return el(r.choice(("ul", "ol")), "".join(el("li", sentence(3, 20) if r.random() < 0.5 else words(2, 9), good) for _ in range(r.randint(2, 5))), good)
        if pick < 0.83:
            return el("blockquote", el("p", text(3), good), good)
        if pick < 0.87:
            return el("pre", words(5, 20), good)
        if pick < 0.94:
            return el(r.choice(("div", "div", "section")), "".join(el("p", text(3), good) for _ in range(r.randint(1, 3))) if r.random() < 0.7 else text(3), good, good_name("text", "section", "paragraph", "chapter", "body"))
        rows = "".join(el("tr", "".join(el("td", words(1, 4), good) for _ in range(3)), good) for _ in range(2))
        return el("table", rows, good) if pick < 0.97 else el("figure", f'<img src="i.png">{el("figcaption", sentence(3, 10), good)}', good)

    def notice() -> str:
        kind = r.choice((1, 2, 3, 8)) if plain else r.randrange(9)
        short = sentence(3, 14)
        if kind == 0:
            return el("div", r.choice((short, words(2, 9), "Advertisement " + words(1, 4))), False, name("ad", "ads", "advert", "ad-banner", "advertisement", "sponsored", "promo", "sponsor-box", "ad-slot"))
        if kind == 1:
            return el("div", el("p", r.choice(("We use cookies ", "This site uses cookies ", "Cookie settings ", "Privacy and cookies ")) + sentence(2, 14), False) + (el("button", words(1, 2), False)), False, name("cookie-notice", "cookie-banner", "cookie-bar", "cookies", "consent", "gdpr notice", "notice", "alert-banner", "privacy-notice"))
        if kind == 2:
            return el("form", el("label", r.choice((words(1, 4), "Subscribe", "Log in", "Sign up")), False) + '<input name="q">' + el("button", words(1, 2), False), False, name("search", "newsletter", "subscribe-form", "login"))
        if kind == 3:
            return el("div", links(2, 6), False, name("share", "social", "share-buttons", "related", "related-posts", "more-links", "tags", "breadcrumb", "pagination"))
        if kind == 4:
            return el("div", el("h3", words(1, 3), False) + el("p", r.choice(("Subscribe to our newsletter ", "Sign up ", "")) + short, False), False, name("newsletter", "subscribe", "signup", "paywall", "popup", "modal", "promo-box", "newsletter-box"))
        if kind == 5:
            return el("aside", el("h3", words(1, 3), False) + (links(2, 6) if r.random() < 0.5 else el("p", text(2), False)), False, name("sidebar", "widget", "rail") if r.random() < 0.6 else "")
        if kind == 6:
            return el("div", el("p", text(2), False) + (links(1, 4) if r.random() < 0.6 else ""), False, name("sidebar", "side-bar", "widget", "right-column", "secondary", "sidebar-left"))
        if kind == 7:
            return el("div", short, False, 'role="banner"' if r.random() < 0.3 else name("disclaimer", "notice", "banner", "announcement", "toolbar", "site-notice"))
        return el("nav", links(3, 7), False)

    def comments() -> str:
        one = lambda: el(r.choice(("div", "li", "article")), el("p", text(3), False) + (el("div", words(1, 3), False, name("comment-meta", "author")) if r.random() < 0.4 else ""), False, name("comment", "comment-body", "reply", "comment-item"))
        head = el(r.choice(("h2", "h3", "h4")), r.choice((words(1, 3), "Comments")), False) if r.random() < 0.7 else ""
        said = "".join(one() for _ in range(r.randint(1, 4))) if r.random() < 0.7 else "".join(el("p", r.choice((words(1, 4), text(2))), False) for _ in range(r.randint(1, 3)))
        return el(r.choice(("section", "div", "ol")), head + said, False, name("comments", "comment-list", "disqus comments", "reader-comments", "responses", "discussion"))

    def talk() -> str:
        """Comments in boxes without names: a line that announces them, then what was said, in one box or beside the article."""
        line = r.choice(("Comments", f"{r.randint(1, 60)} Comments", f"Comments ({r.randint(1, 60)})", "Discussion", "Leave a reply", f"{r.randint(2, 9)} Kommentare", "Commentaires", f"{r.randint(2, 9)} comentarios", "Replies", f"{r.randint(1, 9)} responses"))
        head = el(r.choice(("h2", "h3", "div", "p")), line, False)
        one = lambda: el("div", r.choice((lambda: text(2), lambda: el("div", words(1, 2), False) + el(r.choice(("div", "p")), text(2), False), lambda: el("p", text(2), False), lambda: words(1, 2) + ": " + sentence(2, 12)))(), False)
        said = head + "".join(one() for _ in range(r.randint(1, 5)))
        return el("div", said, False) if r.random() < 0.6 else said

    def bare() -> str:
        """Text that stands in a box itself, in one piece or with line breaks."""
        return r.choice((" ", "<br><br>", "<br>\n", "\n<br><br>\n")).join(text(r.choice((1, 2, 5))) for _ in range(r.randint(1, 4)))

    def listed() -> str:
        """A list of links that is the article: titles, or titles with what they are about."""
        item = r.choice((lambda: f'<a href="/{letters()}">{words(3, 10)}</a>', lambda: f'<a href="/{letters()}">{words(2, 8)}</a>' + r.choice((" - ", ": ", " ")) + sentence(4, 18), lambda: f'{words(1, 3)} <a href="/{letters()}">{words(3, 8)}</a>'))
        return el(r.choice(("ul", "ol")), "".join(el("li", item(), True) for _ in range(r.randint(3, 12))), True)

    body = "".join((notice() if r.random() < 0.12 else "") + prose(True) for _ in range(r.randint(1, 9)))
    title = el("h1", words(3, 9), True) if r.random() < 0.9 or not plain else ""
    if kind == "bare":
        body = bare() if r.random() < 0.6 else el("div", bare(), True) + (el("div", bare(), True) if r.random() < 0.3 else "")
        title = title if r.random() < 0.4 else ""
    elif kind == "links":
        body = (el("p", text(2), True) if r.random() < 0.6 else "") + "".join((el("h2", words(1, 5), True) if r.random() < 0.5 else "") + listed() for _ in range(r.randint(1, 3)))
        title = title or el("h1", words(2, 8), True)
    if r.random() < 0.2 and not plain:
        title = el("header", title + (el("p", words(2, 8), True, name("byline", "dek", "subtitle")) if r.random() < 0.4 else ""), True)
    if r.random() < 0.2 and not plain:
        body += comments()
    if kind == "talk" and r.random() < 0.4:
        body += talk()
    inner = title + body
    wrap = r.random()
    if wrap < 0.5:
        main = el("article", inner, True, good_name("post", "entry", "article", "story") if r.random() < 0.5 else "")
    elif wrap < 0.75 or plain:
        main = el("div", inner, True, good_name("content", "article", "post-body", "entry-content", "main-text", "article-body", "story", "text"))
    else:
        main = el("main", inner if r.random() < 0.5 else el("article", inner, True), True)
    for _ in range(r.randint(0, 2)):
        main = el("div", main + (notice() if r.random() < 0.3 else ""), True, good_name("container", "wrapper", "page", "layout", "wrap", "row", "page", "site"))
    brand = el("div", words(1, 4), False, name("logo", "site-title", "brand")) if r.random() < 0.5 else el(r.choice(("h1", "h2", "p")), words(1, 4), False)
    top = el("header", (brand if not plain else "") + (el("nav", links(2, 6), False) if plain or r.random() < 0.5 else ""), False, name("site-header", "header", "top") if r.random() < 0.5 else "") if r.random() < 0.5 else ""
    menu = (el("nav", links(3, 8), False) if r.random() < 0.6 else el("div", links(3, 8), False, name("menu", "nav", "navbar", "navigation", "main-menu"))) if r.random() < 0.85 else ""
    rights = r.choice(("© 2020 ", "&copy; ", "Copyright 2021 ", "All rights reserved. ")) + words(1, 6)
    if plain:
        foot = el("footer", r.choice((rights, el("p", rights, False), links(2, 5))), False)
    else:
        foot = el("footer", r.choice((words(3, 25), text(2), rights, el("p", r.choice((rights, text(1))), False), links(2, 5))), False) if r.random() < 0.75 else el("div", r.choice((words(4, 20), rights)), False, name("footer", "copyright", "site-footer", "bottom"))
    extra = [notice() for _ in range(r.randint(0, 3))]
    late = [talk()] if kind == "talk" else [comments()] if r.random() < 0.35 and not plain else []
    if kind == "table":  # cells beside each other: a menu, the text, perhaps a column of notices
        inner = (title if r.random() < 0.6 else "") + (bare() if r.random() < 0.4 else body)
        menu_cell = el("td", r.choice((lambda: r.choice((" ", " | ", "<br>")).join(f'<a href="/{letters()}">{words(1, 2)}</a>' for _ in range(r.randint(2, 8))), lambda: links(2, 8), lambda: " ".join(words(1, 1).capitalize() for _ in range(r.randint(1, 4)))))(), False)
        cells = [menu_cell, el("td", inner, True)] + ([el("td", notice() if r.random() < 0.6 else links(2, 5), False)] if r.random() < 0.4 else [])
        rows = ([el("tr", el("td", words(1, 4), False), False)] if r.random() < 0.4 else []) + [el("tr", "".join(cells if r.random() < 0.8 else cells[::-1]), True)]
        rows += [el("tr", el("td", rights, False), False)] if r.random() < 0.4 else []
        main, top, menu = el("table", "".join(rows), True), top if r.random() < 0.3 else "", menu if r.random() < 0.3 else ""
    foot = foot if r.random() < 0.82 else ""
    page = top + menu + "".join(extra[:2]) + main + "".join(extra[2:]) + "".join(late) + foot
    shell = r.random()
    if shell < 0.1 and kind == "article":  # a fragment: nested boxes of a few paragraphs, nothing beside them
        boxes = [el("div", "".join(el("p", r.choice((words(1, 4), sentence(2, 9), text(2))), True) for _ in range(r.randint(1, 2))), True, good_name("text", "story")) for _ in range(r.randint(1, 3))]
        return el("div", "".join(boxes), True, good_name("page", "body")) if r.random() < 0.6 else "".join(boxes), content | {"body"}
    if shell < 0.25:
        return page if shell < 0.17 else main, content | {"body"}
    return f'<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body data-n="body">{page}</body></html>', content | {"body"}


def marked_nodes(source: str) -> tuple[list[Node], list[str | None]]:
    """The elements of a labelled page and their marks, which are taken off so that nothing is learned from them."""
    nodes = in_order(parse(source))
    marks = [next((v for k, v in n.attrs if k == "data-n"), None) for n in nodes]
    for n in nodes:
        n.attrs = [x for x in n.attrs if x[0] != "data-n"]
    return nodes, marks


def train_model(pages: int = 2400, seed: int = 5, rounds: int = 10) -> TreeModel:
    """A model trained on ``pages`` labelled pages."""
    model, data = TreeModel(), []
    for k in range(pages):
        source, content = labelled_page(seed * 100_000 + k)
        nodes, marks = marked_nodes(source)
        at = {id(n): i for i, n in enumerate(nodes)}
        labels: list[int] = []
        for n, m in zip(nodes, marks, strict=True):  # what has no mark is like the element around it
            labels.append(int(m in content) if m else labels[at[id(n.parent)]] if n.parent is not None and n.parent.parent is not None else 1)
        data.append((nodes, labels))
    model.fit(data, rounds)
    return model


_MODELS: dict[tuple[int, int, int], TreeModel] = {}


def default_model(pages: int = 2400, seed: int = 5, rounds: int = 10) -> TreeModel:
    """The model, trained once in a driver process."""
    if (pages, seed, rounds) not in _MODELS:
        _MODELS[pages, seed, rounds] = train_model(pages, seed, rounds)
    return _MODELS[pages, seed, rounds]


def main_blocks(source: str, model: TreeModel) -> list[str]:
    """Texts of the content blocks in page order."""
    root = parse(source)
    nodes = in_order(root)
    p, _ = model.marginals(nodes)
    good = {id(n) for n, x in zip(nodes, p, strict=True) if x > 0.5}
    shown = {id(n) for n in nodes}
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, at = stack.pop()
        keep = id(node) in good
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if isinstance(part, str):
                if keep:
                    run.append(part)
            elif id(part) in shown:
                flush()
                stack.append((node, at))
                node, at = part, 0
                keep = id(node) in good
        flush()
    return blocks


def extract_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *carry, text, n_chars)`` of every page: content blocks, white space single, joined by line feeds.

    A null or empty page has the empty text; broken markup is read tolerantly and nothing is cut off;
    character references are decoded; repeated rows each give a row; an empty table gives an empty
    one. Other columns are not read. One narrow stage; the model (a few hundred weights) is broadcast.
    """
    model = model or default_model()

    def make():
        def work(*columns):
            *kept, source = columns
            texts = ["\n".join(main_blocks(s, model)) if s else "" for s in source.to_pylist()]
            return [*kept, texts, [len(t) for t in texts]]

        return work

    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *carry))
    return map_rows(pages, f"{kept}, text string, n_chars bigint", make, [id_col, *carry, html_col])

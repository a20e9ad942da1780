"""Main-text extraction: boosted trees over DOM-node features, decoded as one subtree of the page.

A tolerant parser builds the element tree (unclosed, misnested and cut-off markup included). Every
element gets features of its tag, its attribute tokens and those of its ancestors, depth, subtree text
and link density, and its place among its siblings. The trees score each element; the decoding keeps
the set of elements with the highest total score in which no kept element has a dropped ancestor, so a
navigation bar's items cannot be kept without it, nor an article's paragraphs lose their article.

The trees are fitted on pages made by ``example_pages``: articles in many layouts, amid menus,
headers, footers, sidebars, notices, adverts, forms and reader comments, with known main text.
"""

from __future__ import annotations

import functools
import html
import random
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandworks.llm import gbt
from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import table

#: Pages that the trees are fitted on.
EXAMPLES = 700

#: A tag behind its "<" or "</": name and attributes. A quote opens a value only straight after "=".
_TAG_RE = re.compile(r"([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>")
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_CAPITALS = re.compile(r"[A-Z]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Without an end tag the first two run to their parent's
#: end, the others are taken for empty.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("textarea title iframe noembed noframes".split())
#: Elements whose closed content is not shown; drawings and formulas, in which every element is inline.
HIDDEN = frozenset("template desc metadata".split())
FOREIGN = frozenset("svg math".split())
INLINE = FOREIGN | frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark meter object output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var video wbr br img".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol table div article section main nav aside header footer form body dl select".split())

TAGS = ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "th", "blockquote", "figure", "pre", "button", "fieldset", "dl", "dd", "body", "html", "head", "noscript", "select")
#: Words in class, id and role by what they tell.
CUES = {
    "content": "article body content copy entry main post prose story text paragraph blog".split(),
    "menu": "breadcrumb breadcrumbs crumbs menu nav navbar navigation pager pagination tabs toc toolbar skip sitemap links".split(),
    "frame": "banner bottom colophon copyright credits footer foot head header legal masthead site top topbar logo".split(),
    "side": "aside rail related recommended sidebar side widget widgets trending popular more tags teaser also".split(),
    "advert": "ad ads advert advertisement adverts adsense adslot dfp promo promoted promotion sponsor sponsored banners commercial".split(),
    "comment": "comment comments commentlist discussion disqus replies reply respond reviews thread reader".split(),
    "form": "contact form login newsletter register search signin signup subscribe subscription input".split(),
    "notice": "alert consent cookie cookies disclaimer gdpr message modal notice notification overlay popup privacy warning".split(),
    "share": "author byline date facebook meta share sharing social twitter".split(),
}
_CUE = {w: k for k, words in enumerate(CUES.values()) for w in words}
_FLAG_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "index", "inline")

    def __init__(self, tag: str, attrs: str, parent: Node | None, inline: bool = False):
        self.tag, self.attrs, self.parent, self.inline = tag, attrs, parent, inline
        self.children: list = []  # elements and text, in page order
        self.depth = parent.depth + 1 if parent else 0


class _Open:
    """The open elements, with the places of every tag, so that no tag has to walk over them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.holds = [0], [0]  # places of block elements, and of those that p and li stay inside

    def push(self, node: Node) -> None:
        i = len(self.nodes)
        self.nodes.append(node)
        self.at[node.tag].append(i)
        if not node.inline:
            self.blocks.append(i)
        if node.tag in HOLDS:
            self.holds.append(i)

    def cut(self, i: int) -> None:
        """Close the element at place i and all inside it."""
        while len(self.nodes) > i:
            self.at[self.nodes.pop().tag].pop()
        for places in (self.blocks, self.holds):
            while places[-1] >= i:
                places.pop()

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else 0

    def first_above(self, tag: str, place: int) -> int:
        """The outermost element of the tag inside the one at ``place``; 0 if there is none."""
        places = self.at.get(tag) or []
        k = bisect_right(places, place)
        return places[k] if k < len(places) else 0


def parse(page: str) -> Node:
    """The element tree, in time linear in the page. Comments, scripts, styles and other raw text are left
    out up to their ends; nothing else is."""
    root = Node("html", "", None)
    open_ = _Open(root)
    text = at = 0  # where the text since the last tag begins; where to look on
    limit = page.rfind(">") + 1
    missing: set[str] = set()  # end tags that the rest of the page does not hold

    def end_tag(tag: str, start: int) -> tuple[int, int] | None:
        if tag in missing:
            return None
        m = _end_of(tag).search(page, start)
        if not m:
            missing.add(tag)
            return None
        close = page.find(">", m.end())
        return m.start(), len(page) if close < 0 else close + 1

    while (at := page.find("<", at, limit)) >= 0:
        sign = page[at + 1]
        if sign in "!?" or sign == "/" and not page[at + 2 : at + 3].isalpha():
            # a comment, or what counts as one
            end = -1
            if page.startswith("<!--", at):
                if page.startswith((">", "->"), at + 4):
                    end = page.index(">", at) + 1
                elif "-->" not in missing:
                    end = page.find("-->", at + 4) + 3
                    if end < 3:
                        missing.add("-->")
                        end = -1
            if end < 0:
                end = page.index(">", at) + 1
            if at > text:
                open_.nodes[-1].children.append(page[text:at])
            text = at = end
            continue
        closing = sign == "/"
        if not closing and not ("a" <= sign <= "z" or "A" <= sign <= "Z"):
            at += 1
            continue
        m = _TAG_RE.match(page, at + 1 + closing, limit)
        if not m:  # no tag ends behind this place
            break
        if at > text:
            open_.nodes[-1].children.append(page[text:at])
        tag = m[1].lower()
        if closing:
            _close(open_, tag)
            text = at = m.end()
            continue
        text = at = m.end()
        attrs = m[2]
        empty = _EMPTY.search(attrs) is not None
        if tag in RAW:
            found = None if empty else end_tag(tag, at)
            if found:
                text = at = found[1]
            elif tag in CODE and not empty:
                up = end_tag(open_.nodes[-1].tag, at)
                text = at = up[0] if up else len(page)
            continue
        if tag == "html" or tag == "body" and open_.last("body"):
            continue
        if tag in ENDS_P or tag == "body":
            # blocks end drawings, formulas and choices that were left open
            outer = min((x for x in (open_.first_above(t, 0) for t in ("svg", "math", "select")) if x), default=0)
            if outer:
                open_.cut(outer)
            if (i := open_.last("p")) > open_.holds[-1]:
                open_.cut(open_.first_above("p", open_.holds[-1]))
            if tag == "body" and (i := open_.last("head")):
                open_.cut(i)
        if tag in SAME:
            i = min((x for x in (open_.first_above(t, open_.holds[-1]) for t in SAME[tag]) if x), default=0)
            if i:
                open_.cut(i)
        node = Node(tag, attrs, open_.nodes[-1], tag in INLINE or bool(open_.at.get("svg") or open_.at.get("math")))
        open_.nodes[-1].children.append(node)
        if tag not in VOID and not empty:
            open_.push(node)
    if text < len(page):
        rest = page[text:]
        # a tag that the page's end cuts off
        cut = re.search(r"<(?:[a-zA-Z/!?]|$)", rest)
        open_.nodes[-1].children.append(rest[: cut.start()] if cut else rest)
    return root


@functools.lru_cache(256)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I)


def _close(open_: _Open, tag: str) -> None:
    """An end tag: closes its element if one is open, but inline ones close no block, and p no container."""
    if tag == "br":
        open_.nodes[-1].children.append(Node(tag, "", open_.nodes[-1], True))
        return
    i = open_.last(tag)
    if tag == "p" and i <= open_.holds[-1]:
        open_.nodes[-1].children.append(Node(tag, "", open_.nodes[-1]))  # an empty paragraph
    elif i and not (open_.nodes[i].inline and i < open_.blocks[-1]):
        node = open_.nodes[i]
        open_.cut(i)
        if tag in HIDDEN:
            node.children.clear()


@functools.lru_cache(4096)
def _cues(attrs: str) -> int:
    """A bit for each group of cues that the attributes name, and the last bit if they hide the element."""
    found = 0
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for w in _WORD.findall(value):
                if w in _CUE:
                    found |= 1 << _CUE[w]
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and "true" in value:
            found |= 1 << len(CUES)
    return found


def blocks_of(root: Node) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Block elements in page order, and the texts (element, text, link characters) between their edges."""
    nodes: list[Node] = []
    texts: list[tuple[Node, str, int]] = []
    buffer: list[str] = []
    links = 0

    def flush(owner: Node):
        nonlocal links
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                texts.append((owner, text, min(links, len(text))))
            buffer.clear()
        links = 0

    # (node, owner, next child, inside a link); an explicit stack, as pages nest deeply
    root.index = 0
    nodes.append(root)
    todo = [[root, root, 0, False]]
    while todo:
        node, owner, k, linked = top = todo[-1]
        if k == len(node.children):
            todo.pop()
            if node is owner:
                flush(node)
            continue
        top[2] += 1
        child = node.children[k]
        if isinstance(child, str):
            buffer.append(child)
            links += len(child.strip()) if linked else 0
        elif child.inline:
            if child.tag in ("br", "wbr"):
                buffer.append(" " if child.tag == "br" else "")
            else:
                todo.append([child, owner, 0, linked or child.tag == "a"])
        elif child.tag in VOID:
            flush(owner)
        else:
            flush(owner)
            child.index = len(nodes)
            child.parent = owner
            nodes.append(child)
            todo.append([child, child, 0, linked])
    return nodes, texts


_TAG = {t: k for k, t in enumerate(TAGS)}
_KIND = {t: k for k, tags in enumerate(("p", "h1 h2 h3 h4 h5 h6", "ul ol li dl", "div section", "article main", "nav aside footer form", "header", "html body")) for t in tags.split()}
_FLAG = {t: 1 << (len(CUES) + 1 + k) for k, t in enumerate(_FLAG_TAGS)}


def node_features(nodes: list[Node], texts: list[tuple[Node, str, int]]) -> np.ndarray:
    n = len(nodes)
    parent = [0] * n
    cues, mine, place = [0] * n, [0] * n, [0] * n
    children = [0] * n
    for i, x in enumerate(nodes):
        cues[i] = _cues(x.attrs) if x.attrs else 0
        mine[i] = cues[i] | _FLAG.get(x.tag, 0)
        if i:
            up = parent[i] = x.parent.index
            mine[i] |= mine[up]
            place[i] = children[up]
            children[up] += 1
    own = np.zeros((n, 6))  # characters, link characters, words, stops, commas, capitals
    for node, text, links in texts:
        own[node.index] += (
            len(text), links, text.count(" ") + 1, text.count(".") + text.count("!") + text.count("?"), text.count(","), len(_CAPITALS.findall(text)),
        )
    total = own.tolist()
    blocks, height = [1] * n, [0] * n
    for i in range(n - 1, 0, -1):
        up = parent[i]
        total[up] = [a + b for a, b in zip(total[up], total[i], strict=True)]
        blocks[up] += blocks[i]
        height[up] = max(height[up], height[i] + 1)
    total, blocks = np.array(total), np.array(blocks, float)
    up, siblings = np.array(parent), np.maximum(1, np.array(children)[parent])
    siblings[0] = 1
    chars, links, words, stops, commas, caps = total.T
    per = lambda a, b: a / np.maximum(1, b)
    kind = np.array([_KIND.get(x.tag, -1) for x in nodes])
    bit = lambda masks, width: (np.array(masks)[:, None] >> np.arange(width)) & 1
    before = np.concatenate(([0], np.cumsum(own[:-1, 0])))
    rest = np.stack((
        np.array([_TAG.get(x.tag, -1) for x in nodes]), *[kind == k for k in range(8)],
        np.array([x.depth for x in nodes]), np.array(height), blocks, np.log1p(chars), per(links, chars), np.log1p(words), chars / blocks,
        per(stops, words), per(commas, words), per(caps, chars), np.log1p(own[:, 0]), per(chars, words),
        np.array(place), siblings, np.array(place) / siblings, per(chars, chars[up]), per(before, chars[0]), per(chars, chars[0]),
    ), 1)
    return np.concatenate((bit(cues, len(CUES)), bit(mine, len(CUES) + 1 + len(_FLAG_TAGS)), rest), 1)


def keep(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """The best-scored set of nodes in which every node's parent is kept; the root always is."""
    value = logit.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if value[i] > 0:
            value[nodes[i].parent.index] += value[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = value[i] > 0 and kept[nodes[i].parent.index]
    return kept


# --- examples -------------------------------------------------------------------------------------

_SYLLABLES = "ar ba cel do en fi gor ha in jo ka lum mi nor os pra qui ro sta tel un ver wi xa yo zen ß é ñ ü ção".split()


def _sentence(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(least, most))]
    words = [w + "," if r.random() < 0.08 else w for w in words]
    mark = r.choice(["", "", "", "", "***", "$$$", "%%%", "!!"])
    if r.random() < 0.05:
        words = [w.upper() for w in words]
    return (" ".join(w + (mark if r.random() < 0.9 else "") for w in words)).capitalize() + r.choice(".....!?;")


def _prose(r: random.Random, short: bool = False) -> str:
    if short or r.random() < 0.15:
        return _sentence(r, 1, 8)
    return " ".join(_sentence(r, 3, 25) for _ in range(r.randint(1, 7)))


def _links(r: random.Random, n: int) -> list[str]:
    return [f'<a href="/{r.randint(1, 99)}">{_sentence(r, 1, 3).rstrip(".;!?")}</a>' for _ in range(n)]


def _cue(r: random.Random, kind: str, more: str = "") -> str:
    if r.random() < 0.12:
        return ""
    name = r.choice(CUES[kind])
    if r.random() < 0.4:
        name += r.choice("-_ ") + r.choice(["box", "area", "block", "wrap", "list", "inner", "item", more or "x1"])
    return f' {r.choice(["class", "class", "class", "id"])}="{name}"'


def _boiler(r: random.Random, kind: str) -> str:
    menu = "<ul>" + "".join(f"<li>{a}</li>" for a in _links(r, r.randint(2, 9))) + "</ul>"
    if kind == "menu":
        return r.choice([f"<nav{_cue(r, 'menu')}>{menu}</nav>", f"<div{_cue(r, 'menu') or ' class=nav'}>{menu}</div>", f"<nav>{' | '.join(_links(r, 5))}</nav>"])
    if kind == "header":
        inner = r.choice([f"<h1>{_sentence(r, 1, 3)}</h1>", f"<p>{_sentence(r, 2, 6)}</p>", f"<div>{_links(r, 1)[0]}</div>"]) + (menu if r.random() < 0.4 else "")
        return r.choice([f"<header{_cue(r, 'frame')}>{inner}</header>", f'<div class="{r.choice(["header", "masthead", "site-header", "topbar"])}">{inner}</div>'])
    if kind == "footer":
        inner = r.choice([f"&copy; {_sentence(r, 1, 4)} &middot; {_prose(r)}", f"<p>{_prose(r)}</p><p>{' '.join(_links(r, 4))}</p>", menu + f"<p>&copy; {_sentence(r, 2, 9)}</p>"])
        return r.choice([f"<footer{_cue(r, 'frame')}>{inner}</footer>", f'<div class="{r.choice(["footer", "site-footer", "colophon", "bottom copyright"])}">{inner}</div>'])
    if kind == "side":
        inner = r.choice([f"<h3>{_sentence(r, 1, 4)}</h3>{menu}", f"<p>{_prose(r)}</p>", "".join(f"<div><h4>{_sentence(r, 2, 8)}</h4><p>{_prose(r, True)}</p></div>" for _ in range(3))])
        return r.choice([f"<aside{_cue(r, 'side')}>{inner}</aside>", f'<div class="{r.choice(["sidebar", "related", "widget", "side rail", "recommended", "popular"])}">{inner}</div>'])
    if kind == "advert":
        inner = r.choice([_prose(r), f"<p>{_prose(r)}</p>", _links(r, 1)[0] + " " + _sentence(r, 3, 9)])
        return f'<{(t := r.choice(["div", "div", "section", "aside", "p"]))} {r.choice(["class", "id"])}="{r.choice(CUES["advert"])}{r.choice(["", "", "-box", " slot", "-1"])}">{inner}</{t}>'
    if kind == "notice":
        inner = r.choice([f"<p>{_prose(r)}</p>", _prose(r) + " <button>OK</button>"])
        if r.random() < 0.15:
            return f"<noscript>{inner}</noscript>"
        return f'<{(t := r.choice(["div", "section", "aside", "p"]))} {r.choice(["class", "id", "role"])}="{r.choice(CUES["notice"])}{r.choice(["", "-bar", " box"])}">{inner}</{t}>'
    if kind == "form":
        inner = f'<label>{_sentence(r, 1, 3)}</label><input type="text" name="q"><p>{_prose(r, r.random() < 0.6)}</p><button>{_sentence(r, 1, 2)}</button>'
        choice = "<select>" + "".join(f"<option>{_sentence(r, 1, 2)}</option>" for _ in range(r.randint(2, 6))) + "</select>"
        if r.random() < 0.2:
            return choice
        inner += choice if r.random() < 0.3 else ""
        return r.choice([f"<form{_cue(r, 'form')}>{inner}</form>", f'<div class="{r.choice(["newsletter", "login", "search", "subscribe"])}"><form>{inner}</form></div>'])
    if kind == "comment":
        one = lambda: r.choice([f"<div{_cue(r, 'comment')}><b>{_sentence(r, 1, 2)}</b><p>{_prose(r)}</p></div>", f"<li><p>{_prose(r)}</p></li>", f"<p>{_prose(r)}</p>"])
        return f'<{(t := r.choice(["section", "div", "div", "ol"]))} {r.choice(["class", "id"])}="{r.choice(CUES["comment"])}{r.choice(["", "-list", " area"])}">' + (f"<h3>{_sentence(r, 1, 3)}</h3>" if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 6))) + f"</{t}>"
    return f"<div{_cue(r, 'share')}>{' '.join(_links(r, 3))}</div>"


KINDS = ("menu", "header", "footer", "side", "advert", "notice", "form", "comment", "share")


def example_pages(n: int, seed: int = 11) -> list[str]:
    """Pages whose boilerplate elements carry the attribute data-b."""
    r = random.Random(seed)

    def boiler(kind: str) -> str:
        return re.sub(r"^<(\w+)", r"<\1 data-b", _boiler(r, kind))

    pages = []
    for _ in range(n):
        body = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            text = _prose(r)
            if r.random() < 0.2:
                text = f"<{(t := r.choice(['b', 'i', 'em', 'span', 'strong']))}>{text}" + (f"</{t}>" if r.random() < 0.7 else "<br>")
            if r.random() < 0.15:
                text += " " + _links(r, 1)[0] + " " + _sentence(r, 2, 9)
            kind = r.random()
            if kind < 0.72:
                body.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.80:
                body.append(f"<h{(k := r.randint(2, 4))}>{_sentence(r, 1, 8)}</h{k}>")
            elif kind < 0.87:
                body.append(f"<{(k := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{_prose(r, r.random() < 0.5)}</li>" for _ in range(r.randint(2, 6))) + f"</{k}>")
            elif kind < 0.91:
                body.append(f"<blockquote>{r.choice(['', '<p>'])}{text}</blockquote>")
            elif kind < 0.94:
                body.append("<table>" + "".join(f"<tr><td>{_sentence(r, 1, 4)}</td><td>{_sentence(r, 1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                body.append(f"<div>{text}</div>")
            else:
                body.append(f"<pre>{text}</pre>")
            if r.random() < 0.07:
                body.append(boiler(r.choice(["advert", "notice", "side", "share", "form"])))
        title = f"<h1>{_sentence(r, 2, 12)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        inside = title + "".join(body)
        if r.random() < 0.2:
            inside += boiler(r.choice(["comment", "share", "side", "form"]))
        style = r.random()
        if style < 0.45:
            main = f"<article{_cue(r, 'content') if r.random() < 0.4 else ''}>{inside}</article>"
        elif style < 0.6:
            main = f"<main>{r.choice(['', '<article>', '<div>'])}{inside}</main>"
        else:
            main = f'<div{_cue(r, "content")}>{inside}</div>'
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            main = f"<div{r.choice(['', ' class=container', ' id=page', ' class=wrapper', ' class=row'])}>{main}" + (boiler(r.choice(KINDS)) if r.random() < 0.3 else "") + "</div>"
        top = [boiler(k) for k in r.sample(["menu", "header", "advert", "notice", "form", "share"], r.randint(0, 4))]
        bottom = [boiler(k) for k in r.sample(["comment", "side", "advert", "share", "form", "menu", "notice"], r.randint(0, 3))] + ([boiler("footer")] if r.random() < 0.8 else [])
        pages.append(f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 8)}</title><style>p{{}}</style></head><body>" + "".join(top) + main + "".join(bottom) + "</body></html>")
    return pages


@functools.cache
def train(examples: int = EXAMPLES) -> gbt.Trees:
    """Fit the trees on example pages; the same on every run."""
    xs, ys = [], []
    for page in example_pages(examples):
        nodes, texts = blocks_of(parse(page))
        bad = np.zeros(len(nodes), bool)
        full = np.zeros(len(nodes), bool)
        for node, _, _ in texts:
            full[node.index] = True
        for i, x in enumerate(nodes):
            bad[i] = i > 0 and bad[x.parent.index] or "data-b" in x.attrs
            x.attrs = x.attrs.replace(" data-b", "")
        xs.append(node_features(nodes, texts))
        ys.append(~bad)
    return gbt.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees=60, depth=5)


def extract(pages: list[str | None], model: gbt.Trees) -> list[str]:
    """Main text of every page; empty for null or empty pages and where no block is kept."""
    parsed = [blocks_of(parse(p or "")) for p in pages]
    full = [node_features(nodes, texts) for nodes, texts in parsed]
    logits = np.split(model.logit(np.concatenate(full)), np.cumsum([len(x) for x in full])[:-1]) if full else []
    out = []
    for (nodes, texts), logit in zip(parsed, logits, strict=True):
        kept = keep(nodes, logit)
        out.append("\n".join(text for node, text, _ in texts if kept[node.index]))
    return out


def main_text(pages: DataFrame, html_column: str = "html", model: gbt.Trees | None = None) -> DataFrame:
    """Append text and n_chars (code points) to every page; keeps all columns and rows.

    A null page gives an empty text. Columns named text or n_chars are replaced. Bytes that are no
    UTF-8 are replaced as decoding does.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def kernel(texts: list) -> dict:
        got = extract([(t or b"").decode("utf-8", "replace") for t in texts], shared.value)
        return {"text": got, "n_chars": [len(x) for x in got]}

    return append_columns(pages, html_column, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], kernel)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

"""HTML main text: flat text blocks classified by a decision tree.

Contract. A page's blocks are the runs of text between block-level tags; scripts, styles, form
parts, comments, markup and invisible parts give no text; character references are decoded,
white space inside a block becomes one space, blocks are trimmed and empty ones go. A block's features are its
number of words and the share of them inside links, the same of the blocks before and after it, whether it is a
heading, whether it lies in an article, and how strongly its nearest containers are named as something else (menu,
footer, notice, comments, ...), with their share of the page's words where only a part of a name says so and no text of
the page comes before, and whether it is a line on rights outside an article. The names of the page's body and of
whatever holds the article say nothing about the blocks inside. A decision tree learned from the small labelled pages
below keeps or drops a block. Kept blocks are joined by two line feeds.

Cases: null, empty or textless html gives an empty text; unclosed and stray tags, unfinished
comments, scripts and other raw text are read to the end as browsers do; an unclosed button, object,
video or the like hides what follows up to the next block only; very long pages are read whole; repeated rows give
repeated results; an empty table an empty one. Only the named columns are read, so others can't clash.

Scale. Pages are independent: one scan, no shuffle. The scanner is linear in the page's length.
"""

from __future__ import annotations

import functools
import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _base as B

# fixed values: element names of HTML
RAW = "script style noscript template iframe textarea title head".split()
PARTS = "svg math object select button datalist canvas audio video".split()
BLOCK = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
NESTED = "address article aside blockquote body dd details dialog div dl dt fieldset figure footer form header hgroup li main menu nav ol p section search table td th tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
ASIDE = "nav footer aside form menu dialog fieldset search".split()
# fixed values: words in class, id and role attributes of parts that aren't the article
HINTS = (
    "ad ads advert adverts advertisement advertising adbox adsense affiliate banner breadcrumb breadcrumbs byline captcha comment comments commentary commentlist consent cookie cookies copyright disclaimer disqus "
    "discussion dropdown footer footnav gdpr header hidden legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification alert overlay pager pagination paywall popup popular "
    "page-header promo promotion recommended recommendations related replies reply respond responses reviews search share sharing sidebar signin signup site-header top-header main-header skip skiplink skyscraper social sponsor sponsored subscribe "
    "subscription tag tags toc toolbar topbar tracking trending warning widget widgets complementary contentinfo dialog"
).split()
# fixed values: hints that count only as a whole name, being parts of the article's own names as well
WHOLE = "header meta tag tags legal search hidden text".split()
# fixed values: hints that say how an element is shown, not what it holds; they are never more than parts
SHOWN = "modal popup overlay dropdown widget widgets toolbar".split()
# fixed values: first parts of names that say what a page has or lacks, not what the element is
ABOUT = "has no not is with without hide show".split()
KEEP_HINTS = "article content main post story entry body text articlebody".split()

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|\Z)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[\s_\-:]+")
_SPACE = re.compile(r"\s+")
_RAW, _PARTS, _BLOCK, _NESTED, _VOID, _HEADINGS, _ASIDE, _HINTS, _KEEP, _WHOLE, _SHOWN, _ABOUT = map(frozenset, (RAW, PARTS, BLOCK, NESTED, VOID, HEADINGS, ASIDE, HINTS, KEEP_HINTS, WHOLE, SHOWN, ABOUT))
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in RAW}
_EVENT = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(n for n in RAW if n != 'head')})(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])|\Z)|<(?P<end>/?)(?P<name>{'|'.join([*PARTS, *NESTED])})(?=[\s/>])", re.S | re.I)


class _Ends:
    """Where the invisible parts of a page end: each end tag belongs to the last open start tag of its name."""

    def __init__(self, html: str):
        self.html, self.events, self.at, self.partner = html, [], {}, {}
        opened: dict[str, list[int]] = {}
        for m in _EVENT.finditer(html):
            if m["name"] is None:
                continue
            name, k = m["name"].lower(), len(self.events)
            self.events.append((m.start(), bool(m["end"]), name))
            if name not in _PARTS:
                continue
            if not m["end"]:
                self.at[m.start()] = k
                if name not in ("svg", "math") or html[html.find(">", m.end()) - 1] != "/":
                    opened.setdefault(name, []).append(k)
            elif opened.get(name):
                self.partner[opened[name].pop()] = k

    def end(self, lt: int, around: set[str]) -> int:
        """The end of the part that starts at lt: behind its end tag, or before that of a block around it; -1 if it has none."""
        k = self.at.get(lt, -1)
        last = self.partner.get(k, -1)
        if last < 0:
            return -1
        inside: dict[str, int] = {}
        for e in range(k + 1, last):
            pos, end, name = self.events[e]
            if not end:
                inside[name] = inside.get(name, 0) + 1
            elif inside.get(name):
                inside[name] -= 1
            elif name in around:
                return pos
        gt = self.html.find(">", self.events[last][0])
        return gt + 1 if gt >= 0 else len(self.html)


@functools.lru_cache(65536)
def _attributes(attrs: str) -> tuple[int, bool, bool]:
    """How strongly the names say that this isn't the article (0; 1: by a part; 2: as a whole); the article; invisible."""
    level, good, gone = 0, False, False
    for k, v in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'")
        if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and _HIDDEN.search(v):
            gone = True
        elif k == "role":
            level = max(level, 2 * (v.lower() in _HINTS))
        elif k in ("class", "id"):
            for p in v.lower().split():
                pieces = _WORDS.split(p)
                if (p in _HINTS or all(x in _HINTS and x not in _WHOLE for x in pieces)) and not _SHOWN.issuperset(pieces):
                    level = 2
                elif pieces[0] not in _ABOUT:
                    if any(x in _HINTS and x not in _WHOLE for x in pieces):
                        level = max(level, 1)
                    good |= pieces[-1] in _KEEP
    return level, good, gone


class Element:
    """An element that may hold blocks: its parent (-1: none), hint level, whether it is an article by tag (2) or name (1)."""

    __slots__ = ("name", "parent", "level", "article", "gone", "words", "wraps")

    def __init__(self, name: str, parent: int, level: int, article: int, gone: bool):
        self.name, self.parent, self.level, self.article, self.gone = name, parent, level, article, gone
        self.words, self.wraps = 0, False


def blocks(html: str) -> tuple[list[tuple[str, int, int, int, bool]], list[Element]]:
    """(text, words, linked words, innermost element, heading) in page order, and the elements, parents first."""
    out: list = []
    parts: list[str] = []
    linked: list[str] = []
    elements: list[Element] = []
    stack: list[int] = []
    gone = False
    in_link, heading, gone_inline = False, False, ""
    pos, n, ends = 0, len(html), None

    def flush():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                out.append((text, text.count(" ") + 1, len(html_lib.unescape("".join(linked)).split()), stack[-1] if stack else -1, heading))
            parts, linked = [], []

    def add(s: str):
        if s and not gone and not gone_inline:
            parts.append(s)
            if in_link:
                linked.append(s)

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            add(html[pos:])
            break
        m = _TAG.match(html, lt)
        if m is None:  # a lone sign
            add(html[pos : lt + 1])
            pos = lt + 1
            continue
        add(html[pos:lt])
        pos = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["cdata"]:
                add(html_lib.escape(m["cdata"]))
            continue
        name = name.lower()
        end = bool(m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in _RAW and not end:
            if name == "head":
                close = re.compile(r"</head(?=[\s/>])[^>]*>|(?=<body[\s>])", re.I).search(html, pos)
                pos = close.end() if close else pos
            else:
                close = _RAW_END[name].search(html, pos)
                pos = close.end() if close else n
            add(" ")
            continue
        if name in _PARTS and not end:
            add(" ")
            if not attrs.endswith("/") or name not in ("svg", "math"):
                ends = ends or _Ends(html)
                to = ends.end(lt, {elements[e].name for e in stack})
                if to >= 0:
                    pos = to
                elif not gone_inline:
                    gone_inline = name  # never closed: it ends with the next block
            continue
        if name == "a":
            in_link = not end
            if in_link:
                linked.append(" ")
            continue
        if name in ("br", "hr", "img", "input", "wbr"):
            if name == "hr":
                flush()
            elif name != "wbr":
                parts.append(" ")
            continue
        if name not in _BLOCK:
            if gone_inline:
                if end and name == gone_inline:
                    gone_inline = ""
            elif not end and attrs and not attrs.endswith("/") and _attributes(attrs)[2]:
                gone_inline = name
            continue
        flush()
        if gone_inline not in ("select", "datalist") or name not in ("option", "optgroup"):
            gone_inline = ""
        if name in _HEADINGS:
            heading = not end
            if not end:
                in_link = False
            continue
        heading = False
        if name not in _NESTED:
            continue
        if end:
            at = next((i for i in range(len(stack) - 1, -1, -1) if elements[stack[i]].name == name), -1)
            if at >= 0:
                del stack[at:]
                in_link = False
        else:
            if name in ("p", "li", "td", "th", "tr", "dd", "dt") or stack and elements[stack[-1]].name == "p":
                if stack and elements[stack[-1]].name in ("p", name):
                    stack.pop()  # its end tag may be left out
            level, named, hidden = _attributes(attrs) if attrs else (0, False, False)
            if name in _ASIDE or name == "header" and not any(elements[e].name in ("article", "main") for e in stack):
                level = 2
            article = 2 if name in ("article", "main") else int(named)
            up = stack[-1] if stack else -1
            elements.append(Element(name, up, 0 if name in ("html", "body", "main") else level, article, hidden or up >= 0 and elements[up].gone))
            stack.append(len(elements) - 1)
        gone = bool(stack) and elements[stack[-1]].gone
    flush()
    return out, elements


def surroundings(found: list, elements: list[Element]) -> np.ndarray:
    """For each block: hint level of its containers, the share of the page's unlinked words in the hinted one, and 1
    in an article, -1 outside where the page marks one by its tag, else 0."""
    for _, words, linked, e, _ in found:
        if e >= 0:
            elements[e].words += words - min(words, linked)
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].words += e.words
    page = sum(f[1] - min(f[1], f[2]) for f in found)
    # the article: the one with most words that is neither named as something else nor inside such a part
    clear = [False] * len(elements)
    best = -1
    for i, e in enumerate(elements):
        clear[i] = not e.level and (e.parent < 0 or clear[e.parent] or e.article == 2 and elements[e.parent].level < 2)
        if e.article and e.words and clear[i] and (best < 0 or (e.article, e.words) > (elements[best].article, elements[best].words)):
            best = i
    at = best
    while at >= 0:
        elements[at].wraps = True
        at = elements[at].parent
    # a name's part may say nothing of what holds most of a page, but only where the page's text doesn't begin before it
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = e.level > 0 and not e.wraps or e.parent >= 0 and inside[e.parent]
    begun = next((e for _, words, linked, e, heading in found if not (e >= 0 and inside[e]) and (heading or words - linked >= BEGINS)), None)
    first = len(elements) if begun is None else begun
    # (level, share, in an article) of each element from its own and its parent's
    known: list[tuple[int, float, bool]] = []
    for i, e in enumerate(elements):
        level, share, article = known[e.parent] if e.parent >= 0 else (0, 0.0, False)
        if e.level and not e.wraps and e.level >= level:
            level, share = e.level, 0.0 if best >= 0 or e.level > 1 or i > first else e.words / max(page, 1)
        known.append((level, share, article or e.article > 0))
    x = np.array([known[e] if e >= 0 else (0, 0.0, False) for *_, e, _ in found], float).reshape(-1, 3)
    if best >= 0 and elements[best].article == 2:
        x[x[:, 2] == 0, 2] = -1
    return x


BEGINS = 10  # unlinked words of a block, or a heading, with which a page's text begins
# fixed values: how a line on rights begins
_RIGHTS = re.compile(r"(?i)(?:©|\(c\)\s|copyright\b|all rights\b)")
FEATURES = "words, linked share, words before, linked share before, words after, linked share after, hint level, share of the hinted container, in an article, heading, line on rights".split(", ")


def table(found: list, elements: list[Element]) -> np.ndarray:
    """A row of features for each block."""
    n = len(found)
    words = np.array([f[1] for f in found], float)
    dense = np.array([f[2] for f in found], float) / np.maximum(words, 1)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0], x[:, 1] = words, dense
    x[1:, 2], x[1:, 3] = words[:-1], dense[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], dense[1:]
    x[:, 6:9] = surroundings(found, elements)
    x[:, 9] = [f[4] for f in found]
    x[:, 10] = (x[:, 8] <= 0) & [f[1] <= 2 * BEGINS and bool(_RIGHTS.match(f[0])) for f in found]
    return x


# --- the labelled table ---------------------------------------------------------------------
# Small pages whose blocks are labelled: a block that starts with "+" belongs to the article.
_SAID = "here the page says a few things more in one sentence of some words "
_LONG = "this is a sentence of the article that says something at length and goes on for a while so that it counts as text "
LABELLED = [
    # nothing is named: words and links of a block and of those around it tell
    "<div><a>home</a> <a>news</a> <a>sports</a></div><h1>+the title of it</h1><p>+{L}</p><p>+yes.</p><p>+{X}</p><p>+{M}</p><div>all rights reserved</div><div><a>privacy</a> <a>terms</a></div>",
    "<ul><li><a>first link here</a></li><li><a>second link here</a></li><li><a>third link here</a></li></ul><p>+{X}</p><p>+{L}</p><div><a>next page</a></div>",
    "<div><a>home</a> <a>more</a></div><p>+{L}</p>",
    "<div><a>home</a><a>more</a></div><p>+a few words here.</p>",
    "<p>+{L}</p>",
    "<p>+short text.</p>",
    "<p>+{X}</p><p>+short text.</p><p>+{L}</p><p>+a few words here.</p>",
    "<h1>+title</h1><p>+{L}</p><h2>+part two</h2><p>+{M}</p><p>+short text.</p><p>+{L}</p><div><a>back</a></div>",
    "<div><a>menu</a></div><h1>+title</h1><p>+short text.</p><p>+another one.</p>",
    "<div><a>home</a> <a>about</a></div><div>you are here</div><div><a>news</a> <a>today</a></div><h1>+title of it</h1><p>+{L}</p><p>+{X}</p><div>read on</div><div><a>one more title</a></div><div><a>yet another title</a></div>",
    "<div>site name</div><div><a>home</a> <a>news</a> <a>contact</a></div><p>+{X}</p><p>+{L}</p><p>+no.</p><p>+{L}</p><div>share this</div><div><a>one place</a> <a>another place</a></div><div>copyright of the owner</div>",
    "<div>the name of the site</div><div><a>home</a></div><div><a>news</a></div><h1>+a title</h1><p>+{M}</p><p>+{L}</p><p>+{M}</p><div>most read</div><div><a>a title of something</a></div><div><a>and one more</a></div><div>all rights reserved</div>",
    "<div><a>home</a> <a>news</a></div><div>today on the site</div><p>+{L}</p><p>+{M}</p>",
    "<div><a>home</a></div><div>the monday edition</div><h1>+title</h1><p>+{L}</p><p>+short text.</p>",
    "<ul><li><a>log in</a></li></ul><div>the site of it</div><p>+{X}</p><p>+short text.</p><p>+{L}</p>",
    "<div>welcome</div><div><a>log in</a> <a>join</a></div><p>+{L}</p><p>+{X}<a>+with a link</a></p><div>tags</div><div><a>one</a> <a>two</a></div><div>copyright</div>",
    "<p>+{L}</p><p>+{M}</p><p>+{L}</p>",
    "<p>+{M}</p><p>+{L}</p><p>+{X}</p><p>+{M}</p>",
    "<p>+{L}</p><p>+{L}</p><p>+yes, of course it is.</p>",
    "<h1>+title</h1><p>+{M}</p><p>+{L}</p><p>+{M}</p><p>+one more.</p>",
    "<p>+{M}</p><p>+{M}</p>",
    "<table><tr><td><a>home</a></td><td><a>news</a></td></tr></table><table><tr><td>+{L}</td></tr><tr><td>+{M}</td></tr></table><div>by the owner</div><div><a>top</a></div>",
    # an article, with and without names around it
    "<article><p>+one.</p></article>",
    "<article><h1>+title</h1><p>+<a>a link alone</a></p><p>+{L}</p><ul><li>+<a>one</a></li><li>+<a>two</a></li></ul><p>+end</p></article><div>all rights reserved</div>",
    "<div><a>home</a></div><div>your site</div><article><p>+word</p><p>+{L}</p><p>+no.</p></article><div>copyright</div><div><a>top</a></div>",
    "<div>a notice of few words</div><main><h1>+title</h1><p>+{L}</p><p>+{M}</p></main><div>all rights reserved</div>",
    "<nav><ul><li><a>home</a></li><li><a>about us</a></li></ul></nav><div class='ad'>buy this now and save a lot.</div><article><h1>+a title</h1><p>+{L}</p><p>+short one.</p><p>+{X}</p></article><footer>all rights of the owner reserved and so on.</footer>",
    "<header><div>the name of the site</div><ul><li><a>one</a></li><li><a>two</a></li></ul></header><main><h1>+title</h1><p>+{L}</p><ul><li>+a point</li><li>+another point</li></ul><h2>+part</h2><p>+{L} <a>with a link</a></p></main><aside><p>more from us and other places that you may like to see.</p><p>{L}</p></aside><footer><p>{L}</p></footer>",
    "<article><header><h1>+title</h1></header><p>+{L}</p><blockquote>+a quote of words</blockquote><p>+{X}</p><div class='comments'><p>i think that {L}</p><p>nice one</p></div></article><div class='sidebar'><p>{L}</p><ul><li><a>read this</a></li></ul></div>",
    "<div class='notice'><p>{L}</p></div><article><h1>+title</h1><p>+word</p><p>+{L}</p><p>+<a>a link alone</a></p></article><section id='comments'><h2>comments</h2><p>{X}</p><p>{L}</p></section>",
    "<h1>+title</h1><article><p>+{L}</p><p>+{M}</p></article><div>{M}</div>",
    "<div>{L}</div><article><h1>+title</h1><p>+{M}</p></article><div><h2>more of it</h2><p>{L}</p></div>",
    "<nav><a>home</a></nav><article><p>+word</p></article><div class='related-posts'><p>{M}</p><a>a title</a></div>",
    "<div class='cookie-banner'>we use cookies on this site. {L}</div><div class='content'><p>+{L}</p><p>+no.</p><pre>+some code</pre><p>+{X}</p></div><form><label>your name</label><p>{L}</p></form>",
    "<div class='content'><h1>+title</h1><p>+{M}</p></div><div id='comments'><p>{X}</p><p>{L}</p><p>{L}</p></div>",
    # names that say nothing, since nearly all that the page says lies inside
    "<div class='content-sidebar-wrap'><h1>+title</h1><p>+{L}</p><p>+{M}</p><p>+{X}</p></div><div><a>home</a> <a>top</a></div>",
    "<div class='comments-open'><p>+{X}</p><p>+short one.</p><p>+{L}</p></div><p>{M}</p>",
    "<div class='widget-page'><div class='sidebar'><p>{M}</p></div><p>+{X}</p><p>+{L}</p><p>+yes.</p><p>+{X}</p></div>",
    "<div class='modal'><p>+{X}</p><p>+{L}</p></div>",
    "<div class='popup-page'><h1>+title</h1><p>+{L}</p></div>",
    "<div class='header-story'><p>+{L}</p><p>+{X}</p></div>",
    "<div id='tracking-news'><h2>+part</h2><p>+{M}</p><p>+{L}</p></div><div><a>home</a></div>",
    # names that say something, with no article named
    "<div class='cookie-banner'>{L}</div><h1>+title</h1><p>+{L}</p><p>+{X}</p>",
    "<div class='top-banner'>{X}</div><p>+{L}</p><p>+{X}</p><p>+{L}</p>",
    "<div class='share-this'><p>{M}</p></div><p>+{L}</p><p>+{X}</p><div class='footer-text'><p>{L}</p></div>",
    "<h1>+title</h1><p>+{X}</p><p>+{L}</p><div class='comment-list'><p>{L}</p><p>{M}</p></div>",
    "<h1>+title</h1><p>+{L}</p><p>+{M}</p><div id='comments'><p>{X}</p><p>{L}</p><p>{L}</p></div><footer><p>{L}</p></footer>",
    "<aside><p>{X}</p><p>{L}</p></aside><p>+{L}</p>",
    # however much they hold
    "<h1>+title</h1><p>+{M}</p><div id='comments'><p>{L}</p><p>{X}</p><p>{L}</p><p>{X}</p><p>{L}</p><p>{X}</p><p>{L}</p><p>{X}</p></div>",
    "<div class='cookie-notice'>{X}{X}</div><h1>+title</h1><p>+short text of the day.</p>",
    "<h1>+title</h1><p>+{M}</p><div class='comment-list'><p>{X}</p><p>{L}</p><p>{X}</p><p>{L}</p><p>{X}</p><p>{L}</p></div>",
    "<p>+{L}</p><p>+{M}</p><div>copyright 2024 somebody</div>",
    "<article><h1>+title</h1><p>+{L}</p><p>+all rights reserved.</p></article>",
    "<h1>+title</h1><p>+{L}</p><div>copyright 2024 the owner of the site</div>",
]


class Tree:
    """A classification tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.label, self.at, self.cut = bool(y.mean() >= 0.5), -1, 0.0
        if depth == 0 or y.all() or not y.any():
            return
        best = 2 * y.mean() * (1 - y.mean()) - 1e-9
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= cut
                a, b = y[left].mean(), y[~left].mean()
                score = left.mean() * 2 * a * (1 - a) + (1 - left.mean()) * 2 * b * (1 - b)
                if score < best:
                    best, self.at, self.cut = score, j, float(cut)
        if self.at >= 0:
            left = x[:, self.at] <= self.cut
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def keep(self, x: np.ndarray) -> np.ndarray:
        if self.at < 0:
            return np.full(len(x), self.label)
        left = x[:, self.at] <= self.cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.keep(x[left]), self.high.keep(x[~left])
        return out

    def text(self, depth: int = 0) -> str:
        """The tree's splits, one a line."""
        if self.at < 0:
            return "  " * depth + ("keep" if self.label else "drop")
        return f"{'  ' * depth}{FEATURES[self.at]} <= {self.cut:g}\n{self.low.text(depth + 1)}\n{'  ' * depth}else\n{self.high.text(depth + 1)}"


@functools.lru_cache(1)
def tree() -> Tree:
    xs, ys = [], []
    for page in LABELLED:
        found, elements = blocks(page.format(M=_SAID, L=_LONG, X=_LONG + _SAID + _LONG))
        xs.append(table(found, elements))
        ys += [f[0].startswith("+") for f in found]
    return Tree(np.concatenate(xs), np.array(ys, bool))


def main_text(html: str | None, model: Tree | None = None) -> str:
    found, elements = blocks(html) if html else ([], [])
    if not found:
        return ""
    keep = (model or tree()).keep(table(found, elements))
    return "\n\n".join(f[0] for f, k in zip(found, keep) if k)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """The columns `keep` of pages with the main text and its number of code points."""
    B.ship(B.session(pages))
    src = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])

    def run(batches):
        model = tree()
        for batch in batches:
            _, offs = B.text_buffers(batch.column(batch.num_columns - 1))
            for lo, hi in B.row_blocks(offs, 8 * B.PIECE):
                part = batch.slice(lo, hi - lo)
                texts = [main_text(h, model) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return src.mapInArrow(B.lean(run), schema)

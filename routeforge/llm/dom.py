"""Pages as trees of elements with features of each, for the extraction of main texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np

# Elements by role, and words in attributes that tell what a part of a page is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style noscript noframes noembed template head title iframe object svg canvas audio video select textarea button annotation annotation-xml".split()
)
#: Silent elements that, if their end tag is missing, end at the first block inside.
LEFT_OPEN = frozenset("svg button select object canvas audio video noscript".split())
BLOCKS = frozenset(
    "address article blockquote center dd details div dl dt fieldset figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img input "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded "
    "mphantom menclose mfenced mtable mtr mtd mmultiscripts mprescripts none".split()
)
SECTIONS = frozenset("article main section div body td table ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
MAIN_WORDS = frozenset("article articlebody main content post entry story text body blog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "header footer masthead sidebar aside widget cookie cookies consent notice alert popup modal newsletter subscribe "
    "subscription signup login search form share sharing social related recommended breadcrumb breadcrumbs pagination "
    "pager comment comments commentlist reply replies disqus reader discussion toolbar copyright legal".split()
)
#: Elements whose content is text up to their end tag, whatever it looks like; in the last two, with references.
RAW = frozenset("script style iframe xmp noembed noframes textarea title".split())
#: What a head can hold; anything else, words included, is the body's and ends it.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which no sibling is looked for.
LISTS = ("ul", "ol", "dl", "table", "select")

FEATURES = (
    "depth", "text", "link_share", "elements_per_text", "children", "place_among_siblings", "siblings", "like_siblings",
    "share_of_parent", "sentence_marks", "place_in_page", "own_text", "main_words", "aside_words", "is_main", "is_aside",
    "in_main", "in_aside", "is_heading", "is_paragraph", "is_section", "is_list", "text_before", "parent_link_share",
)
#: Features that a page's explicit markup alone decides.
EXPLICIT = ("main_words", "is_main", "in_main")
KINDS = ("is_heading", "is_paragraph", "is_section", "is_list")


def _words(attrs: list[tuple[str, str | None]]) -> set[str]:
    out: set[str] = set()
    for name, value in attrs:
        if name in ("class", "id", "role", "itemprop", "aria-label") and value:
            word = ""
            for c in value + " ":
                if c.isalpha():
                    # An inner capital starts a word: sideBar, mainContent.
                    if c.isupper() and word and word[-1].islower():
                        out.add(word.lower())
                        word = ""
                    word += c
                elif word:
                    out.add(word.lower())
                    word = ""
    return out


_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:>|([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?)""")
_LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")


def _text(data: str) -> str:
    """Character references decoded; numbers of any length."""
    if "&" not in data:
        return data

    def short(found: re.Match) -> str:
        digits = (found[1] or found[2]).lstrip("0") or "0"
        return ("&#x" if found[2] else "&#") + (digits if len(digits) < 8 else ("110000" if found[2] else "1114112")) + ";"

    return unescape(_LONG_REFERENCE.sub(short, data))


Token = tuple[str, str, list[tuple[str, str | None]]]


def tokens(html: str) -> Iterator[Token]:
    """("text", data, []), ("start", tag, attributes) and ("end", tag, []) of any text, in one pass.

    Comments, declarations and processing instructions are left out; a comment without an end goes on to the end of the page, as does a tag without
    one. A "<" that starts nothing is text.
    """
    at, size = 0, len(html)
    low = None
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        while start < size and not (html[start + 1 : start + 2].isascii() and (html[start + 1 : start + 2].isalpha() or html[start + 1 : start + 2] in ("/", "!", "?")) and start + 1 < size):
            start = html.find("<", start + 1)
            if start < 0:
                start = size
        if start > at:
            yield "text", _text(html[at:start]), []
        if start >= size:
            return
        kind = html[start + 1]
        name = _NAME.match(html, start + 1 + (kind == "/"))
        if kind in "!?" or name is None:
            if html.startswith("<!--", start):
                # The shortest comments are <!--> and <!--->.
                end = html.find("-->", start + 2)
                at = size if end < 0 else end + 3
            else:
                end = html.find(">", start)
                if end < 0 and kind == "/":
                    yield "text", _text(html[start:]), []
                at = size if end < 0 else end + 1
            continue
        tag, at = name[0].lower(), name.end()
        if kind == "/":
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            yield "end", tag, []
            continue
        attributes: list[tuple[str, str | None]] = []
        closed = False
        while at < size:
            found = _ATTRIBUTE.match(html, at)
            if found is None:
                break
            at = found.end()
            if found[1] is None:
                closed = True
                break
            value = found[2]
            if value is not None and value[:1] in ("\"", "'") and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            attributes.append((found[1].lower(), value))
        if not closed:
            return
        yield "start", tag, attributes
        if tag in RAW:
            low = html.lower() if low is None or len(low) != size else low
            if len(low) != size:  # a letter whose small form is longer
                low = re.sub("[A-Z]+", lambda m: m[0].lower(), html)
            end = low.find(f"</{tag}", at)
            while 0 <= end and low[end + 2 + len(tag) : end + 3 + len(tag)] not in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                end = low.find(f"</{tag}", end + 2)
            end = size if end < 0 else end
            if end > at:
                yield "text", _text(html[at:end]) if tag in ("textarea", "title") else html[at:end], []
            at = end


class Page:
    """Elements in page order (parents first), and the page's text as runs and block breaks.

    ``parents``, ``tags`` and ``words`` (of attributes) are by element; ``runs`` has (element, text), or None at a block's edge.
    Texts of scripts, styles, forms' controls, graphics and the head are no runs; where such an element misses its end tag, it ends at
    the first block inside. Any text has a tree, made in time linear in its length; end tags without a start break a block at most.
    """

    def __init__(self, html: str):
        self.parents, self.tags, self.words = [-1], ["#page"], [set()]
        self.runs: list[tuple[int, str] | None] = []
        self._open = [0]
        self._places: dict[str, list[int]] = {}  # of open elements, by tag
        self._blocks: list[int] = []  # places of open elements that aren't inline
        self._silent = 0
        self._held: list[tuple[int, str] | None] | None = None  # runs since the first block in a silent element that may be left open
        for kind, value, attributes in tokens(html):
            if kind == "text":
                self._data(value)
            elif kind == "start":
                self._start(value, attributes)
            else:
                self._end(value)
        self._pop_to(1)

    def _break(self) -> None:
        if not self._silent:
            self.runs.append(None)
        elif self._held is not None:
            self._held.append(None)

    def _pop_to(self, place: int, ended: bool = False) -> None:
        """Close all open elements from ``place`` on; the one there by its own end tag if ``ended``, the others for want of one."""
        for at in range(len(self._open) - 1, place - 1, -1):
            tag = self.tags[self._open[at]]
            self._places[tag].pop()
            if tag in SILENT:
                self._silent -= 1
                if not self._silent:
                    if self._held is not None and not (ended and at == place):
                        self.runs.extend(self._held)
                    self._held = None
            if tag not in INLINE:
                self._blocks.pop()
                self._break()
        del self._open[place:]

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def _end_head(self, anywhere: bool) -> None:
        """Close an open head, whose end tag may be left out: the innermost element, or one further out."""
        place = self._last(("head",))
        if place and (anywhere or place == len(self._open) - 1):
            self._pop_to(place)

    def _start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_TAGS:
            self._end_head(tag == "body")
        if tag not in INLINE:
            if tag in BLOCKS and self._silent == 1 and self._held is None and self._last(LEFT_OPEN):
                self._held = []
            self._break()
            if tag != "br" and self._blocks and self.tags[self._open[self._blocks[-1]]] == "p":
                self._pop_to(self._blocks[-1])  # a block ends an open paragraph around it
        if tag in SIBLINGS:
            place = self._last(SIBLINGS[tag])
            if place > self._last(LISTS):
                self._pop_to(place)
        if tag in VOID:
            return
        self.parents.append(self._open[-1])
        self.tags.append(tag)
        self.words.append(_words(attrs) if attrs else set())
        place = len(self._open)
        self._open.append(len(self.tags) - 1)
        self._places.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self._blocks.append(place)
        self._silent += tag in SILENT

    def _end(self, tag: str) -> None:
        place = self._last((tag,))
        if place:
            self._pop_to(place, ended=True)
        elif tag not in INLINE:
            self._break()

    def _data(self, data: str) -> None:
        if self._silent and not data.isspace():
            self._end_head(False)
        if not self._silent:
            self.runs.append((self._open[-1], data))
        elif self._silent == 1 and self._held is not None:
            self._held.append((self._open[-1], data))


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(elements, FEATURES) and each element's length of own text."""
    n = len(page.tags)
    parent = np.array(page.parents)
    tag = page.tags
    own, marks, links, start = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    seen = 0.0
    for run in page.runs:
        if run is None:
            continue
        node, text = run
        size = len(text) - text.count(" ") if not text.isspace() else 0
        if size:
            own[node] += size
            marks[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
            if start[node] < 0:
                start[node] = seen
            seen += size
    flags = {
        "is_main": np.array([t in MAIN_TAGS for t in tag], float),
        "is_aside": np.array([t in ASIDE_TAGS for t in tag], float),
        "main_words": np.array([len(w & MAIN_WORDS) if w else 0 for w in page.words], float),
        "aside_words": np.array([len(w & ASIDE_WORDS) if w else 0 for w in page.words], float),
        "is_heading": np.array([t in HEADINGS for t in tag], float),
        "is_paragraph": np.array([t == "p" for t in tag], float),
        "is_section": np.array([t in SECTIONS for t in tag], float),
        "is_list": np.array([t in ("ul", "ol", "li", "dl") for t in tag], float),
    }
    link = np.array([t == "a" for t in tag])
    depth, in_main, in_aside, in_link = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    place, children = np.zeros(n), np.zeros(n)
    before, last_text = np.zeros(n), np.zeros(n)
    alike: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        in_main[k] = in_main[p] or flags["is_main"][k]
        in_link[k] = in_link[p] or link[k]
        place[k] = children[p]
        children[p] += 1
        alike[p, tag[k]] = alike.get((p, tag[k]), 0) + 1
    links[in_link] = own[in_link]
    total, elements = own.copy(), np.ones(n)
    first = np.where(start < 0, np.inf, start)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        total[p] += total[k]
        marks[p] += marks[k]
        links[p] += links[k]
        elements[p] += elements[k]
        first[p] = min(first[p], first[k])
    for k in range(1, n):
        before[k] = last_text[parent[k]]
        last_text[parent[k]] = total[k]
    # A part that holds most of the page's text, with its article or main if there is one, is no aside, whatever its attributes say;
    # and an article or main is not inside one because of words or a form around it.
    mains = flags["is_main"].copy()
    for k in range(n - 1, 0, -1):
        mains[parent[k]] += mains[k]
    whole = (2 * total > seen) & ((mains > 0) | (mains[0] == 0))
    fixed = np.zeros(n, bool)  # inside an aside by its element
    for k in range(1, n):
        p = parent[k]
        own_aside = (flags["is_aside"][k] or flags["aside_words"][k] > 0) and tag[k] not in ("html", "body", "main") and not whole[k]
        fixed[k] = tag[k] != "main" and (fixed[p] or (own_aside and flags["is_aside"][k] and tag[k] != "form"))
        in_aside[k] = own_aside or (fixed[k] if flags["is_main"][k] else in_aside[p])
    safe = np.maximum(total, 1)
    up = np.maximum(parent, 0)
    link_share = links / safe
    columns = {
        "depth": depth, "text": np.log1p(total), "link_share": link_share, "elements_per_text": elements / safe,
        "children": np.log1p(children), "place_among_siblings": place / np.maximum(children[up], 1),
        "siblings": np.log1p(children[up]), "like_siblings": np.array([alike.get((int(parent[k]), tag[k]), 1) for k in range(n)]) / np.maximum(children[up], 1),
        "share_of_parent": total / np.maximum(total[up], 1), "sentence_marks": marks / safe,
        "place_in_page": np.where(np.isinf(first), 1.0, first / max(seen, 1.0)), "own_text": np.log1p(own), **flags,
        "in_main": in_main, "in_aside": in_aside, "text_before": np.log1p(before), "parent_link_share": link_share[up],
    }
    return np.stack([columns[f] for f in FEATURES], axis=1), own


_PARAGRAPH = re.compile(r"<p>((?:[^<]|<(?!/?p>))*+)</p>")


def with_asides(html: str, number: int, most: int = 3) -> str:
    """The page with parts marked as asides planted after some of its paragraphs; each repeats the text of another paragraph, so that
    nothing but its markup and place tells. ``number`` chooses paragraphs and kinds: consecutive numbers take all kinds in turn.
    """
    paragraphs = list(_PARAGRAPH.finditer(html))
    kinds = [(t, None) for t in sorted(ASIDE_TAGS - {"form"})] + [("div", w) for w in sorted(ASIDE_WORDS)]
    out, done = [], 0
    places = {paragraphs[(number * 7 + k * 3) % len(paragraphs)].end(): k for k in range(most)} if paragraphs else {}
    for end, k in sorted(places.items()):
        tag, word = kinds[(number * most + k) % len(kinds)]
        text = paragraphs[(number * 5 + k) % len(paragraphs)][1]
        mark = f' class="{word}"' if word else ""
        out.append(f"{html[done:end]}<{tag}{mark}><p>{text}</p></{tag}>")
        done = end
    return "".join(out) + html[done:]


def explicit_labels(x: np.ndarray) -> np.ndarray:
    """1 for elements that explicit markup puts into the main text, 0 for all others."""
    return ((x[:, FEATURES.index("in_main")] > 0) & (x[:, FEATURES.index("in_aside")] == 0)).astype(int)


def decode(parents: list[int], scores: np.ndarray) -> np.ndarray:
    """Which elements belong to the main text, given each one's weighted log-odds.

    On a way from the root down the choice is out, then in, then cut, each for as long as it likes: nothing inside a
    part that was cut comes back. Of all such choices the one of greatest sum is taken.
    """
    n = len(parents)
    out, inside, cut = -scores.copy(), scores.copy(), -scores.copy()
    for k in range(n - 1, 0, -1):
        p = parents[k]
        out[p] += max(out[k], inside[k])
        inside[p] += max(inside[k], cut[k])
        cut[p] += cut[k]
    state = np.zeros(n, np.int8)  # 0 out, 1 in, 2 cut
    state[0] = 1 if inside[0] > out[0] else 0
    for k in range(1, n):
        above = state[parents[k]]
        if above == 0:
            state[k] = 1 if inside[k] > out[k] else 0
        elif above == 1:
            state[k] = 1 if inside[k] >= cut[k] else 2
        else:
            state[k] = 2
    return state == 1


def main_text(page: Page, chosen: np.ndarray) -> str:
    """Texts of the chosen elements: white space inside a block is one space, blocks are joined by one."""
    blocks, block = [], []
    for run in page.runs:
        if run is None:
            if block:
                blocks.append("".join(block))
                block = []
        elif chosen[run[0]]:
            block.append(run[1])
    if block:
        blocks.append("".join(block))
    return " ".join(w for b in blocks for w in b.split())

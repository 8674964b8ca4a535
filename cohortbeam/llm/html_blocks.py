"""Flat text blocks of a web page, with the numbers a classifier needs.

One linear scan: tags, comments and raw elements are stepped over with ``find``,
every attribute text is read once, and an element's state is made from its
parent's when it opens. A page of any size or brokenness costs time in
proportion to its length.
"""
from __future__ import annotations

import html as html_text
import re
from dataclasses import dataclass

import numpy as np

# Element names and the words of class, id and role that say what an element holds.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist map math noscript object select svg template video".split())
ENDS_SAME = frozenset("dd dt li option td th tr".split())
MAIN_TAGS = frozenset("article main".split())
REST_TAGS = frozenset("aside dialog footer form header menu nav search".split())
MAIN_WORDS = frozenset("article articlebody blogpost body content entry main mainbody page post posting story".split())
REST_WORDS = frozenset(
    "ad ads adslot advert advertisement advertising adverts alert aside banner bar breadcrumb breadcrumbs bottombar "
    "comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion "
    "disqus feedback footer form gdpr guestbook header hidden legal links login masthead menu menubar meta modal nav "
    "navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup popular promo "
    "promoted promotion rail recommended register related replies reply respond responses reviews search share "
    "sharing sidebar signin signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar "
    "trending warning widget widgets".split())
COMMENT_WORDS = frozenset("comment comments discussion disqus feedback guestbook replies reply respond responses reviews".split())
REST_STEMS = ("advert", "breadcrumb", "comment", "cookie", "footer", "header", "masthead", "navigation", "newsletter", "sidebar",
              "sponsor")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "heading", "list_item", "nearest", "main_around", "rest_around", "rest_inside", "comment", "header",
            "page_names_main", "page_names_rest")

ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARK = re.compile("[\"'>]")
LONG_NUMBER = re.compile(r"&#([0-9]{20,});?")
NAMED = frozenset(("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style", "data-main", "data-rest"))


@dataclass(slots=True)
class State:
    """What an open element tells about the text inside it."""
    tag: str = ""
    nearest: int = 0  # of the nearest element that says anything: 1 main text, -1 other
    main_around: int = 0  # elements around that say main text
    rest_around: int = 0  # elements around that say other
    rest_inside: int = 0  # such elements inside one that says main text
    comment: int = 0
    header: int = 0  # whether the nearest element that says other is a header
    unseen: bool = False
    label: int = 0  # for labelled pages


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_density: float
    heading: int
    list_item: int
    state: State


def decoded(text: str) -> str:
    if "&" not in text:
        return text
    # references of many digits, cut so that they stay beyond the last code point
    return html_text.unescape(LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'};", text))


def _opened(parent: State, tag: str, attributes: str) -> State:
    said, label, unseen, words = 0, parent.label, parent.unseen or tag in UNSEEN, set()
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name not in NAMED:
                continue
            if name in ("class", "id", "role", "itemprop"):
                words.update(w.lower() for w in WORD.findall(value))
                words.update(w.lower() for w in value.split())
                words.update(stem for w in list(words) for stem in REST_STEMS if w.startswith(stem))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and (
                    "display:none" in value.lower().replace(" ", "")):
                words.add("hidden")
            elif name.startswith("data-"):
                label = int(name == "data-main")
    if tag in REST_TAGS or words & REST_WORDS:
        said = -1
    elif tag in MAIN_TAGS or words & MAIN_WORDS:
        said = 1
    return State(tag, said or parent.nearest, parent.main_around + (said > 0), parent.rest_around + (said < 0),
                 parent.rest_inside + (said < 0 and parent.main_around > 0),
                 parent.comment or int(bool(words & COMMENT_WORDS)),
                 int(tag == "header" or "header" in words) if said < 0 else parent.header, unseen, label)


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag that is open at ``at`` ends, a > in quotes left out; -1:
    nowhere. ``lost``: the quote marks that are known to have no partner left."""
    while m := MARK.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if m[0] not in lost:
            close = page.find(m[0], at)
            if close < 0:  # an unpaired mark stands for itself
                lost.add(m[0])
            else:
                at = close + 1
    return -1


class _Page:
    def __init__(self):
        self.blocks: list[Block] = []
        self.stack = [State()]
        self.open: dict[str, int] = {}
        self.link_depth = 0  # of the stack when the open link began, 0 for none
        self.pieces: list[str] = []
        self.link_words = 0

    def text(self, raw: str) -> None:
        if self.stack[-1].unseen:
            return
        text = decoded(raw)
        self.pieces.append(text)
        if self.link_depth:
            self.link_words += len(text.split())

    def flush(self) -> None:
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                top = self.stack[-1]
                self.blocks.append(Block(" ".join(words), len(words), min(1.0, self.link_words / len(words)),
                                         int(top.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
                                         int(top.tag in ("li", "dd", "dt")), top))
        self.pieces, self.link_words = [], 0

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        elif tag == "a":
            self.link_depth = len(self.stack) if "href" in attributes.lower() else 0
        elif tag in BLOCK or tag in UNSEEN:
            if tag in BLOCK:
                self.flush()
            if tag not in IN_HEAD and self.stack[-1].tag == "head":
                self.pop()
            if tag in BLOCK and self.stack[-1].tag == "p":
                self.pop()
            if tag in ENDS_SAME and (self.stack[-1].tag == tag or {tag, self.stack[-1].tag} in ({"dd", "dt"}, {"td", "th"})):
                self.pop()
            if tag != "hr":
                self.stack.append(_opened(self.stack[-1], tag, attributes))
                self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        elif tag in BLOCK or tag in UNSEEN:
            if tag in BLOCK:
                self.flush()
            if self.open.get(tag):
                while self.stack[-1].tag != tag:
                    self.pop()
                self.pop()


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order: white space is one space, references are
    decoded, scripts, styles, comments and controls are gone."""
    page = page or ""
    out, at, size = _Page(), 0, len(page)
    lost: set[str] = set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            out.text(page[at:])
            break
        if lt > at:
            out.text(page[at:lt])
        nxt = page[lt + 1:lt + 2]
        if nxt.isascii() and nxt.isalpha() or nxt == "/" and page[lt + 2:lt + 3].isascii() and page[lt + 2:lt + 3].isalpha():
            end = _tag_end(page, lt + 1, lost)
            if end < 0:  # a tag that never ends swallows the rest
                break
            body = page[lt + 1 + (nxt == "/"):end]
            name = re.match(r"[^\s/>]+", body)[0]
            tag, at = name.lower(), end + 1
            if nxt == "/":
                out.end(tag)
            else:
                out.start(tag, body[len(name):])
                if tag in RAW:
                    close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                    at = close.start() if close else size
        elif page.startswith("<!--", lt):
            end = lt + 2 if page.startswith(("<!-->", "<!--->"), lt) else page.find("-->", lt + 4)
            at = size if end < 0 else page.find(">", end) + 1
        elif nxt in ("!", "?", "/") and nxt:
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        else:
            out.text("<")
            at = lt + 1
    out.flush()
    return out.blocks


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block. What is around every block of the
    page says nothing about any of them; whether the page names its main text or
    its other parts at all tells what to make of blocks that nothing names."""
    words = np.array([b.words for b in found], dtype=float)
    links = np.array([b.link_density for b in found], dtype=float)

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(x))
        if by > 0:
            out[1:] = x[:-1]
        else:
            out[:-1] = x[1:]
        return out

    own = np.array([(b.heading, b.list_item, b.state.nearest, b.state.main_around, b.state.rest_around,
                     b.state.rest_inside, b.state.comment, b.state.header) for b in found], dtype=float).reshape(len(found), 8)
    own[:, 4] -= own[:, 4].min(initial=np.inf) if len(found) else 0
    names = np.ones((len(found), 1)) * [[((own[:, 2] > 0) & (own[:, 4] == 0)).any(), (own[:, 4] > 0).any()]]
    return np.column_stack([words, links, moved(words, 1), moved(links, 1), moved(words, -1), moved(links, -1), own, names])

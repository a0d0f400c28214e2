"""A forgiving reading of HTML: merged block elements and the text that stands in each.

Only block elements are kept; inline markup is transparent.  Siblings with the same
label (tag, class words and id without digits, role) are one element, so a list has
one ``li`` and an article one ``p``, however long they are.
"""
from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from html import unescape

# Elements of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("noscript template object svg canvas audio video map select button datalist applet".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = BLOCKS - frozenset("html body caption tbody td tfoot th thead tr legend".split())
# A start tag ends these open elements, looked for up to one of the barriers.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
_P_BARRIERS = frozenset(("button", "table", "td", "th", "caption", "object", "template"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s=>/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+|=)*+)>?",
    re.S)
_ATTR = re.compile(r"([^\s=>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@lru_cache(maxsize=4096)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


@lru_cache(maxsize=1 << 16)
def describe(tag: str, attrs: str) -> tuple[str, tuple[str, ...], str, bool]:
    """Label, words of class and id, role and whether the element is hidden."""
    words, role, hidden = [], "", False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), unescape(next((v for v in values if v), ""))
        if name in ("class", "id"):
            words += [w.lower() for w in _WORD.findall(value)]
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return " ".join([tag, *sorted(set(words)), role]), tuple(words), role, hidden


class Element:
    """A merged element of one page; ``key`` names the path of labels to it."""

    __slots__ = ("tag", "label", "words", "role", "hidden", "parent", "key", "children", "order", "texts")

    def __init__(self, tag, label, words, role, hidden, parent, key):
        self.tag, self.label, self.words, self.role, self.hidden = tag, label, words, role, hidden
        self.parent, self.key = parent, key
        self.children: dict[str, int] = {}
        self.order: list[str] = []   # labels of the children as they follow each other, repeats once
        self.texts: list[int] = []   # its own blocks

    @property
    def plain(self) -> bool:
        return self.label == f"{self.tag} "


def hash64(*parts: bytes) -> int:
    """A signed 64-bit hash, the same in every process."""
    return int.from_bytes(hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=1 << 16)
def _child_key(key: int, label: str) -> int:
    return hash64(key.to_bytes(8, "big", signed=True), label.encode())


class Page:
    """``elements`` in the order of their first start (0 is the page), ``blocks`` as (element, text) in page order."""

    def __init__(self, html: str, site: int = 0):
        self.elements = [Element("", "", (), "", False, -1, site)]
        self.blocks: list[tuple[int, str]] = []
        self._open = [0]
        self._parts: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                begin = size
            if begin > at:
                self._parts.append(html[at:begin])
            if begin == size:
                break
            token = _TOKEN.match(html, begin)
            if token is None:          # a lone "<"
                self._parts.append("<")
                at = begin + 1
                continue
            at = token.end()
            tag = token["tag"]
            if tag is None:            # comment or declaration
                continue
            tag = tag.lower()
            if token["end"]:
                self._end(tag)
            elif tag in RAW:
                found = _raw_end(tag).search(html, at)
                at = size if found is None else (html.find(">", found.end()) + 1 or size)
                self._parts.append(" ") if tag in ("textarea", "iframe") else None
            elif tag == "br":
                self._parts.append(" ")
            elif tag in BLOCKS or tag in UNSEEN:
                self._start(tag, token["attrs"])
        self._flush()

    def _flush(self) -> None:
        if not self._parts:
            return
        text = " ".join("".join([unescape(p) if "&" in p else p for p in self._parts]).split())
        self._parts.clear()
        if text:
            at = self._open[-1]
            self.elements[at].texts.append(len(self.blocks))
            self.blocks.append((at, text))

    def _start(self, tag: str, attrs: str) -> None:
        self._flush()
        if tag in _CLOSES_P:
            self._close(("p",), _P_BARRIERS)
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag == "hr":
            return
        if tag == "body" and any(self.elements[i].tag == "body" for i in self._open):
            return
        parent = self._open[-1]
        over = self.elements[parent]
        label, words, role, hidden = describe(tag, attrs)
        number = over.children.get(label)
        if number is None:
            number = over.children[label] = len(self.elements)
            self.elements.append(Element(tag, label, words, role, hidden, parent, _child_key(over.key, label)))
        if not over.order or over.order[-1] != label:
            over.order.append(label)
        self._open.append(number)

    def _close(self, tags, barriers) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.elements[self._open[depth]].tag
            if tag in tags:
                del self._open[depth:]
                return
            if tag in barriers:
                return

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or tag not in BLOCKS and tag not in UNSEEN:
            return
        self._flush()
        self._close((tag,), ())

    def style(self, element: Element) -> int:
        return hash64(*[label.encode() for label in element.order])

"""Tolerant block trees of HTML pages: elements that make blocks, and runs of text between them."""

from __future__ import annotations

import html
import re

# HTML's element kinds.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
#: Never shown as text, with all that they hold.
UNSEEN = frozenset("audio button canvas datalist iframe math noembed noframes noscript object option optgroup script select style svg template textarea title video".split())
#: What they hold is text up to their own end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element closes an open one of these, unless one of the walls lies between.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Attributes whose words tell what an element is for.
NAMED = frozenset("class id role itemprop aria-label data-role data-type".split())
SHORT = 24
TEXT = "#text"


class Page:
    """Nodes in page order, each after its parent: tag, parent, depth, attribute tokens, and for runs of text (TEXT)
    the text, how many of its characters are in links, and marks of the nodes that carry `data-main`."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.tokens, self.text, self.linked, self.controls, self.main = [], [], [], [], [], [], [], []

    def add(self, tag: str, parent: int, tokens=(), text: str = "", linked: int = 0, main: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        self.controls.append(0)
        self.main.append(main)
        return len(self.tag) - 1


def tokens_of(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Lower-case words of the naming attributes, and whether `data-main` is there."""
    out, main = {}, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in NAMED:
            out |= dict.fromkeys(t.lower() for t in _TOKEN.findall(a or b or c) if 2 <= len(t) <= SHORT)
        main |= name == "data-main"
    return tuple(out), main


def parse(source: str) -> Page:
    """The page's tree. Every start tag of an element that is not inline begins a node; text between the starts and
    ends of such elements is one run, without white space at its ends and with single spaces inside; empty runs are
    left out. Unknown and unclosed elements are taken as they stand."""
    page = Page()
    stack = [page.add("html", -1)]
    opened = {"html": 1}
    pieces: list[str] = []
    links: list[str] = []
    in_link, at, size = False, 0, len(source)

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.add(TEXT, stack[-1], text=text, linked=min(len(text), len(" ".join(html.unescape(" ".join(links)).split()))) if links else 0)
            pieces.clear()
            links.clear()

    def close() -> None:
        opened[page.tag[stack.pop()]] -= 1

    def say(text: str) -> None:
        pieces.append(text)
        if in_link:
            links.append(text)

    while at < size:
        found = _TAG.search(source, at)
        if not found:
            say(source[at:])
            break
        if found.start() > at:
            say(source[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            continue
        tag, ending = name.lower(), bool(found[1])
        if tag == "a":
            in_link = not ending
            continue
        if tag in UNSEEN or tag == "xmp":
            if not ending and not found[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                if tag in RAW or end:
                    at = end.end() if end else size
            if tag in ("button", "select", "textarea"):
                page.controls[stack[-1]] += 1
            pieces.append(" ")
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                say(" ")
            continue
        flush()
        in_link = False
        if ending:
            if tag not in ("body", "html") and opened.get(tag, 0):
                while page.tag[stack[-1]] != tag:
                    close()
                close()
            continue
        if tag in VOID:
            page.controls[stack[-1]] += tag == "input"
            continue
        if tag in ("html", "head", "body"):
            continue
        if page.tag[stack[-1]] == "p" or (tag in HEADINGS and page.tag[stack[-1]] in HEADINGS):
            close()
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            deep = next((i for i in range(len(stack) - 1, max(0, len(stack) - 64), -1) if page.tag[stack[i]] in ends | walls), 0)
            while deep and page.tag[stack[deep]] in ends:
                while len(stack) > deep:
                    close()
                deep = len(stack) - 1 if page.tag[stack[-1]] in ends else 0
        words, main = tokens_of(found[3])
        if not found[3].endswith("/>") or tag not in VOID:
            stack.append(page.add(tag, stack[-1], words, main=main))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return page

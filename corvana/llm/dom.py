"""A small HTML reader: block elements and the runs of text between block boundaries."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button textarea label iframe object video audio svg".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template head title svg iframe object textarea select math canvas".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the second set, unless one of the third stands between.
_LIST, _ROW, _CELL = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",)), frozenset(("table", "tr"))
ENDS = {
    "li": (frozenset(("li",)), _LIST),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), _ROW),
    "td": (frozenset(("td", "th")), _CELL),
    "th": (frozenset(("td", "th")), _CELL),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), _ROW),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Blocks that end an open paragraph.
_KEEP_P = frozenset(("button", "label", "svg", "video", "audio", "object", "iframe", "select", "textarea", "option", "optgroup", "html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend"))
_P_SCOPE = frozenset(("button", "td", "th", "caption", "table", "html", "object"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SIGN = re.compile(r"[>\"']")


@dataclass
class Node:
    """A block element, or a run of text (tag '#text')."""

    tag: str
    parent: int
    attributes: str = ""
    text: str = ""
    linked: int = 0
    label: int = -1
    children: int = 0
    names: dict[str, str] = field(default_factory=dict)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


class _Tokens:
    """Tags and the text between them, in one pass: each character is looked at a bounded number of times."""

    def __init__(self, source: str) -> None:
        self.source, self.at, self.quoted = source, 0, True

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name or text, rest of the tag); kinds: text, open, close."""
        source, end = self.source, len(self.source)
        while self.at < end:
            at = self.at
            if source[at] != "<":
                self.at = stop = (source.find("<", at) + 1 or end + 1) - 1
                yield "text", source[at:stop], ""
                continue
            if source.startswith("<!--", at):
                self.at = (source.find("-->", at + 4) + 3) if source.find("-->", at + 4) >= 0 else end
                continue
            after = source[at + 1 : at + 2]
            if after in ("!", "?"):
                self.at = (source.find(">", at) + 1) or end
                continue
            closing = after == "/"
            name = _NAME.match(source, at + 1 + closing)
            stop = self.tag_end(name.end()) if name else -1
            if stop < 0:  # no tag, or one whose quotes never end: its sign is text
                self.at = at + 1
                yield "text", "<", ""
                continue
            self.at = min(stop + 1, end)
            yield ("close" if closing else "open"), name[0].lower(), source[name.end() : stop]

    def tag_end(self, at: int) -> int:
        """Where the tag's `>` is, or the end of the page; -1 where a quote never ends, after which quotes count no more."""
        source = self.source
        while self.quoted:
            sign = _SIGN.search(source, at)
            if sign is None:
                return len(source)
            if sign[0] == ">":
                return sign.start()
            at = source.find(sign[0], sign.end()) + 1
            if not at:
                self.quoted = False
                return -1
        stop = source.find(">", at)
        return stop if stop >= 0 else len(source)


def parse(source: str | None) -> list[Node]:
    """Nodes in page order, parents before children; node 0 is the root.

    White space of a run is one space, character references are decoded, comments
    and silent elements are left out. Tags that are missing or out of order end
    where their parents do. Time is in proportion to the page, whatever its markup:
    the open elements of each name are known by their depth.
    """
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # block elements that are open
    depths: dict[str, list[int]] = defaultdict(list)  # where those of a name are
    links = linked = 0
    quiet: list[str] = []
    hushed: Counter[str] = Counter()
    run: list[str] = []
    source = source or ""

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                at = stack[-1][1]
                nodes[at].children += 1
                nodes.append(Node("#text", at, text=text, linked=min(linked, len(text))))
        run.clear()
        linked = 0

    def close_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            depths[stack.pop()[0]].pop()

    def nearest(names: Iterable[str]) -> int:
        """Depth of the innermost open element of any of the names, 0 without one."""
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    tokens = _Tokens(source)
    for kind, tag, rest in tokens:
        if kind == "text":
            if not quiet:
                run.append(tag)
                if links:
                    linked += len(tag)
            continue
        if kind == "close":
            if quiet:
                if hushed[tag]:
                    while (name := quiet.pop()) != tag:
                        hushed[name] -= 1
                    hushed[tag] -= 1
                continue
            if tag == "a":
                links = 0
            elif tag in BLOCKS:
                depth = nearest((tag,))
                if depth:
                    close_to(depth)
                else:
                    flush()
                links = 0
            continue
        if quiet:
            if tag in SILENT and tag not in VOID and not rest.endswith("/") and tag not in RAW:
                quiet.append(tag)
                hushed[tag] += 1
            elif tag == "body":  # a head that was never closed
                quiet.clear()
                hushed.clear()
            elif tag not in RAW:
                continue
            if quiet and tag not in RAW:
                continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, tokens.at)
            if tag in BLOCKS and not quiet:
                flush()
            tokens.at = stop.end() if stop else len(source)
            continue
        if tag in SILENT:
            if not rest.endswith("/"):
                quiet.append(tag)
                hushed[tag] += 1
            if tag in BLOCKS:
                flush()
            continue
        if tag == "a":
            links = 1
        elif tag == "br":
            run.append("\n")
        elif tag in BLOCKS:
            if tag not in _KEEP_P:
                paragraph = nearest(("p",))
                if paragraph > nearest(_P_SCOPE):
                    close_to(paragraph)
            if tag in ENDS:
                ended, scope = ENDS[tag]
                inner = nearest(ended)
                if inner > nearest(scope - ended):
                    close_to(inner)
            flush()
            links = 0
            if tag == "hr":
                continue
            above = stack[-1][1]
            nodes[above].children += 1
            names = attributes(rest) if rest and not rest.isspace() else {}
            nodes.append(Node(tag, above, names=names))
            depths[tag].append(len(stack))
            stack.append((tag, len(nodes) - 1))
    flush()
    return nodes

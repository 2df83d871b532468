"""Element trees of raw web pages, as flat arrays over many pages at once."""

from __future__ import annotations

import html as entities
import re

import numpy as np

#: Elements that are part of the line of text they stand in.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img br picture source".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that isn't markup, up to the element's own end tag, and is no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Other elements whose content is no text of the page.
SILENT = frozenset("template noscript select button svg math object audio video canvas datalist map".split())
#: What an opening tag closes first, up to the elements that hold it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
CELLS = frozenset({"td", "th", "table"})
TABLE = frozenset("table thead tbody tfoot tr td th body html".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+>?""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_NAMED = frozenset({"class", "id", "role", "itemprop", "aria-label", "data-role"})
_PUNCTUATION = ".!?,;:。，、؟।"


class Attributes:
    """Tokens of an element's naming attributes; a bounded cache."""

    def __init__(self):
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, raw: str) -> tuple[str, ...]:
        found = self.known.get(raw)
        if found is None:
            tokens: dict[str, None] = {}
            for m in _ATTRIBUTE.finditer(raw):
                name, value = m[1].lower(), (m[2] or "").strip("\"'")
                if name in _NAMED:
                    tokens.update(dict.fromkeys(w.lower() for w in _WORDS.findall(entities.unescape(value)) if len(w) > 1))
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    tokens["_hidden"] = None
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[raw] = tuple(tokens)
        return found


class Pages:
    """Nodes of a batch of pages, each page in the order of its tags.

    A node is an element that is a block of its own or has naming attributes, or a run
    of text between two such elements; node 0 of a page stands for the page."""

    TEXT, PAGE = "#text", "#page"

    def __init__(self):
        self.attributes = Attributes()
        self.tag: list[str] = []
        self.tokens: list[tuple[str, ...]] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.page: list[int] = []
        self.runs: list[list[tuple[int, int, str]]] = []  # by page: node (-1: blanks), block, text
        self.counts: list[tuple[int, int, int, int, int]] = []  # by run: node, letters, linked letters, words, marks

    def __len__(self):
        return len(self.tag)

    def _node(self, tag, tokens, parent) -> int:
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(0)
        self.page.append(len(self.runs) - 1)
        return len(self.tag) - 1

    def add(self, html: str) -> None:
        """Parse one page."""
        self.runs.append([])
        runs, end = self.runs[-1], self.end
        root = self._node(self.PAGE, (), -1)
        stack: list[tuple[str, int]] = []  # open elements that are nodes
        open_: dict[str, int] = {}
        pieces: list[str] = []
        linked = link = block = muted = 0
        here = root

        def flush():
            nonlocal linked
            if pieces:
                text = "".join(pieces)
                pieces.clear()
                words = text.split()
                if muted:
                    runs.append((-1, block, " "))
                elif words:
                    node = self._node(self.TEXT, (), here)
                    end[node] = node + 1
                    letters = sum(map(len, words))
                    self.counts.append((node, letters, min(linked, letters), len(words),
                                        sum(map(text.count, _PUNCTUATION))))
                    runs.append((node, block, text))
                else:
                    runs.append((-1, block, " "))
            linked = 0

        def pop():
            nonlocal here, link, block, muted
            name, node = stack.pop()
            muted -= name in SILENT
            open_[name] -= 1
            end[node] = len(self.tag)
            here = stack[-1][1] if stack else root
            if name not in INLINE:
                link = 0
                block += 1

        def close_until(names, holders):
            """Close open ``names`` that no holder shields."""
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in holders:
                    break
                if stack[k][0] in names:
                    flush()
                    while len(stack) > k:
                        pop()
                    break

        at = 0
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                text = html[at:m.start()]
                text = entities.unescape(text) if "&" in text else text
                pieces.append(text)
                linked += link * len(text)
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            inline = name in INLINE
            if m[1]:
                if name == "a":
                    link = 0
                if open_.get(name):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            flush()
                            while len(stack) > k:
                                pop()
                            break
                        if inline and stack[k][0] not in INLINE or stack[k][0] in CELLS and name not in TABLE:
                            break
                elif not inline:
                    flush()
                    block += 1
                continue
            if name in RAW:
                stop = _END[name].search(html, at)
                at = stop.start() if stop else len(html)
                pieces.append(" ")
                continue
            if name in ("html", "body", "head"):
                continue
            if name == "br":
                pieces.append(" ")
            if name in VOID:
                if not inline:
                    flush()
                    block += 1
                continue
            if name == "a":
                link = 1
            tokens = self.attributes(m[3]) if m[3] else ()
            if inline and not tokens:
                continue
            if not inline:
                for control in ("button", "select"):  # blocks end a control that was left open
                    if open_.get(control):
                        close_until({control}, CELLS)
                if open_.get("p"):
                    close_until({"p"}, CELLS)
                if name in CLOSES and any(open_.get(c) for c in CLOSES[name][0]):
                    close_until(*CLOSES[name])
            flush()
            if not inline:
                block += 1
                link = 0
            if m[3].endswith("/") and inline:
                continue
            here = self._node(name, tokens, here)
            stack.append((name, here))
            muted += name in SILENT
            open_[name] = open_.get(name, 0) + 1
        rest = html[at:]
        pieces.append(entities.unescape(rest) if "&" in rest else rest)
        flush()
        while stack:
            pop()
        end[root] = len(self.tag)

    def texts(self, kept: np.ndarray) -> list[str]:
        """Text of each page: its kept runs, blank runs made one blank, blocks apart."""
        out = []
        for runs in self.runs:
            blocks: dict[int, list[str]] = {}
            for node, block, text in runs:
                if node < 0 or kept[node]:
                    blocks.setdefault(block, []).append(text)
            whole = (" ".join("".join(parts).split()) for parts in blocks.values())
            out.append("\n\n".join(t for t in whole if t))
        return out

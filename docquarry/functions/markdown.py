"""Block structure of Markdown text: one pass over the lines with a stack of open containers.

Only what chunking and titles need is kept: where each top-level block begins and ends, which blocks are headings, the first heading of level 1 and the first
paragraph at any depth. A line costs what it holds plus the containers it continues, whatever came before.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from docquarry.functions.inline import inline_text, label_key

FENCE = re.compile(r"(?P<mark>`{3,}(?=[^`]*$)|~{3,})")
ATX = re.compile(r"(?P<marks>#{1,6})(?:[ \t]+(?P<text>.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
ITEM = re.compile(r"(?P<mark>[-+*]|(?P<number>\d{1,9})[.)])(?=[ \t]|$)")
FILLED = re.compile(r"[ \t]+(?=[^ \t\r])")
DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\S+(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^)]*\)))?[ \t]*$""")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
LEAD = re.compile(r"[ \t>*+\-\d.)]*")

# Element names that open an HTML block, from the CommonMark specification.
HTML_NAMES = """
    address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt
    fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link
    main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead
    title tr track ul
""".split()
# Opening pattern and closing pattern; an empty closing pattern means "until a blank line".
HTML_BLOCKS = tuple(
    (re.compile(begin, re.I), re.compile(end, re.I) if end else None)
    for begin, end in (
        (r"<(?:script|pre|style|textarea)(?:[\s>]|$)", r"</(?:script|pre|style|textarea)>"),
        (r"<!--", r"-->"),
        (r"<\?", r"\?>"),
        (r"<![A-Za-z]", r">"),
        (r"<!\[CDATA\[", r"\]\]>"),
        (rf"</?(?:{'|'.join(HTML_NAMES)})(?:[\s>]|/>|$)", ""),
    )
)
HTML_TAG_LINE = re.compile(r"""(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$""")


class Block(NamedTuple):
    kind: str
    first: int
    last: int
    level: int = 0
    text: str = ""


class Outline(NamedTuple):
    """Top-level blocks in order, with zero-based, inclusive lines; the first title and the first paragraph anywhere, empty if there is none."""

    blocks: list[Block]
    title: str
    summary: str


class _List:
    __slots__ = ("block", "kind", "loose")

    def __init__(self, kind: str, block):
        self.kind, self.block, self.loose = kind, block, False


class _Container:
    """An open quote or list item. ``width``: columns of an item's own; ``last``: its newest list, while nothing followed it."""

    __slots__ = ("block", "filled", "last", "list", "width")

    def __init__(self, block, of: _List | None = None, width: int = 0):
        self.block, self.list, self.width, self.last, self.filled = block, of, width, None, False


class _Leaf:
    __slots__ = ("close", "first", "kind", "last", "lines")

    def __init__(self, kind: str, first: int, close=None):
        self.kind, self.first, self.last, self.close, self.lines = kind, first, first, close, []


def _html(rest: str):
    """The pattern that ends the HTML block beginning here, None for a blank line, False for no such block."""
    return next((end for begin, end in HTML_BLOCKS if begin.match(rest)), False) if rest.startswith("<") else False


def _cells(row: str) -> int:
    return len(re.findall(r"(?<!\\)\|", row.strip().strip("|"))) + 1


class _Scanner:
    def __init__(self):
        self.top: list[list] = []  # kind, first, last, level, raw text
        self.root = _Container(None)
        self.stack: list[_Container] = []
        self.leaf: _Leaf | None = None
        self.title: str | None = None
        self.paragraphs: list[tuple[_List | None, str]] = []  # until the first that surely is one
        self.settled = False
        self.definitions: set[str] = set()
        self.was_blank = False

    # What is found

    def _heading(self, first: int, last: int, level: int, raw: str, top: bool) -> None:
        if level == 1 and self.title is None:
            self.title = raw
        if top:
            self.top.append(["heading", first, last, level, raw])

    def _finish(self) -> None:
        """Close the open leaf."""
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        top = not self.stack
        if leaf.kind != "paragraph":
            if top:
                self.top.append([leaf.kind, leaf.first, leaf.last, 0, ""])
            return
        lines, at = leaf.lines, 0
        while at < len(lines) and (found := DEFINITION.match(lines[at])):
            self.definitions.add(label_key(found[1]))
            at += 1
        if at == len(lines):
            return
        first, last = leaf.first + at, leaf.first + len(lines) - 1
        table = next((k for k in range(at + 1, len(lines)) if DELIMITER.match(lines[k]) and _cells(lines[k]) == _cells(lines[k - 1])), 0)
        if table:
            lines, last = lines[: table - 1], leaf.first + table - 2
        if first <= last:
            if not self.settled:
                home = self.stack[-1].list if self.stack else None
                self.paragraphs.append((home, "\n".join(line.strip() for line in lines[at:])))
                self.settled = home is None or home.loose
            if top:
                self.top.append(["paragraph", first, last, 0, ""])
        if table and top:
            self.top.append(["table", leaf.first + table - 1, leaf.first + len(leaf.lines) - 1, 0, ""])

    def _child(self, depth: int) -> _Container:
        """The container that gets a new block: everything deeper is closed. A second block after a blank line makes its list loose."""
        self._finish()
        del self.stack[depth:]
        parent = self.stack[-1] if self.stack else self.root
        if parent.list is not None:
            if self.was_blank and parent.filled:
                parent.list.loose = True
            parent.filled = True
        return parent

    # One line

    def line(self, number: int, text: str) -> None:
        lead = LEAD.match(text).end()
        if "\t" in text[:lead]:
            text = text[:lead].expandtabs(4) + text[lead:]
        at, size, depth = 0, len(text), 0

        def indent() -> int:
            i = at
            while i < size and text[i] == " ":
                i += 1
            return i - at

        blank = not text[at:].strip(" \t\r") if not self.stack else False
        for container in self.stack:
            spaces = indent()
            if at + spaces >= size or text[at + spaces] in "\t\r" and not text[at:].strip(" \t\r"):
                blank = True
                if container.list is None or not container.filled:
                    break
                depth += 1
                continue
            if container.list is None:
                if spaces > 3 or text[at + spaces] != ">":
                    break
                at += spaces + 1
                at += text.startswith(" ", at)
            elif spaces >= container.width:
                at += container.width
            else:
                break
            depth += 1
        blank = blank or not text[at : at + 1] or (text[at] in " \t\r" and not text[at:].strip(" \t\r"))
        whole = depth == len(self.stack)
        if self.stack and depth and (not blank or self.stack[0].list is None):
            self.stack[0].block[2] = number

        leaf = self.leaf
        if leaf is not None and leaf.kind != "paragraph" and whole:
            if self._feed(leaf, number, text, at, blank, indent()):
                self.was_blank = False
                return
        if blank:
            if leaf is not None and (leaf.kind == "paragraph" or not whole):
                self._finish()
            # A quote ends with the first line that does not carry its mark; so does all inside it.
            quote = next((k for k in range(depth, len(self.stack)) if self.stack[k].list is None or not self.stack[k].filled), len(self.stack))
            if quote < len(self.stack):
                self._finish()
                del self.stack[quote:]
            self.was_blank = True
            return
        self._open(number, text, at, depth, whole)
        self.was_blank = False

    def _feed(self, leaf: _Leaf, number: int, text: str, at: int, blank: bool, spaces: int) -> bool:
        """Whether the line belongs to an open fence, HTML block or indented code."""
        if leaf.kind == "fence":
            leaf.last = number
            if not blank and spaces < 4 and leaf.close.match(text, at + spaces):
                self._finish()
            return True
        if leaf.kind == "html":
            if leaf.close is None and blank:
                self._finish()
                return False
            leaf.last = number
            if leaf.close is not None and leaf.close.search(text, at):
                self._finish()
            return True
        if not blank and spaces < 4:
            self._finish()
            return False
        if not blank:
            leaf.last = number
        return True

    def _open(self, number: int, text: str, at: int, depth: int, whole: bool) -> None:
        """Open the containers that begin on the line, and its leaf; or continue a paragraph."""
        size, marks = len(text), -1  # where nothing but marks of a rule follow
        while True:
            start = at
            while at < size and text[at] == " ":
                at += 1
            spaces, paragraph = at - start, self.leaf is not None and self.leaf.kind == "paragraph"
            if at >= size:  # nothing follows a container's mark
                if depth < len(self.stack):
                    self._child(depth)
                return
            direct = paragraph and whole and depth == len(self.stack)  # the open paragraph would be its sibling
            if spaces >= 4:
                if paragraph:
                    break
                self._child(depth)
                self.leaf = _Leaf("code", number)
                return
            char = text[at]
            if char == ">":
                parent = self._child(depth)
                parent.last = None
                block = self.stack[0].block if self.stack else ["quote", number, number, 0, ""]
                if not self.stack:
                    self.top.append(block)
                self.stack.append(_Container(block))
                at += 1
                at += text.startswith(" ", at)
                depth += 1
                whole = True
                continue
            if direct and char in "=-" and (underline := SETEXT.match(text, at)) and not self._all_definitions():
                lines, first = self.leaf.lines, self.leaf.first
                self.leaf = None
                self._heading(first, number, 1 if underline[1][0] == "=" else 2, "\n".join(x.strip() for x in lines), not self.stack)
                return
            if char in "*-_" and marks < 0:
                marks = len(text.rstrip("*-_ \t\r"))
            if char in "*-_" and at >= marks and RULE.match(text, at):
                self._child(depth).last = None
                if not self.stack:
                    self.top.append(["rule", number, number, 0, ""])
                return
            if (char in "-+*" or char.isdigit()) and (item := ITEM.match(text, at)):
                filled = FILLED.match(text, item.end())
                if not (direct and (not filled or item["number"] not in (None, "1"))):
                    at, depth, whole = self._item(number, text, spaces, item, filled, depth), depth + 1, True
                    continue
            if char in "`~" and (fence := FENCE.match(text, at)):
                self._child(depth).last = None
                mark = fence["mark"]
                self.leaf = _Leaf("fence", number, re.compile(rf"{re.escape(mark)}{re.escape(mark[0])}*[ \t\r]*$"))
                return
            if char == "#" and (atx := ATX.match(text, at)):
                self._child(depth).last = None
                self._heading(number, number, len(atx["marks"]), (atx["text"] or "").strip(), not self.stack)
                return
            if char == "<" and ((end := _html(text[at:])) is not False or not paragraph and HTML_TAG_LINE.match(text, at)):
                self._child(depth).last = None
                self.leaf = _Leaf("html", number, end or None)
                if end and end.search(text, at):
                    self._finish()
                return
            break
        if paragraph:  # its next line, perhaps a lazy one
            self.leaf.lines.append(text[at:])
            self.leaf.last = number
            if self.stack:
                self.stack[0].block[2] = number
            return
        self._child(depth).last = None
        self.leaf = _Leaf("paragraph", number)
        self.leaf.lines.append(text[at:])

    def _all_definitions(self) -> bool:
        return all(map(DEFINITION.match, self.leaf.lines))

    def _item(self, number: int, text: str, spaces: int, item: re.Match, filled: re.Match | None, depth: int) -> int:
        """Open a list item, in the list before it if that is of its kind. Returns where its content begins."""
        self._finish()
        del self.stack[depth:]
        parent = self.stack[-1] if self.stack else self.root
        kind = item["mark"][-1]
        if parent.last is not None and parent.last.kind == kind:
            parent.last.loose |= self.was_blank
        else:
            if parent.list is not None:
                parent.list.loose |= self.was_blank and parent.filled
            block = self.stack[0].block if self.stack else ["list", number, number, 0, ""]
            if not self.stack:
                self.top.append(block)
            parent.last = _List(kind, block)
        parent.filled = True
        parent.last.block[2] = number
        pad = filled.end() - item.end() if filled and filled.end() - item.end() <= 4 else 1
        width = spaces + item.end() - item.start() + pad
        self.stack.append(_Container(parent.last.block, parent.last, width))
        self.was_blank = False
        return min(item.end() + pad, len(text))


def scan(lines: list[str]) -> Outline:
    """Blocks, title and summary of a text."""
    scanner = _Scanner()
    for number, line in enumerate(lines):
        scanner.line(number, line)
    scanner._finish()
    definitions = scanner.definitions
    blocks = [Block(kind, first, last, level, inline_text(raw, definitions) if level else "") for kind, first, last, level, raw in scanner.top]
    # Text of a tight item is not a paragraph.
    summary = next((raw for home, raw in scanner.paragraphs if home is None or home.loose), "")
    return Outline(blocks, inline_text(scanner.title or "", definitions), inline_text(summary, definitions))

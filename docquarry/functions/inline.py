"""Plain text of inline Markdown: one pass from left to right with stacks of delimiters and brackets, linear in the text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

#: What a text without inline markup holds none of.
SPECIAL = re.compile(r"[\\`*_~\[\]<\n]|://|www\.")
PLAIN = re.compile(r"[^\\`*_~!\[\]<hfwHFW]+")
TAG = re.compile(r"""<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|/?[A-Za-z][^<>]*)>""")
BARE = re.compile(r"(?:https?|ftp)://[^\s<]+|www\.[^\s<]+")
TITLE = r"""(?:"[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|\([^()\\]*(?:\\.[^()\\]*)*\))"""
DESTINATION = re.compile(r"\(\s*(?:<[^<>\n]*>)?")
ADDRESS = re.compile(r"[^\s()\\]*")
CLOSING = re.compile(rf"\s*\)|\s+{TITLE}\s*\)")
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
MOST_NESTED = 32  # parentheses in a link's address


def label_key(label: str) -> str:
    """Labels match without regard to case and to how their words are spaced."""
    return " ".join(label.split()).casefold()


@lru_cache(maxsize=1 << 12)
def _is_mark(char: str) -> bool:
    return unicodedata.category(char)[0] in "PS"


def _flanks(text: str, start: int, end: int) -> tuple[bool, bool, bool, bool]:
    """Whether a run of delimiters is left and right flanking, and whether punctuation stands before and after it."""
    before, after = text[start - 1 : start] or "\n", text[end : end + 1] or "\n"
    mark_before, mark_after = _is_mark(before), _is_mark(after)
    left = not after.isspace() and (not mark_after or before.isspace() or mark_before)
    right = not before.isspace() and (not mark_before or after.isspace() or mark_after)
    return left, right, mark_before, mark_after


class _Run:
    """A run of delimiters: where its text is kept, how many are left, and whether it may open or close."""

    __slots__ = ("at", "char", "closes", "left", "opens", "size")

    def __init__(self, at: int, char: str, size: int, opens: bool, closes: bool):
        self.at, self.char, self.size, self.left, self.opens, self.closes = at, char, size, size, opens, closes


def _pair(runs: list[_Run], since: int) -> None:
    """Match closing runs with opening ones from ``since`` on; what is matched leaves the text. The runs are then done with."""
    open_runs: list[_Run] = []
    barren: dict[tuple, int] = {}  # how many open runs need not be looked at again for a kind of closer
    for run in runs[since:]:
        if run.closes:
            kind = (run.char, run.opens, run.size % 3)
            k = len(open_runs) - 1
            while run.left and k >= barren.get(kind, 0):
                opener = open_runs[k]
                fits = opener.char == run.char and opener.left
                if fits and run.char == "~":
                    fits = opener.size == run.size
                elif fits and (run.opens or opener.closes):
                    fits = (opener.size + run.size) % 3 != 0 or (opener.size % 3 == 0 and run.size % 3 == 0)
                if not fits:
                    k -= 1
                    continue
                used = run.left if run.char == "~" else 2 if min(run.left, opener.left) > 1 else 1
                run.left -= used
                opener.left -= used
                del open_runs[k + 1 :]  # those between are text
                barren = {key: min(n, k + 1) for key, n in barren.items()}
                if not opener.left:
                    open_runs.pop()
                    k -= 1
            if run.left:
                barren[kind] = len(open_runs)
        if run.left and run.opens:
            open_runs.append(run)
    del runs[since:]


def _link_end(text: str, at: int, unclosed: dict[str, bool]) -> int:
    """Where a link's address and title that begin at a parenthesis end, or -1."""
    begin = DESTINATION.match(text, at)
    if not begin:
        return -1
    i, depth = begin.end(), 0
    if not begin.group().endswith(">"):
        while i < len(text):
            i = ADDRESS.match(text, i).end()
            char = text[i : i + 1]
            if not char:
                break
            if char == "\\":
                i += 1
            elif char == "(":
                depth += 1
                if depth > MOST_NESTED:
                    return -1
            elif char == ")":
                if not depth:
                    break
                depth -= 1
            elif char.isspace():
                break
            i += 1
        if depth:
            return -1
    quote = text[i:].lstrip()[:1] if text[i : i + 1].isspace() and len(text) - i < 1000 else text[i + 1 : i + 2]
    if quote in "\"'(" and quote and text[i : i + 1].isspace():
        if unclosed.get(quote) or text.find(")" if quote == "(" else quote, i + 2) < 0:
            unclosed[quote] = True  # no further search for its end
            return -1
    end = CLOSING.match(text, i)
    return end.end() if end else -1


def inline_text(text: str, definitions: dict[str, str] | frozenset | set = frozenset()) -> str:
    """Text of a heading or paragraph without its inline markup. Bare addresses and tags add nothing; lines run together.

    ``definitions``: keys of the labels that links may refer to.
    """
    if not SPECIAL.search(text):
        return text.strip()
    ticks: dict[int, list[int]] = {}
    for match in re.finditer(r"`+", text):
        ticks.setdefault(len(match.group()), []).append(match.start())
    pieces: list[str] = []
    runs: list[_Run] = []
    every_run: list[_Run] = []
    brackets: list[list] = []  # place of its piece, runs before it, place in the text, image, active
    unclosed: dict[str, bool] = {}
    no_comment_end = False
    i, n = 0, len(text)
    while i < n:
        char = text[i]
        if char == "\\" and i + 1 < n:
            pieces.append(text[i : i + 2])  # stands as written
            i += 2
        elif char == "`":
            size = 1
            while text.startswith("`", i + size):
                size += 1
            places = ticks[size]
            k = bisect_left(places, i + size)
            if k < len(places):
                code = text[i + size : places[k]].replace("\n", " ")
                pieces.append(code[1:-1] if code[0] == code[-1] == " " and code.strip() else code)
                i = places[k] + size
            else:
                pieces.append("`" * size)
                i += size
        elif char in "*_~":
            size = 1
            while text.startswith(char, i + size):
                size += 1
            left, right, mark_before, mark_after = _flanks(text, i, i + size)
            if char == "_":
                left, right = left and (not right or mark_before), right and (not left or mark_after)
            if char == "~" and size > 2:
                left = right = False
            pieces.append(char * size)
            if left or right:
                run = _Run(len(pieces) - 1, char, size, left, right)
                runs.append(run)
                every_run.append(run)
            i += size
        elif char == "<":
            tag = TAG.match(text, i)
            if text.startswith("<!--", i) and not no_comment_end:
                end = text.find("-->", i + 4)
                no_comment_end = end < 0
                if end >= 0:
                    i = end + 3
                    continue
            if tag:
                i = tag.end()
            else:
                pieces.append(char)
                i += 1
        elif char == "[" or char == "!" and text.startswith("[", i + 1):
            image = char == "!"
            brackets.append([len(pieces), len(runs), i + 1 + image, image, True])
            pieces.append("![" if image else "[")
            i += 1 + image
        elif char == "]":
            i = _close_bracket(text, i, pieces, runs, brackets, definitions, unclosed)
        else:
            bare = BARE.match(text, i) if char in "hfwHFW" and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")) else None
            if bare:
                i = bare.end()
            else:
                plain = PLAIN.match(text, i + 1)
                end = plain.end() if plain else i + 1
                pieces.append(text[i:end])
                i = end
    _pair(runs, 0)
    for run in every_run:
        pieces[run.at] = run.char * run.left
    return "".join(pieces).replace("\n", "").strip()


def _close_bracket(text: str, i: int, pieces: list[str], runs: list[_Run], brackets: list[list], definitions, unclosed: dict[str, bool]) -> int:
    """Take a closing bracket: as the end of a link or image if it is one, else as text. Returns the place after it."""
    if not brackets:
        pieces.append("]")
        return i + 1
    piece, since, start, image, active = brackets.pop()
    end = -1
    if active:
        end = _link_end(text, i + 1, unclosed) if text.startswith("(", i + 1) else -1
        if end < 0 and definitions:
            label = LABEL.match(text, i + 1)
            name = label[1] if label and label[1].strip() else text[start:i] if i - start < 1000 else ""
            if name and label_key(name) in definitions:
                end = label.end() if label else i + 1
    if end < 0:
        pieces.append("]")
        return i + 1
    pieces[piece] = ""
    _pair(runs, since)
    if not image:  # links hold no links
        for bracket in reversed(brackets):
            if not bracket[3]:
                if not bracket[4]:
                    break
                bracket[4] = False
    return end

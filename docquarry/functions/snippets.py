"""Highlighted extract of a matching text, applied to result rows only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.analysis import PLAIN_WORD, WORD, english_term

WIDTH = 200  # code points
START, STOP, MORE = "<mark>", "</mark>", "…"


def extract(text: str, terms: set[str], analyzer: str = "en") -> str:
    """The window that shows most distinct matching terms, marked; the whole text when none occurs."""
    if analyzer == "en":
        spans = [(m.start(), m.end(), english_term(m.group())) for m in WORD.finditer(text)]
    else:
        spans = [(m.start(), m.end(), m.group().lower()) for m in PLAIN_WORD.finditer(text)]
    spans = [span for span in spans if span[2] in terms]
    if not spans:
        return text
    best, begin, right, inside = 0, 0, 0, {}
    for left, (start, _, term) in enumerate(spans):
        while right < len(spans) and (spans[right][1] <= start + WIDTH or right == left):
            inside[spans[right][2]] = inside.get(spans[right][2], 0) + 1
            right += 1
        distinct = sum(count > 0 for count in inside.values())
        if distinct > best:
            best, begin = distinct, start
        inside[term] -= 1
    shown = [s for s in spans if begin <= s[0] and (s[1] <= begin + WIDTH or s[0] == begin)]
    length = max(WIDTH, shown[-1][1] - begin)
    slack = length - (shown[-1][1] - begin)
    first = max(0, min(begin - slack // 2, len(text) - length))
    last = min(len(text), first + length)
    out, at = [], first
    for start, stop, _ in (s for s in spans if first <= s[0] and s[1] <= last):
        out += [text[at:start], START, text[start:stop], STOP]
        at = stop
    out.append(text[at:last])
    return (MORE if first else "") + "".join(out) + (MORE if last < len(text) else "")


def _extracts(texts: pa.Array, terms: pa.Array, analyzer: str) -> pa.Array:
    pairs = zip(texts.to_pylist(), terms.to_pylist())
    return pa.array([extract(text or "", set(wanted or ()), analyzer) for text, wanted in pairs], pa.string())


def _english(texts: pa.Array, terms: pa.Array) -> pa.Array:
    return _extracts(texts, terms, "en")


def _plain(texts: pa.Array, terms: pa.Array) -> pa.Array:
    return _extracts(texts, terms, "plain")


def snippet(text: Column, terms: Column, analyzer: str) -> Column:
    return F.arrow_udf(_english if analyzer == "en" else _plain, T.StringType())(text, terms)

"""Blocks and inline text of awkward Markdown; no text is slow for its size."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.functions.analysis import _deletion_hashes
from docquarry.functions.inline import inline_text
from docquarry.functions.markdown import scan
from docquarry.functions.outline import blocks_of, outline
from docquarry.operators import search as srch
from docquarry.operators.index import build_index
from tests.test_search import chunks_of


def kinds(text):
    return [(b.kind, b.first, b.last) for b in scan(text.split("\n")).blocks]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("```\n# no\n\n```\n~~~~\n~~~\nopen", [("fence", 0, 3), ("fence", 4, 6)]),
        ("- a\n- b\n\n  more\n\n\ntext", [("list", 0, 3), ("paragraph", 6, 6)]),
        ("- a\n\n1. b\n2) c\n* d\n* * *\n+ e", [("list", 0, 0), ("list", 2, 2), ("list", 3, 3), ("list", 4, 4), ("rule", 5, 5), ("list", 6, 6)]),
        ("text\n2. not a list\n- but this", [("paragraph", 0, 1), ("list", 2, 2)]),
        ("- a\n  ```\n  x\n\n  y\n  ```\nb", [("list", 0, 5), ("paragraph", 6, 6)]),
        ("> a\nlazy\n\n> b\n>\n> c\n# d", [("quote", 0, 1), ("quote", 3, 5), ("heading", 6, 6)]),
        ("> ```\ntext", [("quote", 0, 0), ("paragraph", 1, 1)]),
        ("> - a\n>   b\nlazy\n>\n>c", [("quote", 0, 4)]),
        ("<!-- a\n\nb -->\n<div>\nx\n\ny", [("html", 0, 2), ("html", 3, 4), ("paragraph", 6, 6)]),
        ("<b>x</b> y\n<b>\n", [("paragraph", 0, 1)]),
        ("intro\n|a|b|\n|-|-|\n|1|2|\n\n|a|\n|-|-|", [("paragraph", 0, 0), ("table", 1, 3), ("paragraph", 5, 6)]),
        ("a\nb\n===\nc\n---\n---\n", [("heading", 0, 2), ("heading", 3, 4), ("rule", 5, 5)]),
        ("    code\n\n    more\n\ntext\n    lazy", [("code", 0, 2), ("paragraph", 4, 5)]),
        ("\tcode\n-\ttab\n\n\tsame item", [("code", 0, 0), ("list", 1, 3)]),
        ("[a]: http://x 'y'\n[b]: z\ntext [a]", [("paragraph", 2, 2)]),
        ("[a]: http://x\n===", [("paragraph", 1, 1)]),
        ("-\n\n  no\n\n-\n  yes", [("list", 0, 0), ("paragraph", 2, 2), ("list", 4, 5)]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_blocks(text, expected):
    assert kinds(text) == expected


@pytest.mark.parametrize(
    ("text", "title", "summary"),
    [
        ("- # In a list\n\nText.", "In a list", "Text."),
        ("- tight\n- list\n\n> quoted", "", "quoted"),
        ("- loose\n\n- list", "", "loose"),
        ("- a\n  - b\n\n    c\n\nd", "", "b"),
        ("> > # Deep\n> > text", "Deep", "text"),
        ("#\n# Second", "", ""),
        ("Title\n===\n[x][y]\n\n[y]: z", "Title", "x"),
    ],
)
def test_title_and_summary(text, title, summary):
    found = scan(text.split("\n"))
    assert (found.title, found.summary) == (title, summary)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Hello [x][y]", "Hello x"),
        ("[Y] [y][] [no] [no][z] ![y]", "Y y [no] [no][z] y"),
        ("*a **b** c* __d__ ~~e~~ ***f*** a*b*c a_b_c", "a b c d e f abc a_b_c"),
        ("*open **both* end**", "open both end"),
        ("*open **both* end", "*open *both end"),
        ("**a b *c", "**a b *c"),
        ("2 * 3 * 4, snake_case_name", "2 * 3 * 4, snake_case_name"),
        (r"\*not\* `*code*` `` `x` `` `open", r"\*not\* *code* `x` `open"),
        ("[a *b](c) d*", "a *b d*"),
        ("[a [b](c) d](e)", "[a b d](e)"),
        ("![a [b](c) d](e)", "a b d"),
        ("[a](<b c> 'd') [e](f \"g\") [h](i j) [k](l(m)n)", "a e [h](i j) k"),
        ("<b>x</b> <http://a> http://b.c/d www.e.f <!-- g --> 1 < 2", "x     1 < 2"),
        ("two\nlines", "twolines"),
    ],
)
def test_inline(text, expected):
    assert inline_text(text, {"y"}) == expected


LONG = {
    "quotes": ">" * 100_000 + " x", "items": "- " * 20_000 + "x", "quoted lines": "\n".join(["> " * 200 + "x"] * 200),
    "stars": "*a " * 333_000, "nested": "*a _b " * 80_000 + "_ * " * 80_000, "pairs": "a**b*c_d__e~~f~" * 30_000, "open": "[" * 300_000, "links": "[a](b " * 80_000,
    "comments": "<!-- " * 100_000, "ticks": "".join("`" * (i % 300 + 1) + "a" for i in range(3000)), "references": "[x][y]" * 80_000,
}


@pytest.mark.parametrize("name", LONG)
def test_no_text_is_slow_for_its_size(name):
    start = time.perf_counter()
    assert outline("# T\n\n" + LONG[name])["name"] == "T"
    assert time.perf_counter() - start < 20  # a second or two; the former parser took minutes, or failed


def test_blocks_column(spark):
    df = spark.createDataFrame([("# A\n\nb\nc\n",), (None,), ("",)], "t string")
    got = [[tuple(b) for b in r.b] for r in df.select(blocks_of(F.col("t")).alias("b")).collect()]
    assert got == [[("heading", 1, 1, 1, "A"), ("paragraph", 3, 4, 0, "")], [], []]


def test_deletion_hashes():
    words = ["stone", "ston", "stine", "sstone", "stonee", "tone", "other", "", "é", "日本語", "日語"]
    sets = [set(x) for x in _deletion_hashes(pa.array([*words, None])).to_pylist()]
    assert len(sets[0]) == 6 and len(sets[7]) == 1
    near = {(a, b) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and sets[i] & sets[j]}
    assert near >= {("stone", w) for w in ("ston", "stine", "sstone", "stonee", "tone")} | {("", "é"), ("日本語", "日語")}
    assert not any("other" in pair for pair in near)


def test_one_edit(spark):
    pairs = [("a" * 600, "a" * 600, 0), ("a" * 600, "a" * 599, 1), ("a" * 300 + "b" + "a" * 300, "a" * 601, 1), ("xy" * 400, "xy" * 400 + "é", 1)]
    pairs += [("xy" * 400, "yx" * 400, -1), ("a" * 600 + "bc", "a" * 600 + "cb", -1), ("stone", "ston", 1), ("stone", "stine", 1), ("a", "bc", -1)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert all(r.d == r.x == r.y for r in df.select("d", srch.one_edit(F.col("a"), F.col("b")).alias("x"), srch.one_edit(F.col("b"), F.col("a")).alias("y")).collect())


def test_a_word_of_two_hundred_thousand_letters(spark):
    word = "ab" * 100_000
    index = build_index(chunks_of(spark, {"a": f"# T\n\n{word}\n", "b": "# U\n\nshort\n"}), "plain", buckets=2)
    assert [r.chunk_id for r in srch.search(index, word[:-1]).collect()] == ["doc://a#t"]

"""Text analysis: words to index terms, as Arrow UDFs.

A slice of a batch is split into whitespace-separated words and dictionary-encoded with Arrow, so the
Python code below sees each distinct word of a slice once, whatever its frequency.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docquarry.functions.batches import in_slices, slices_of
from docquarry.functions.stemming import stem

# The English stop words of the Snowball project, in their published order.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing would should could ought i'm you're he's she's
    it's we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll
    they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't
    can't cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's a an the and
    but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too very
    """.split()
)

# Words after the default Unicode boundaries: ideographs stand alone, an apostrophe, full stop or
# colon joins letters, and an apostrophe, full stop, comma or semicolon joins digits.
WORD = regex.compile(
    r"""(?V1)[\p{Han}\p{Hiragana}]
    |[[\p{L}\p{M}\p{N}_]--[\p{Han}\p{Hiragana}]]+
     (?:(?:(?<=[\p{L}\p{M}])['’‘.:·](?=\p{L})|(?<=\p{N})['’‘.,;](?=\p{N}))
        [[\p{L}\p{M}\p{N}_]--[\p{Han}\p{Hiragana}]]+)*""",
    regex.VERBOSE,
)
# A word of Latin letters and digits inside ASCII punctuation: the common case, decided without the pattern above.
LATIN = re.compile(r"[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
# The same in lower and upper case of one byte, which Arrow and Python lower alike.
LATIN_1 = r"^[A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{fe}]+$"
PUNCTUATION = string.punctuation.replace("_", "")
PLAIN_WORD = regex.compile(r"[\p{L}\p{N}]+")
POSSESSIVE = ("'s", "’s", "＇s", "'S", "’S", "＇S")


@lru_cache(maxsize=1 << 17)
def english_term(word: str) -> str | None:
    """Index term of one word, or None for a stop word."""
    if word.endswith(POSSESSIVE):
        word = word[:-2]
    word = word.lower()
    return None if word in STOP_WORDS or not word else stem(word)


@lru_cache(maxsize=1 << 17)
def english_terms(piece: str) -> tuple[str, ...]:
    bare = piece.strip(PUNCTUATION)
    words = (bare,) if LATIN.fullmatch(bare) else (match.group() for match in WORD.finditer(piece))
    return tuple(term for term in map(english_term, words) if term is not None)


@lru_cache(maxsize=1 << 17)
def plain_terms(piece: str) -> tuple[str, ...]:
    """Lower-cased runs of letters and digits; no stop words, no stemming."""
    bare = piece.strip(string.punctuation).lower()
    return (bare,) if LATIN.fullmatch(bare) else tuple(PLAIN_WORD.findall(piece.lower()))


TERM_COUNTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField("tf", T.IntegerType()),
            T.StructField("total", T.IntegerType()),
        ]
    )
)
RUN_BYTES, RUN_ROWS, RUN_BATCH = 1 << 25, 1 << 21, 1 << 15  # text and counted terms that a task puts in order at once, and terms that it hands on at once
_TERM_STRUCT = [pa.field("term", pa.string()), pa.field("tf", pa.int32()), pa.field("total", pa.int32())]


def _terms_of_pieces(pieces: pa.Array, terms_of) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of distinct pieces of text, and for each piece the place of its first one and their number. Plain Latin words need no Python."""
    if terms_of is not plain_terms:
        made = [terms_of(piece) for piece in pieces.to_pylist()]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return pa.array([t for terms in made for t in terms], pa.string()), np.cumsum(sizes) - sizes, sizes
    bare = pc.ascii_trim(pieces, string.punctuation)
    plain = np.asarray(pc.match_substring_regex(bare, LATIN_1))
    made = [plain_terms(piece) for piece in pieces.filter(pa.array(~plain)).to_pylist()]
    words = pc.utf8_lower(bare.filter(pa.array(plain))).cast(pa.string())
    sizes, starts = np.ones(len(pieces), np.int64), np.cumsum(plain) - 1
    other = np.fromiter(map(len, made), np.int64, len(made))
    sizes[~plain], starts[~plain] = other, len(words) + np.cumsum(other) - other
    return pa.concat_arrays([words, pa.array([t for terms in made for t in terms], pa.string())]), starts, sizes


def _counted(texts: pa.Array, terms_of, by_term: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, and numbers of a row and of a term in it with the term's frequency and the row's total, by rows or else by terms."""
    words = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.asarray(words.offsets)
    encoded = words.flatten().dictionary_encode()
    codes = np.asarray(encoded.indices)
    found, starts, sizes = _terms_of_pieces(encoded.dictionary, terms_of)
    vocabulary = found.dictionary_encode()

    row_of_word = np.repeat(np.arange(len(texts)), np.diff(offsets))
    repeat = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    first = np.repeat(starts[codes] if len(codes) else repeat, repeat)
    within = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    ids = np.asarray(vocabulary.indices).astype(np.int64)[first + within] if len(found) else np.zeros(0, np.int64)

    rows = np.repeat(row_of_word, repeat)
    totals = np.bincount(rows, minlength=len(texts))
    outer, inner, width = (ids, rows, len(texts)) if by_term else (rows, ids, len(vocabulary.dictionary))
    keys, tf = np.unique(outer * max(width, 1) + inner, return_counts=True)
    outer, inner = keys // max(width, 1), keys % max(width, 1)
    row, term = (inner, outer) if by_term else (outer, inner)
    return vocabulary.dictionary, row, term, tf.astype(np.int32), totals[row].astype(np.int32)


def count_terms(texts: pa.Array, terms_of) -> pa.Array:
    """Distinct terms of every text of a batch, with their frequency and the text's total."""
    terms, row, term, tf, totals = _counted(texts, terms_of)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    columns = [terms.take(pa.array(term)), pa.array(tf), pa.array(totals)]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, fields=_TERM_STRUCT))


class _Run:
    """Counted terms of some texts, kept as numbers until they are put in the order of terms."""

    def __init__(self):
        self.keys, self.terms, self.held = [], [], []
        self.size = self.texts = self.distinct = self.octets = 0

    def add(self, keys: pa.RecordBatch, texts: pa.Array, terms_of) -> None:
        terms, row, term, tf, total = _counted(texts, terms_of, True)
        self.held.append((row + self.texts, term + self.distinct, tf, total))
        self.keys.append(keys)
        self.terms.append(terms)
        self.size, self.texts, self.distinct = self.size + len(row), self.texts + len(texts), self.distinct + len(terms)
        self.octets += pc.sum(pc.binary_length(texts)).as_py() or 0

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each term of a text, by terms (their bytes), and then in the order of the texts."""
        if not self.size:
            return
        encoded = pa.concat_arrays(self.terms).dictionary_encode()
        in_order = pc.sort_indices(encoded.dictionary)
        rank = np.empty(len(in_order), np.int64)
        rank[np.asarray(in_order)] = np.arange(len(in_order))
        terms = encoded.dictionary.take(in_order)
        row, term, tf, total = (np.concatenate(c) for c in zip(*self.held))
        term = rank[np.asarray(encoded.indices)[term]]
        order = np.argsort(term * self.texts + row)
        keys = pa.Table.from_batches(self.keys).combine_chunks()
        for a in range(0, len(order), RUN_BATCH):
            at = order[a : a + RUN_BATCH]
            of = keys.take(pa.array(row[at]))
            columns = [*of.columns, terms.take(pa.array(term[at])), pa.array(tf[at]), pa.array(total[at])]
            yield pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()[0]


def _term_runs(analyzer: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = _Run()
    for batch in batches:
        keys, texts = batch.select(batch.schema.names[:-1]), batch.column(batch.num_columns - 1)
        for a, b in slices_of(texts):
            run.add(keys.slice(a, b - a), texts.slice(a, b - a), _TERMS_OF[analyzer])
            if run.size > RUN_ROWS or run.octets > RUN_BYTES:
                yield from run.rows(schema)
                run = _Run()
    yield from run.rows(schema)


def counted_by_term(rows: DataFrame, analyzer: str = "en") -> DataFrame:
    """For every term of the texts in the last column: the other columns, term, tf and total. Narrow: counted inside each text.

    A task gives its rows by term, and those of a term in the order of its input; after ``RUN_ROWS`` rows or ``RUN_BYTES`` of text it begins anew. Sorting them by term takes a
    sorter that knows runs one comparison a row, not twenty.
    """
    schema = T.StructType([*rows.schema.fields[:-1], *TERM_COUNTS.elementType.fields])
    return rows.mapInArrow(partial(_term_runs, analyzer, to_arrow_schema(schema)), schema)


_TERMS_OF = {"en": english_terms, "plain": plain_terms}


def _english_counts(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda part: count_terms(part, english_terms))


def _plain_counts(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda part: count_terms(part, plain_terms))


def term_counts(text: Column, analyzer: str = "en") -> Column:
    """Array of (term, tf, total). Kept from being copied into filters, where it would run again."""
    return F.arrow_udf({"en": _english_counts, "plain": _plain_counts}[analyzer], TERM_COUNTS).asNondeterministic()(text)


# Polynomial hashes over code points, modulo 2^64; the base is odd, so it has an inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, base))))


def _deletion_hashes(terms: pa.Array) -> pa.Array:
    """For each term the hashes of itself and of what is left without any one character, in one pass over the letters."""
    words = [w or "" for w in terms.to_pylist()]
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = _powers(BASE, len(codes)), _powers(UNBASE, len(codes))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[: len(codes)])))
    whole = (sums[ends] - sums[starts]) * down[starts]
    home = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes))
    cut = ((sums[place] - sums[starts[home]]) + (sums[ends[home]] - sums[place + 1]) * UNBASE) * down[starts[home]]
    out = np.empty(len(codes) + len(words), np.uint64)
    firsts = starts + np.arange(len(words))
    out[firsts] = whole
    out[place + home + 1] = cut
    bounds = np.append(firsts, len(out)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.view(np.int64)))


def deletions(df: DataFrame, term: str, number: str) -> DataFrame:
    """``number`` (a hash that stands for the term) and ``variant``: a hash of the term, and of the term without each single character.

    Two terms within one insertion, deletion or substitution always share a variant, which turns
    the distance test into an equi-join plus a check. Rows hold two numbers, so a term of a million letters costs megabytes, not their square.
    """
    variants = F.arrow_udf(_deletion_hashes, T.ArrayType(T.LongType())).asNondeterministic()(F.col(term))
    numbered = df.select(F.xxhash64(term).alias(number), variants.alias("variants"))  # so that the term itself is not repeated
    return numbered.select(number, F.explode("variants").alias("variant"))

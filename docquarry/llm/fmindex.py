"""Removal of repeated word sequences by compressed FM-indexes, one per shard.

Texts are cut into segments by anchors (anchors.py), so that a shard holds every place where one of its windows may stand. A shard's
segments are indexed: words become numbers, the suffixes are ranked, and the Burrows-Wheeler column is kept as a wavelet
matrix of packed bits with counts per machine word. The segments' windows stream through it by backward search: an
interval of equal suffixes is narrowed word by word from the right, for all windows at once; a window whose interval still holds
two or more occurrences at full length is repeated. The last words of a window start from a table of intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import anchors, identity
from docquarry.llm.common import ragged, whole_text

#: Words of a repeated window and of an anchor; words that the interval table covers (a power of two).
LENGTH, GRAM, SEED = 35, 8, 16
#: The column of a document's own number, where keys do not tell documents apart.
OWN = "_document_number"
#: Bytes of segments (eight a word) that one index holds.
SHARD_BYTES = 8_000_000


class Wavelet:
    """A sequence of numbers as one packed bit vector per level; counts how often a number stands before a place."""

    def __init__(self, values: np.ndarray, kinds: int):
        self.levels, self.size = [], len(values)
        for level in range(max(int(kinds - 1).bit_length(), 1) - 1, -1, -1):
            bits = (values >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:], dtype=np.int32)
            zeros = len(bits) - int(bits.sum())
            self.levels.append((level, words, before, zeros))
            values = np.concatenate((values[~bits], values[bits]))
        self.start = np.zeros(kinds, np.int64)
        self.start = self._down(np.arange(kinds), np.zeros(kinds, np.int64))

    def _down(self, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            block = place >> 6
            ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where(kind >> level & 1, zeros + ones, place - ones)
        return place

    def rank(self, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(kind, place) - self.start[kind]


class Index:
    """Over numbered words, 0 for the end of a segment. ``weight``: how many occurrences each place stands for."""

    def __init__(self, values: np.ndarray, kinds: int, weight: np.ndarray, depth: int):
        rank, span, self.seeds = values.astype(np.int64), 1, None
        while span < depth:
            if span == SEED:
                self.seeds = rank, np.concatenate(([0], np.cumsum(np.bincount(rank))))
            shifted = np.zeros(len(rank), np.int64)
            shifted[:-span] = rank[span:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + shifted, return_inverse=True)[1]
            span *= 2
        order = np.argsort(rank, kind="stable")
        self.column = Wavelet(values[order - 1], kinds)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=kinds))))
        self.weights = np.concatenate(([0], np.cumsum(weight[order])))
        self.values = values

    def repeated(self, windows: np.ndarray, length: int) -> np.ndarray:
        """Which windows (their first places) occur at least twice."""
        rank, table = self.seeds
        seed = rank[windows + length - SEED]
        low, high = table[seed], table[seed + 1]
        alive = np.arange(len(windows))
        for k in range(length - SEED - 1, -1, -1):
            several = self.weights[high] - self.weights[low] > 1
            alive, low, high = alive[several], low[several], high[several]
            if not len(alive):
                break
            word = self.values[windows[alive] + k]
            low, high = self.first[word] + self.column.rank(word, low), self.first[word] + self.column.rank(word, high)
        several = self.weights[high] - self.weights[low] > 1
        out = np.zeros(len(windows), bool)
        out[alive[several]] = True
        return out


def repeated_windows(part: pa.Table, length: int = LENGTH):
    """Spans of the shard's segments whose windows occur more than once."""
    data, offsets = anchors.buffers(part["d"].chunk(0))
    words = np.frombuffer(data.tobytes(), np.uint64)
    begins = offsets[:-1] // 8
    lengths = (offsets[1:] - offsets[:-1]) // 8
    windows = part["n"].to_numpy().astype(np.int64)
    kinds, numbered = np.unique(words, return_inverse=True)
    starts = begins + np.arange(len(begins))  # an end mark follows every segment
    values = np.zeros(len(words) + len(begins), np.int64)
    values[ragged(starts, lengths)] = numbered + 1
    weight = np.ones(len(values), np.int64)
    weight[ragged(starts, lengths)] = np.repeat(part["c"].to_numpy(), lengths)
    index = Index(values, len(kinds) + 1, weight, length)
    places = ragged(starts, windows)
    segment = np.repeat(np.arange(len(starts)), windows)
    doc, a = part["doc"].to_numpy(), part["a"].to_numpy()
    return anchors.runs(index.repeated(places, length), segment, doc[segment], a[segment] + places - starts[segment], length)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, text (binary, the words left, joined by one space), n_words and n_removed of every row.

    Removed is each word covered by ``length`` words whose sequence also starts anywhere else, in the same document too. Null texts
    count as empty. Rows that repeat a document (key and text) count as one document and all get its result; different texts of one key are
    different documents. Rows without a key take no part and keep their words. Shorter texts, and empty tables, lose nothing. Other columns are not carried along.
    """
    shared = None if key == OWN else identity.numbers(docs, key, text)
    if shared is not None:  # documents of one key are kept apart
        left = deduplicated(identity.with_number(docs.select(key, text), shared, key, text, OWN), OWN, text, length)
        named = left.join(shared.select(F.col("number").alias(OWN), F.col("doc").cast(docs.schema[key].dataType).alias(key)), OWN, "left")
        return named.select(key, "text", "n_words", "n_removed")
    cut = anchors.Cut("words", length, GRAM)
    held = docs.select(F.col(key).cast("long").alias("doc"), whole_text(text).cast("binary").alias("text"))
    taking = held.where(F.col("doc").isNotNull())
    found = anchors.repeated(taking, cut, "fmindex")
    dealt = anchors.spread(taking)
    spans = anchors.by_shard(anchors.fetched(dealt, found.firsts, cut), lambda part: repeated_windows(part, length), SHARD_BYTES)
    marked = anchors.with_spans(dealt, spans, found.others, cut, held.where(F.col("doc").isNull()))

    def run(batches):
        for batch in batches:
            rows = [_left(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2))]
            left, count, removed = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())], names=["doc", "text", "n_words", "n_removed"])

    out = marked.mapInArrow(run, "doc long, text binary, n_words long, n_removed long")
    return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "text", "n_words", "n_removed")


def _left(text: bytes, spans: pa.ListScalar) -> tuple[bytes, int, int]:
    words = text.split()
    if not spans.is_valid:
        return b" ".join(words), len(words), 0
    found = anchors.merged(np.stack([np.asarray(spans.values.field(k)) for k in range(2)], axis=1))
    cuts = [0, *found.ravel().tolist(), len(words)]
    kept = [w for a, b in zip(cuts[::2], cuts[1::2]) for w in words[a:b]]
    return b" ".join(kept), len(words), len(words) - len(kept)

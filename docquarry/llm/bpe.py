"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task's distinct words stand one after the other in one array of symbols. An inverted index maps each mergeable pair, named by
the rank of the token it makes, to the positions where it stands. Ranks are taken in rising order; one step merges every position
of a pair in all words at once, looks at the two touched neighbours of each merge only, and files the pairs that came up.
Words are independent, so this is what merging each word by itself, lowest rank first, would give.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import binary, slices, whole_text
from docquarry.llm.tokens import Pieces, ranks_of

NEVER = np.iinfo(np.int32).max
#: Bytes of text whose distinct words are replayed together; this bounds a task's memory.
BLOCK_BYTES = 6_000_000

Work = Callable[[list], list[bytes]]


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[x] for x in self.keys.tolist()], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, or NEVER."""
        wanted = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.made[place], NEVER)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol, size = self.single[data], len(data)
        if not size:
            return symbol, lengths
        ends = np.cumsum(lengths)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        word = np.repeat(np.arange(len(words)), lengths)
        pair = np.full(size, NEVER, np.int32)
        first = np.flatnonzero(after >= 0)
        pair[first] = self.rank(symbol[first], symbol[after[first]])
        index, queue = {}, []

        def file(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts, cuts[1:]):
                r = int(ranks[a])
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(queue, r)

        known = first[pair[first] != NEVER]
        if len(known):
            file(known, pair[known])
        unclear: set[int] = set()
        while queue:
            r = heapq.heappop(queue)
            held = index.pop(r)
            places = held[0] if len(held) == 1 else np.concatenate(held)
            places = places[pair[places] == r]
            if len(places) > 1:
                places = np.unique(places)
                places = _apart(places, after)
            if not len(places):
                continue
            second = after[places]
            third = after[second]
            symbol[places], symbol[second] = r, -1
            pair[second] = NEVER
            after[places] = third
            inside = third >= 0
            before[third[inside]] = places[inside]
            left = before[places]
            touched = np.concatenate((places, left[left >= 0]))
            following = after[touched]
            has = following >= 0
            ranks = np.full(len(touched), NEVER, np.int32)
            ranks[has] = self.rank(symbol[touched[has]], symbol[following[has]])
            pair[touched] = ranks
            new = ranks != NEVER
            if new.any():
                if (ranks[new] < r).any():  # a lower rank came up late: other pairs of that word may have been merged too early
                    unclear.update(word[touched[ranks < r]].tolist())
                file(touched[new], ranks[new])
        alive = symbol >= 0
        counts = np.bincount(word[alive], minlength=len(words))
        ids = symbol[alive].astype("<u4")
        return self._mended(words, ids, counts, unclear) if unclear else (ids, counts)

    def _mended(self, words, ids, counts, unclear):
        cut = np.split(ids, np.cumsum(counts)[:-1])
        for i in unclear:
            cut[i] = np.array(self.one(words[i]), "<u4")
        return np.concatenate(cut), np.fromiter(map(len, cut), np.int64, len(cut))

    def one(self, word: bytes) -> list[int]:
        """A single word, lowest rank first, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs that share a symbol (as in aaa) every other one, from the left."""
    chained = np.concatenate(([False], after[places[:-1]] == places[1:]))
    if not chained.any():
        return places
    number = np.arange(len(places))
    return places[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]


@lru_cache(maxsize=2)
def _encoder(definition: bytes, pattern: str) -> Work:
    replay, cut = MergeReplay(ranks_of(definition)), regex.compile(pattern)

    def encode(texts: list[str]) -> list[bytes]:
        places: dict[str, int] = {}
        found = [array("I", (places.setdefault(x[0], len(places)) for x in cut.finditer(text))) for text in texts]
        ids, counts = replay.encode([x.encode() for x in places])
        ends = np.cumsum(counts) * 4
        data, ends = ids.tobytes(), ends.tolist()
        begins = [0, *ends[:-1]]
        return [data[begins[x[0]] : ends[x[0]]] if len(x) == 1 else b"".join(data[begins[i] : ends[i]] for i in x) for x in found]

    return Pieces(encode).ids


@lru_cache(maxsize=2)
def _decoder(definition: bytes) -> Work:
    """Needs the tokens alone, not the pairs that make them."""
    ranks = ranks_of(definition)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return lambda values: [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in values]


def encode(docs: DataFrame, definition: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their ids: little-endian unsigned 32-bit numbers, as binary.

    ``definition`` is the content of the vocabulary's file. A null or empty text has no ids (empty binary, not null); special
    strings are ordinary text; repeated rows are rows like others; an empty table stays empty; a column named
    like the result is replaced. Nothing is shuffled.
    """
    return _mapped(docs, definition, whole_text(text), ids, lambda given: _encoder(given, pattern))


def decode(rows: DataFrame, definition: bytes, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids; null ids give empty bytes. Bytes, since ids may end inside a character.

    ``pattern`` is taken for symmetry with ``encode``; the ids alone decide.
    """
    return _mapped(rows, definition, F.coalesce(F.col(ids), F.lit(b"")), decoded, _decoder)


def _mapped(rows, definition, value, name, worker):
    shared = rows.sparkSession.sparkContext.broadcast(definition)  # the file of a public vocabulary: under 2 MB, whatever the data
    held = rows.drop(name).withColumn("_bpe_in", value)
    schema = T.StructType([*held.drop("_bpe_in").schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        work = worker(shared.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0, int)
            for a, b in slices(sizes, BLOCK_BYTES):
                part = batch.slice(a, b - a)
                out = work(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], binary(out)], names=[*part.schema.names[:-1], name])

    return held.mapInArrow(run, schema)

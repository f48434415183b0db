"""Order-preserving packing of documents into token sequences by dynamic programming.

Documents, in the order of their ids, form one stream of tokens; windows of at most ``size`` tokens are cut from it. The cuts
minimise padding plus penalties for truncation: a cut between documents is free, one at the end of a sentence
costs little, one elsewhere (allowed only in passages without any sentence end) costs more. A window of full size or of
a power of two is not padded. With cost(j) = penalty(j) + min over i of cost(i) + size - (p(j) - p(i)), the minimum runs over a
sliding window and is kept by a monotone queue; the few power-of-two transitions are looked up beside it.

Each task packs one range of document ids, streaming: it commits windows when some hundred are decided and keeps only the open end.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import parts_for, slices, whole_text
from docquarry.llm.tokens import shared_pieces

#: Penalties in tokens of padding.
SENTENCE, INSIDE = 2, 32
#: In a passage without sentence ends, of a quarter sequence or more, a cut is allowed at every sixteenth of a sequence.
STRIDES = 16
#: Tokens after which windows are committed, and windows at the open end that are decided again.
HORIZON, OPEN = 262_144, 16
ENDINGS = (b".", b"!", b"?", "…".encode(), "。".encode(), "！".encode(), "？".encode())


def cost_cuts(places: list[int], penalties: list[int], size: int) -> tuple[list[float], list[int]]:
    """The least cost of ending a window at each place, and the place where that window starts; the first place is the start."""
    cost, back = [0.0], [-1]
    queue = deque([(places[0], 0)])  # rising cost(i) + p(i), for i still within reach
    at = {places[0]: 0}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    first = 0
    for j in range(1, len(places)):
        p = places[j]
        while p - places[first] > size:
            if queue and queue[0][1] == first:
                queue.popleft()
            at.pop(places[first])
            first += 1
        low, i = queue[0]
        best = low + size - p
        for power in powers:
            other = at.get(p - power)
            if other is not None and cost[other] < best:
                best, i = cost[other], other
        best += penalties[j]
        cost.append(best)
        back.append(i)
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
        at[p] = j
    return cost, back


class Packer:
    """Takes documents one by one and gives pieces (document, start, ids, tokens of the document, sequence, offset)."""

    def __init__(self, size: int, ends_sentence: np.ndarray, number: int):
        self.size, self.ends, self.sequence, self.stride = size, ends_sentence, number, max(1, size // STRIDES)
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # key, ids that are not yet packed, place in the stream, ids before them
        self.places, self.penalties, self.total = [0], [0], 0

    def add(self, key, ids: np.ndarray) -> None:
        inner = np.flatnonzero(self.ends[ids[:-1]]) + 1  # the last id ends the document
        marks = np.concatenate(([0], inner, [len(ids)]))
        wide = np.flatnonzero(np.diff(marks) > self.stride * 4)
        extra = [np.arange(marks[w] + self.stride, marks[w + 1] - self.stride // 2, self.stride) for w in wide.tolist()]
        cuts, costs = np.concatenate((inner, *extra)), np.concatenate((np.full(len(inner), SENTENCE), *(np.full(len(x), INSIDE) for x in extra)))
        order = np.argsort(cuts, kind="stable")
        self.docs.append((key, ids, self.total, 0))
        self.places += (cuts[order] + self.total).tolist()
        self.penalties += costs[order].tolist()
        self.total += len(ids)
        self.places.append(self.total)
        self.penalties.append(0)

    def pieces(self, last: bool):
        """What is decided; with ``last`` everything."""
        if len(self.places) < 2:
            return
        _, back = cost_cuts(self.places, self.penalties, self.size)
        path = [len(self.places) - 1]
        while path[-1]:
            path.append(back[path[-1]])
        path = path[::-1] if last else path[: OPEN - 1 : -1]  # the open end stays; the path starts at place 0
        if len(path) < 2:
            return
        at = 0
        for a, b in zip(path, path[1:]):
            start, end, offset = self.places[a], self.places[b], 0
            while start < end:
                key, ids, place, before = self.docs[at]
                stop = min(end, place + len(ids))
                yield key, before + start - place, ids[start - place : stop - place], before + len(ids), self.sequence, offset
                offset += stop - start
                start = stop
                if stop == place + len(ids):
                    at += 1
            self.sequence += 1
        until = self.places[path[-1]]
        self.docs = [(k, ids[max(0, until - p) :], max(p, until) - until, b + max(0, until - p)) for k, ids, p, b in self.docs[at:]]
        self.places = [p - until for p in self.places[path[-1] :]]
        self.penalties = self.penalties[path[-1] :]
        self.total -= until


def pack(docs: DataFrame, definition: bytes, pattern: str, size: int = 1024, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the packed documents: key, start, ids (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset.

    Every document ends with the id ``end``, so a null or empty text still has one token. Documents without a key are packed like
    others, before the rest. Repeated rows are packed as often as they stand there; an empty table gives no pieces; other columns are not
    carried along. A document longer than a sequence is cut, at sentence ends where it has any.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a public vocabulary's file, under 2 MB
    columns = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    # The second column parts rows that share a key, should one key hold a large part of them.
    ordered = columns.withColumn("mix", F.xxhash64("text")).repartitionByRange(parts_for(docs), "key", "mix").sortWithinPartitions("key", "mix").drop("mix")
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    names = schema.names

    def run(batches):
        pieces = shared_pieces(shared.value, pattern)
        packer = Packer(size, _sentence_ends(shared.value), TaskContext.get().partitionId() << 40)
        closing = np.array([end], "<u4")

        def out(last: bool):
            rows = list(zip(*packer.pieces(last)))
            if rows:
                rows[2] = [x.tobytes() for x in rows[2]]
                types = [field, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

        field = None
        for batch in batches:
            field = batch.column(0).type
            for a, b in slices(np.asarray(pa.compute.binary_length(batch.column(1))), 4_000_000):
                keys, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                for k, ids in zip(keys, pieces.ids(texts)):
                    packer.add(k, np.concatenate((np.frombuffer(ids, "<u4"), closing)))
                    if packer.total >= HORIZON:
                        yield from out(False)
        if field is not None:
            yield from out(True)

    return ordered.mapInArrow(run, schema)


def _sentence_ends(definition: bytes) -> np.ndarray:
    """By id: does the token end a sentence or hold a line break?"""
    from docquarry.llm.tokens import added_ids, ranks_of

    ranks = ranks_of(definition)
    table = np.zeros(max(*ranks.values(), *added_ids(definition).values()) + 2, bool)
    for token, i in ranks.items():
        table[i] = token.rstrip(b"\"')").endswith(ENDINGS) or b"\n" in token
    return table

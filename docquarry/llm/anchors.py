"""Cuts texts into segments that meet in a shard exactly when they may share a window.

Both substring operators ask which windows of W symbols (bytes or words) stand elsewhere too. Each window names as its anchor the
gram of M symbols with the least hash inside it, leftmost among equals. Equal windows have equal anchors at equal places, so windows
can be dealt out by anchor and none is lost. Neighbouring windows mostly share an anchor; such a run is one segment.

Segments whose anchor stands only once in the corpus cannot hold a repeated window and end here. Of segments with equal content one, the
first, represents all. What operators then index are the first segments, by anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import buffers, parts_for, ragged, slices
from docquarry.operators.sizing import settled

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text, and window starts, that a task handles at once; they bound its memory whatever a document's length.
TEXT_BYTES, STARTS = 4_000_000, 1 << 20
#: An anchor with more first segments than this is crowded: its windows are dealt out singly, by a hash of their content.
CROWDED = 16_000
#: Low bits of a window's minimum that hold the place.
PLACE_BITS = np.uint64(21)


@dataclass(frozen=True)
class Cut:
    """Symbols ("bytes" or "words"), symbols of a window, symbols of an anchor."""

    symbols: str
    window: int
    gram: int


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit (in place)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def upto(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < size:
            cls.up, cls.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base)))) for base in (BASE, UNBASE))
        return cls.up[:size], cls.down[:size]


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = Powers.upto(max(len(values), 1))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for every word of the texts in ``data``, and the texts' offsets in words."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    head[edge] |= inside[edge]
    tail[edge - 1] |= inside[edge - 1]
    begins, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    sums = _sums(BYTES[data])
    _, down = Powers.upto(len(data))
    hashes = mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * UNBASE)
    return hashes, np.searchsorted(begins, offsets)


def symbols(column: pa.Array, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    return (data, offsets) if cut.symbols == "bytes" else words(data, offsets)


def segments_of(values: np.ndarray, offsets: np.ndarray, cut: Cut):
    """Segments of the texts in ``values``: anchor, hash of the content, number of the text, place in it, windows."""
    for start in range(0, max(int(offsets[-1]) - cut.window + 1, 0), STARTS):
        part = values[start : start + STARTS + cut.window - 1]
        coded = BYTES[part] if cut.symbols == "bytes" else part
        sums = _sums(coded)
        _, down = Powers.upto(len(coded) + 1)
        grams = mixed((sums[cut.gram :] - sums[: -cut.gram]) * down[: len(coded) - cut.gram + 1])
        least = ((grams >> PLACE_BITS) << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        span, wide = 1, cut.window - cut.gram + 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        at = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        places = np.arange(start, start + len(at))
        text = np.searchsorted(offsets, places, "right") - 1
        whole = places + cut.window <= offsets[text + 1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        new[1:] |= ~whole[:-1]
        heads = np.flatnonzero(new & whole)
        if not len(heads):
            continue
        stops = np.flatnonzero(np.append(new | ~whole, True))
        lengths = stops[np.searchsorted(stops, heads, "right")] - heads
        raw, size = np.ascontiguousarray(part).tobytes(), part.dtype.itemsize
        ends = ((heads + lengths + cut.window - 1) * size).tolist()
        digest = xxhash.xxh3_64_intdigest
        content = np.fromiter((digest(raw[a:b]) for a, b in zip((heads * size).tolist(), ends)), np.uint64, len(heads))
        yield grams[at[heads]].view(np.int64), content.view(np.int64), text[heads], places[heads] - offsets[text[heads]], lengths


def segments(docs: DataFrame, cut: Cut) -> DataFrame:
    """g (anchor), s (content), doc, a (place), n (windows) of every segment. ``docs``: doc long, not null, and text as binary, not null."""

    def run(batches):
        for batch in batches:
            for i, j in slices(np.asarray(pc.binary_length(batch.column(1))), TEXT_BYTES):
                part = batch.slice(i, j - i)
                values, offsets = symbols(part.column(1), cut)
                keys = part.column(0)
                for g, s, text, a, n in segments_of(values, offsets, cut):
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), keys.take(pa.array(text)), pa.array(a), pa.array(n.astype(np.int32))], names=["g", "s", "doc", "a", "n"])

    return docs.select("doc", "text").mapInArrow(run, "g long, s long, doc long, a long, n int")


@dataclass(frozen=True)
class Repeated:
    """``firsts``: g, s, n, c (how often, 2 for more), doc, a of each content's first segment. ``others``: doc, a, n of all later ones."""

    firsts: DataFrame
    others: DataFrame


def repeated(docs: DataFrame, cut: Cut, label: str) -> Repeated:
    # Counting sums up before it shuffles. As a table of its own it leaves a plain join, in which adaptive execution splits a frequent anchor.
    rows = segments(docs, cut)
    several = settled(rows.select("g").groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), f"{label}-several")
    rows = settled(rows.join(several, "g", "left_semi"), f"{label}-repeated")
    place = F.struct("doc", "a")  # the same in all rows that repeat a document, which so count once
    firsts = rows.groupBy("g", "s").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.first("n").alias("n"))
    firsts = settled(firsts.select("g", "s", "n", F.when(F.col("f") == F.col("l"), 1).otherwise(2).cast("long").alias("c"), "f.doc", "f.a"), f"{label}-firsts")
    known = firsts.where("c > 1").select("g", "s", F.col("doc").alias("d0"), F.col("a").alias("a0"))
    others = rows.join(known, ["g", "s"]).where("doc <> d0 or a <> a0").select("doc", "a", "n")
    return Repeated(firsts, others)


def spread(docs: DataFrame) -> DataFrame:
    """The rows dealt out by document: one exchange that fetching and removing share, as it is the same subplan."""
    return docs.repartition(parts_for(docs), "doc")


def fetched(dealt: DataFrame, firsts: DataFrame, cut: Cut) -> DataFrame:
    """g, doc, a, n, c, h and the symbols (as binary) of every first segment, by anchor and in its order.

    The windows of a crowded anchor are rows of their own (h), with the hash of their content for g: equal ones still meet, and no task gets
    all of the anchor.
    """
    crowded = firsts.groupBy("g").count().where(F.col("count") > CROWDED).select("g", F.lit(True).alias("h"))  # few: each has so many rows
    marked = firsts.join(F.broadcast(crowded), "g", "left").withColumn("h", F.coalesce("h", F.lit(False)))
    wanted = marked.groupBy("doc").agg(F.collect_list(F.struct("g", "a", "n", "c", "h")).alias("w"))  # bounded by a document's length
    both = dealt.join(wanted, "doc", "left")

    def run(batches):
        for batch in batches:
            for i, j in slices(np.asarray(pc.binary_length(batch.column(1))), TEXT_BYTES):
                part = batch.slice(i, j - i)
                part = part.filter(pc.is_valid(part.column("w")))
                if part.num_rows:
                    yield from _payload(part, cut)

    shards = both.mapInArrow(run, "g long, doc long, a long, n int, c long, h boolean, d binary")
    return shards.repartition(parts_for(dealt), "g").sortWithinPartitions("g", "doc", "a")


def _payload(part: pa.RecordBatch, cut: Cut):
    values, offsets = symbols(part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1), cut)
    wanted = part.column("w")
    text = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(wanted)))
    g, a, n, c, h = (np.asarray(pc.struct_field(wanted.flatten(), [k])) for k in range(5))
    yield from _rows(part.column(0), values, offsets, cut, text[~h], g[~h], a[~h], n[~h], c[~h], False)
    heads = np.flatnonzero(h)
    for i, j in slices(n[heads].astype(np.int64) * cut.window, STARTS):
        at = np.repeat(heads[i:j], n[heads[i:j]])
        places = ragged(a[heads[i:j]], n[heads[i:j]].astype(np.int64))
        yield from _rows(part.column(0), values, offsets, cut, text[at], g[at], places, np.ones(len(at), np.int32), c[at], True)


def _rows(keys: pa.Array, values: np.ndarray, offsets: np.ndarray, cut: Cut, text, g, a, n, c, single: bool):
    """Rows of the shards; ``single`` windows are named by their content."""
    begins = offsets[text] + a
    lengths = n.astype(np.int64) + cut.window - 1
    for i, j in slices(lengths, STARTS):
        data = values[ragged(begins[i:j], lengths[i:j])].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths[i:j]))) * values.dtype.itemsize
        content = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
        name = g[i:j]
        if single:
            name = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())), np.uint64, j - i).view(np.int64)
        columns = [pa.array(name), keys.take(pa.array(text[i:j])), *(pa.array(x[i:j]) for x in (a, n, c)), pa.array(np.full(j - i, single)), content]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "doc", "a", "n", "c", "h", "d"])


def by_shard(shards: DataFrame, search, most: int) -> DataFrame:
    """(doc, a, e) spans that ``search`` finds among whole anchors' segments, gathered up to about ``most`` bytes at a time.

    Windows dealt out singly may be more than that and all equal. They are searched in turns of about ``most`` bytes, each
    together with the first window of every content before.
    """

    def run(batches):
        kept: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            kept.append(batch)
            held += batch.nbytes
            if held < most:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            g = table["g"].to_numpy()
            until = int(np.searchsorted(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g) - 1, "right"))
            heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            end = int(heads[until - 1])
            if end:
                yield from spans(table.slice(0, end))
            rest = table.slice(end).combine_chunks()
            if rest.nbytes >= most and rest["h"][0].as_py() and rest["h"][-1].as_py():
                yield from spans(rest)
                codes = rest["d"].combine_chunks().dictionary_encode().indices.to_numpy()
                rest = rest.take(pa.array(np.sort(np.unique(codes, return_index=True)[1]))).combine_chunks()
            kept = rest.to_batches()
            held = sum(x.nbytes for x in kept)
        if kept:
            yield from spans(pa.Table.from_batches(kept).combine_chunks())

    def spans(table):
        same = np.all([x[1:] == x[:-1] for x in (table[c].to_numpy() for c in ("g", "doc", "a"))], axis=0)  # of rows that repeat a document
        if same.any():
            table = table.filter(pa.array(np.append(True, ~same))).combine_chunks()
        g, sizes = table["g"].to_numpy(), np.asarray(pc.binary_length(table["d"]))
        heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        for i, j in slices(np.add.reduceat(sizes.astype(np.int64), heads), most):
            a, b = heads[i], heads[j] if j < len(heads) else len(g)
            part = table.slice(a, b - a).combine_chunks()
            doc, place, end = search(part)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(end)], names=["doc", "a", "e"])

    return shards.mapInArrow(run, "doc long, a long, e long")


def runs(chosen: np.ndarray, first: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int):
    """Spans of symbols covered by chosen windows. Windows stand by segment; ``first`` tells the number of each one's segment."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(first[at]) != 0)
    heads = at[new]
    tails = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return doc[heads], place[heads], place[tails] + window


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, joined spans; touching ones become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    heads = np.flatnonzero(new)
    return np.stack((spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]), axis=1)


def with_spans(dealt: DataFrame, found: DataFrame, others: DataFrame, cut: Cut, idle: DataFrame) -> DataFrame:
    """The dealt rows and ``spans``, the array of (a, e) to remove there; null where there is none.

    ``idle`` rows take no part and have none. They are not dealt out: without a key they would all meet in one task.
    """
    whole = others.select("doc", "a", (F.col("a") + F.col("n") + (cut.window - 1)).alias("e"))
    spans = found.union(whole).groupBy("doc").agg(F.collect_list(F.struct("a", "e")).alias("spans"))  # bounded by a document's length
    marked = dealt.join(spans, "doc", "left")
    return marked.unionByName(idle.withColumn("spans", F.lit(None).cast(marked.schema["spans"].dataType)))

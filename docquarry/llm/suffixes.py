"""Removal of repeated byte strings by suffix arrays, built by two-stage sorting.

Texts are cut into segments by anchors (anchors.py), so that a shard holds every place where one of its windows may stand.
A shard's suffixes are of two kinds: those smaller than their successor, and the rest. Only the first kind is sorted directly, eight bytes at a
time. One scan of the buckets (by first byte) in rising order then induces the rest: when a suffix is met, the one before it, if of the
other kind, is next in its own bucket. Common prefixes of neighbours show which windows are equal, and of these all but the
first are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import anchors, identity
from docquarry.llm.common import ragged, whole_text

#: Bytes of a removed string and of an anchor.
LENGTH, GRAM = 100, 24
#: The column of a document's own number, where keys do not tell documents apart.
OWN = "_document_number"
#: Bytes of segments sorted together.
SHARD_BYTES = 3_000_000


def eight(text: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, first byte highest; zeros stand beyond the segment's end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    left = ends[owner] - np.arange(len(text))
    for k in range(8):
        out <<= np.uint64(8)
        out |= np.where(left > k, padded[k : k + len(text)], 0).astype(np.uint64)
    return out


def rising(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Is a suffix smaller than its successor? The end of a segment is smaller than any byte."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[ends - 1] = -1
    place = np.where(step != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(place[::-1])[::-1]
    return step[following] > 0


def sort_directly(places: np.ndarray, key: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first ``depth`` bytes."""
    group = np.zeros(len(places), np.int64)
    fixed, at, active = places.copy(), np.arange(len(places)), places
    for k in range(0, depth, 8):
        value = np.where(left[active] > k, key[np.minimum(active + k, len(key) - 1)], 0)
        order = np.lexsort((value, group)) if k else np.argsort(value, kind="stable")
        active, value, group = active[order], value[order], group[order]
        fixed[at] = active
        new = np.ones(len(active), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        number = np.cumsum(new) - 1
        tied = (np.bincount(number) > 1)[number] if len(active) else new
        at, active, group = at[tied], active[tied], number[tied]
        if not len(active):
            break
    return fixed


def suffix_order(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, wanted: np.ndarray, key: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """The places ``wanted`` (the first ones of each segment, as many as given) in suffix order to ``depth`` bytes."""
    small = rising(text, ends)
    size = len(text)
    # A suffix is induced from its successor, so each segment is followed up to a directly sorted suffix, or to its end.
    next_small = np.minimum.accumulate(np.where(small, np.arange(size), size)[::-1])[::-1]
    stop = np.minimum(next_small[begins + wanted - 1] + 1, ends)
    used = np.zeros(size, bool)
    used[ragged(begins, stop - begins)] = True
    direct = np.flatnonzero(used & small)
    direct = sort_directly(direct, key, ends[owner] - np.arange(size), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced = used & ~small
    first = np.zeros(size, bool)
    first[begins] = True

    def induce(scanned: np.ndarray) -> None:
        before = scanned[~first[scanned]] - 1 if len(scanned) else scanned
        before = before[induced[before]]
        if not len(before):
            return
        letters = text[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        heads = [0, *(np.flatnonzero(letters[1:] != letters[:-1]) + 1).tolist(), len(letters)]
        for a, b in zip(heads, heads[1:]):
            waiting[letters[a]].append(before[a:b])

    last = ends[induced[ends - 1]] - 1  # induced from the empty suffix, the smallest of all
    if len(last):
        order = np.argsort(text[last], kind="stable")
        for place in np.split(last[order], np.flatnonzero(np.diff(text[last[order]])) + 1):
            waiting[text[place[0]]].append(place)
    out = []
    for c in range(256):
        i = 0
        while i < len(waiting[c]):
            out.append(waiting[c][i])
            induce(out[-1])
            i += 1
        out.append(direct[cuts[c] : cuts[c + 1]])
        induce(out[-1])
    whole = np.concatenate(out)
    mine = np.zeros(size, bool)
    mine[ragged(begins, wanted)] = True
    return whole[mine[whole]]


def equal_neighbours(order: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """For each but the first in suffix order: does it share ``depth`` bytes with the one before it? All have as many."""
    same = np.arange(1, len(order))
    for k in range(0, depth, 8):
        a, b = key[order[same] + k], key[order[same - 1] + k]
        rest = np.uint64(8 * max(0, 8 - (depth - k)))
        same = same[a >> rest == b >> rest]
    out = np.zeros(len(order), bool)
    out[same] = True
    return out


def later_windows(part: pa.Table, length: int = LENGTH):
    """Spans of the shard's segments whose windows also start earlier."""
    text, offsets = anchors.buffers(part["d"].chunk(0))
    begins, ends = offsets[:-1], offsets[1:]
    windows = part["n"].to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(begins)), ends - begins)
    key = eight(text, ends, owner)
    order = suffix_order(text, begins, ends, windows, key, owner, length)
    doc, a = part["doc"].to_numpy(), part["a"].to_numpy()
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((a, doc))] = np.arange(len(doc))
    when = rank[owner[order]] << 32 | (order - begins[owner[order]])  # windows of one document start in the order of its segments
    heads = np.flatnonzero(~equal_neighbours(order, key, length))
    earliest = np.repeat(np.minimum.reduceat(when, heads), np.diff(np.append(heads, len(order)))) if len(order) else when
    later = np.zeros(len(text), bool)
    later[order[when != earliest]] = True
    places = ragged(begins, windows)
    segment = owner[places]
    return anchors.runs(later[places], segment, doc[segment], a[segment] + places - begins[segment], length)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, text (binary, what is left), n_bytes, n_removed, n_spans and the columns named in ``carry`` of every row.

    Removed is each byte covered by a string of ``length`` bytes that also starts earlier: in a document of a smaller key, or in the
    same one before. Null texts count as empty. Rows that repeat a document (key and text) count as one document and all get its result; different
    texts of one key are different documents, in the order of a hash. Rows
    without a key take no part and stay whole. Texts shorter than ``length``, and empty tables, lose nothing. Columns
    that ``carry`` does not name are left behind; those it names travel with the text, so that no second join has to move it.
    """
    shared = None if key == OWN else identity.numbers(docs, key, text)
    if shared is not None:  # documents of one key are kept apart
        marked = identity.with_number(docs.select(*dict.fromkeys((key, text, *carry))), shared, key, text, OWN)
        return deduplicated(marked, OWN, text, length, (key, *(c for c in carry if c != key))).select(key, "text", "n_bytes", "n_removed", "n_spans", *carry)
    cut = anchors.Cut("bytes", length, GRAM)
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(True)
    held = docs.select(F.col(key).cast("long").alias("doc"), whole_text(text).cast("binary").alias("text"), rest.alias("rest"))
    taking = held.where(F.col("doc").isNotNull())
    found = anchors.repeated(taking, cut, "suffixes")
    dealt = anchors.spread(taking)
    spans = anchors.by_shard(anchors.fetched(dealt, found.firsts, cut), lambda part: later_windows(part, length), SHARD_BYTES)
    marked = anchors.with_spans(dealt, spans, found.others, cut, held.where(F.col("doc").isNull()))

    def run(batches):
        for batch in batches:
            rows = [_left(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column("spans"))]
            left, removed, count = zip(*rows) if rows else ((), (), ())
            arrays = [batch.column(0), pa.array(left, pa.binary()), pa.compute.binary_length(batch.column(1)).cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), batch.column("rest")]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "text", "n_bytes", "n_removed", "n_spans", "rest"])

    counted = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    out = marked.mapInArrow(run, T.StructType([T.StructField("doc", T.LongType()), T.StructField("text", T.BinaryType()), *counted, held.schema["rest"]]))
    return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "text", "n_bytes", "n_removed", "n_spans", *[F.col(f"rest.{c}") for c in carry])


def _left(text: bytes, spans: pa.ListScalar) -> tuple[bytes, int, int]:
    if not spans.is_valid:
        return text, 0, 0
    found = anchors.merged(np.stack([np.asarray(spans.values.field(k)) for k in range(2)], axis=1))
    cuts = [0, *found.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])), int((found[:, 1] - found[:, 0]).sum()), len(found)


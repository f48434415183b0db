"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q, at least two periods long. All runs of a text are found, scale by scale:

* Every substring of 2^k words that repeats inside its text has a name, the same for equal ones (pairs of shorter names, ranked). Names
  compare exactly and tell how far two places agree, in log(n) steps.
* At scale t = 4, 8, ... the synchronising set holds place i if the least hashed name among the substrings of t words that start in [i, i + t] is the
  first or the last of them; substrings of a period of t/3 or less do not compete. Whether i belongs to it depends on the 2t words at i only, so
  it is the same one period later. Places of equal context at a distance in [3t - 1, 6t - 2] propose that distance as a period.
* Where a whole period holds no such place it is itself a stretch of small period, found at an earlier scale. Such stretches that touch or overlap
  propose every distance at which their roots are in phase.
* Periods up to 10 are found by comparing the words themselves.

Each proposal is checked by extending it both ways as far as it goes. A text is one row of work; texts of a batch are handled together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.anchors import mixed
from docquarry.llm.common import ragged, slices, whole_text

#: Bytes of text handled together; a longer text stands alone. A task holds about 4 * log2(words) bytes a word of these.
TEXT_BYTES = 2_000_000
#: The smallest scale; periods below 3 * FIRST - 1 are compared directly.
FIRST = 4
RUN = "array<struct<start:long,length:long,period:long>>"


class Names:
    """Names of the substrings of 2^k words that stand at least twice in their text, by first place; -1 for any other."""

    def __init__(self, codes: np.ndarray, text: np.ndarray):
        self.text, self.levels = text, []
        places, keys, size = np.arange(len(codes)), text * np.int64(codes.max(initial=0) + 1) + codes, 1
        while len(places):
            _, code, often = np.unique(keys, return_inverse=True, return_counts=True)
            several = often[code] > 1
            places, code = places[several], code[several].astype(np.int32)
            if not len(places):
                break
            level = np.full(len(codes), -1, np.int32)
            level[places] = code
            self.levels.append(level)
            # Twice as long: two neighbours with names, in one text.
            first = places[places + 2 * size <= len(codes)]
            second = level[first + size]
            whole = (second >= 0) & (text[first] == text[first + size])
            places = first[whole]
            keys = level[places] * np.int64(level.max() + 1) + second[whole]
            size *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on are those from b > a on."""
        at = b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, inside = self.levels[k], at < len(self.text)
            there = np.where(inside, level[np.minimum(at, len(level) - 1)], -1)
            at = at + (((there >= 0) & (there == level[at - b + a])).astype(np.int64) << k)
        return at - b

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a are those before b > a."""
        back = np.zeros_like(a)
        for k in range(len(self.levels) - 1, -1, -1):
            level, start = self.levels[k], a - back - (1 << k)
            here = np.where(start >= 0, level[np.maximum(start, 0)], -1)
            back = back + (((here >= 0) & (here == level[np.maximum(b - back - (1 << k), 0)])).astype(np.int64) << k)
        return back


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def _short(words: np.ndarray, most: int):
    """Stretches of period 1 to ``most``, at least two periods and four words long: start, end, period."""
    for p in range(1, min(most, len(words) - 1) + 1):
        same = np.zeros(len(words) - p + 2, np.int8)
        same[1:-1] = (words[p:] == words[:-p]) & (words[p:] >= 0)
        edges = np.diff(same)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + p
        long = end - start >= max(2 * p, 4)
        yield start[long], end[long], np.full(int(long.sum()), p)


def _distinct(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By place. Of several periods of one stretch the least is its own, as the others are its multiples."""
    start, end, period = (np.concatenate([r[k] for r in runs]) if runs else np.empty(0, np.int64) for k in range(3))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _synchronised(names: Names, k: int, runs) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal contexts at scale t = 2^k: the first place, and a distance of 3t - 1 to 6t - 2."""
    t, level, context = 1 << k, names.levels[k], names.levels[k + 1]
    start, end, period = runs
    steady = (3 * period <= t) & (end - start >= t)
    marks = np.zeros(len(level) + 1, np.int32)
    np.add.at(marks, start[steady], 1)
    np.add.at(marks, end[steady] - t + 1, -1)
    named = np.flatnonzero(level >= 0)
    value = mixed(level[named].astype(np.uint64) + np.uint64(1)) >> np.uint64(1)
    value[np.cumsum(marks[:-1])[named] > 0] = np.iinfo(np.uint64).max
    places = np.flatnonzero(context >= 0)  # all t + 1 substrings from here on are named, so they are neighbours in ``named``
    at = np.searchsorted(named, places)
    least = _least(value, t + 1)[at]
    chosen = (least != np.iinfo(np.uint64).max) & ((value[at] == least) | (value[at + t] == least))
    places = places[chosen]
    order = np.argsort(context[places], kind="stable")
    places, alike = places[order], context[places[order]]
    first, distance, lag = [], [], 1
    while lag < len(places):
        gap = np.where(alike[lag:] == alike[:-lag], places[lag:] - places[:-lag], np.iinfo(np.int64).max)
        if int(gap.min()) > 6 * t - 2:
            break
        fit = (gap >= 3 * t - 1) & (gap <= 6 * t - 2)
        first.append(places[:-lag][fit])
        distance.append(gap[fit])
        lag += 1
    return (np.concatenate(first), np.concatenate(distance)) if first else (np.empty(0, np.int64),) * 2


def _in_phase(names: Names, k: int, runs) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of period t/3 or less that touch or overlap: a place of the first, and each distance in range that puts their roots in phase."""
    t = 1 << k
    start, end, period = runs
    steady = (3 * period <= t) & (end - start >= 3 * t - 1)
    start, end, period = start[steady], end[steady], period[steady]
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    pair = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]) & (names.text[start[1:]] == names.text[start[:-1]])) if len(start) else np.empty(0, np.int64)
    if not len(pair):
        return (np.empty(0, np.int64),) * 2
    one, two, q = start[pair], start[pair + 1], period[pair]
    # The first place in the second stretch where the root that begins the first one stands.
    who = np.repeat(np.arange(len(pair)), q)
    shift = ragged(np.zeros(len(pair), np.int64), q)
    same = np.ones(len(who), bool)
    for j in range(int(q.max()).bit_length()):
        mine = (q >> j).astype(bool) & (q >> (j + 1) == 0)  # the largest power of two in q
        held = mine[who]
        w, level = who[held], names.levels[j]
        for skip in (np.zeros(len(w), np.int64), q[w] - (1 << j)):
            same[held] &= level[two[w] + shift[held] + skip] == level[one[w] + skip]
    alike, place = np.unique(who[same], return_index=True)
    one, two, q, shift = one[alike], two[alike], q[alike], shift[same][place]
    lowest = 3 * t - 1 + (two + shift - one - (3 * t - 1)) % q
    count = np.maximum((6 * t - 2 - lowest) // q + 1, 0)
    who = np.repeat(np.arange(len(q)), count)
    distance = lowest[who] + ragged(np.zeros(len(q), np.int64), count) * q[who]
    return np.maximum(one[who], two[who] - distance), distance


def runs_of(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of at least four words, ordered by start.

    ``codes``: numbers of the words of several texts, one after the other; ``text``: the (rising) number of each word's text.
    """
    names = Names(codes, text)
    if not names.levels:
        return (np.empty(0, np.int64),) * 3
    found = _distinct(list(_short(names.levels[0], 3 * FIRST - 2)))
    for k in range(FIRST.bit_length() - 1, len(names.levels) - 1):
        proposed = [np.concatenate(x) for x in zip(_synchronised(names, k, found), _in_phase(names, k, found))]
        a, b = proposed[0], proposed[0] + proposed[1]
        start, end = a - names.behind(a, b), b + names.ahead(a, b)
        whole = end - start >= 2 * (b - a)
        found = _distinct([found, (start[whole], end[whole], (b - a)[whole])])
    return found


def _batch(keys: pa.Array, texts: list[bytes], least: int) -> pa.RecordBatch:
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = [w for ws in words for w in ws]
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    start, end, period = runs_of(codes, text)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    marks = np.zeros(len(flat) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, end, -1)
    dropped = np.cumsum(marks[:-1]) > 0
    touched = np.add.reduceat(np.append(dropped, False), offsets[:-1]) * (sizes > 0) if len(words) else sizes
    kept = []
    for i, ws in enumerate(words):
        if touched[i]:
            keep = np.flatnonzero(~dropped[offsets[i] : offsets[i + 1]]).tolist()
            ws = [ws[j] for j in keep]
        kept.append(b" ".join(ws))
    home = text[start] if len(flat) else start
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - offsets[home], end - start, period)], ["start", "length", "period"])
    bounds = pa.array(np.searchsorted(home, np.arange(len(words) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(sizes), pa.ListArray.from_arrays(bounds, runs), pa.array(kept, pa.binary())], names=["key", "n_words", "runs", "text"]
    )


def collapsed(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """key, n_words, runs and text (binary) of every row, narrowly: no row leaves its partition.

    ``runs``: start (word number from 0), length and period of each run of at least ``least`` words (and two periods), ordered by start, then period.
    ``text``: the words that no run contains after its first period, joined by one space. Words are what ASCII white space parts. A null text
    has no words; neither has an empty one. Rows without a key and rows that repeat one are treated like any other. Texts may be of
    any length. Other columns are not carried along.
    """

    def run(batches):
        for batch in batches:
            for i, j in slices(np.asarray(pc.binary_length(batch.column(1))), TEXT_BYTES):
                yield _batch(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).to_pylist(), least)

    held = docs.select(F.col(key).alias("key"), whole_text(text).cast("binary").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return held.mapInArrow(run, f"key {kind}, n_words long, runs {RUN}, text binary").withColumnRenamed("key", key)

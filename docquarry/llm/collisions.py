"""Approximate nearest neighbours by collision counting.

The largest inner product becomes the least distance: rows are divided by the largest norm M and get one more component that makes them unit
vectors, queries are made unit vectors with a zero there, so that distance^2 = 2 - 2 <q, x> / (|q| M).

Every block of rows holds ``HASHES`` random projections as sorted arrays. A query opens a window around its own projection in each of them, of half
width R; a row collides as often as it lies in a window. Rehashing is virtual: the next radius only adds what the wider windows newly take in. A row that
has collided ``THRESHOLD`` times is verified by its exact inner product. A query is done in a block once its k-th verified row lies within
R: a row at a distance of R lies in a window with probability 0.683, so one within R is missed with a probability of 1.4 % at most. The last radius
is infinite and verifies all rows, so a query never ends with fewer rows than there are.

Blocks of rows meet blocks of queries in a grid of bounded cells; a query's winners of all cells are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Random projections of a block, and how often a row must collide to be verified.
HASHES, THRESHOLD = 32, 16
#: The first radius, the factor between radii, and the number of finite ones (the last is beyond any distance of unit vectors).
RADIUS, FACTOR, ROUNDS = 0.25, 1.3, 9
#: Rows and queries of a block at most.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048
SEED = 11
#: More than single precision can be off in the product of two unit vectors.
ROUGH = 1e-5


def sound(vector: str | Column) -> Column:
    """The vector as doubles; null for vectors that are null, zero or hold a null or non-finite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), vector.cast("array<double>"))


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k rows of largest inner product found for every query; ties go to the smaller id.

    Both sides: id long, not null and unique, and vector array<double> as ``sound`` gives it, not null. A query never finds the row of its own id.
    Shorter vectors count as followed by zeros. Returns query_id, rank (from 1), id and score, the inner product summed in the order of
    components. All rows, if there are fewer than k. No rows or no queries: no result rows.
    """
    rows, queries = rows.select("id", "vector"), queries.select("id", "vector")
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    seen = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(largest)).first()
    asked = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    count, width, unit = seen[0], max(seen[1] or 0, asked[1] or 0), seen[2] or 1.0
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit)))
    longest = rows.agg(F.max(norm)).first()[0] or 1.0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wide = max(math.ceil(count / BLOCK_ROWS), min(cores, math.ceil(count / 1024)), 1)
    high = max(math.ceil(asked[0] / BLOCK_QUERIES), 1)

    def cells(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = cells(queries, "high", high, "wide", wide), cells(rows, "wide", wide, "high", high)
    found = left.groupBy("high", "wide").cogroup(right.groupBy("high", "wide")).applyInArrow(
        lambda asking, held: _cell(asking, held, k, width, unit, longest), "query_id long, id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _matrix(side: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in rising order and their vectors as rows."""
    side = side.sort_by("id").combine_chunks()
    ids = side["id"].to_numpy()
    out = np.zeros((len(ids), width))
    if len(ids):
        lists = side["vector"].chunk(0)
        lengths = np.asarray(lists.value_lengths()).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, place] = np.asarray(lists.flatten())
    return ids, out


class Block:
    """Sorted projections of a block of unit vectors."""

    def __init__(self, points: np.ndarray, directions: np.ndarray):
        values = directions @ points.T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        self.size = len(points)

    def windows(self, at: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of every projection's window, by projection and radius."""
        low = np.stack([np.searchsorted(s, x - radii, "left") for s, x in zip(self.sorted, at)])
        high = np.stack([np.searchsorted(s, x + radii, "right") for s, x in zip(self.sorted, at)])
        return low, high

    def search(self, at: np.ndarray, radii: np.ndarray, own: int, verify):
        """Rows newly past the threshold go to ``verify(rows, radius)``, which tells whether to stop. Row ``own`` is left out, if not -1."""
        low, high = self.windows(at, radii)
        counts = np.zeros(self.size, np.int64)
        passed = np.zeros(self.size, bool)
        if own >= 0:
            passed[own] = True
        lows, highs = low[:, 0].tolist(), low[:, 0].tolist()
        for r, radius in enumerate(radii):
            wider_low, wider_high = low[:, r].tolist(), high[:, r].tolist()
            rings = [o[a:b] for o, a, b in zip(self.order, wider_low, lows)] + [o[b:c] for o, b, c in zip(self.order, highs, wider_high)]
            counts += np.bincount(np.concatenate(rings), minlength=self.size)
            lows, highs = wider_low, wider_high
            new = np.flatnonzero((counts >= THRESHOLD) & ~passed)
            passed[new] = True
            if verify(new, float(radius)):
                return


class Verified:
    """The rows that one query verifies: rough products at once, exact ones for all that may be among the k best."""

    def __init__(self, unit_query: np.ndarray, rough: np.ndarray, k: int):
        self.query, self.rough, self.k = unit_query.astype(np.float32), rough, k
        self.rows, self.scores, self.best = [], [], np.empty(0, np.float32)

    def __call__(self, new: np.ndarray, radius: float) -> bool:
        scores = self.rough[new] @ self.query
        self.rows.append(new)
        self.scores.append(scores)
        self.best = np.concatenate((self.best, scores))
        if len(self.best) > self.k:
            self.best = np.partition(self.best, len(self.best) - self.k)[-self.k :]
        return len(self.best) == self.k and 2.0 - 2.0 * (float(self.best.min()) - ROUGH) <= radius * radius

    def leading(self) -> np.ndarray:
        """Rows whose rough product is not clearly below that of the k-th."""
        rows, scores = np.concatenate(self.rows), np.concatenate(self.scores)
        return rows[scores >= self.best.min() - 2 * ROUGH] if len(self.best) == self.k else rows


def _cell(asking: pa.Table, held: pa.Table, k: int, width: int, unit: float, longest: float) -> pa.Table:
    query_ids, queries = _matrix(asking, width)
    ids, vectors = _matrix(held, width)
    out: tuple[list, list, list] = [], [], []
    if len(ids) and len(query_ids):
        points = vectors / unit / longest
        rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", points, points), 0.0))
        directions = np.random.default_rng(SEED).standard_normal((HASHES, width + 1))
        block = Block(np.column_stack((points, rest)), directions)
        lengths = np.abs(queries).max(axis=1, keepdims=True)
        units = queries / (lengths * np.sqrt(np.einsum("ij,ij->i", queries / lengths, queries / lengths))[:, None])
        at = units @ directions[:, :width].T
        radii = np.append(RADIUS * FACTOR ** np.arange(ROUNDS), np.inf)
        rough = points.astype(np.float32)
        places = np.searchsorted(ids, query_ids)
        for i, query in enumerate(query_ids):
            own = int(places[i]) if places[i] < len(ids) and ids[places[i]] == query else -1
            seen = Verified(units[i], rough, k)
            block.search(at[i], radii, own, seen)
            rows = seen.leading()
            scores = np.zeros(len(rows))
            for j in range(width):  # in the order of components, whatever the processor would sum
                scores += vectors[rows, j] * queries[i, j]
            best = np.lexsort((ids[rows], -scores))[:k]
            out[0].append(np.full(len(best), query)), out[1].append(ids[rows[best]]), out[2].append(scores[best])
    whole = [np.concatenate(x) if x else np.empty(0) for x in out]
    return pa.table({"query_id": pa.array(whole[0], pa.int64()), "id": pa.array(whole[1], pa.int64()), "score": pa.array(whole[2], pa.float64())})

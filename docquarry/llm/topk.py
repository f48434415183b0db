"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows and queries are sparse: an id, term numbers and integer weights. Both sides are cut into blocks of bounded
size, and every (query block, row block) pair meets in one cell of a grid. A cell turns its rows into postings by
term; each query's terms scatter weight times posting into a dense array of scores, a partition selection
keeps the leading ones, and the cells' winners are merged per query.

Communication is queries x row blocks + rows x query blocks, and no cell ever holds more than one block of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block at most. They bound a task's memory and do not depend on the data.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048
#: Queries scored at once inside a cell: 64 x 16,384 scores stay near the processor.
CHUNK = 64
LONG = np.iinfo(np.int64)


def quantised(vector: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as double; null for vectors that are null or hold a null or non-finite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def sparse(values: Column) -> tuple[Column, Column]:
    """Terms (positions) and weights of the components that are not zero."""
    held = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("term"), v.alias("weight"))), lambda x: x["weight"] != 0)
    return held["term"], held["weight"]


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query by integer inner product; ties go to the smaller id.

    Both sides: id long, terms array<int>, weights array<long>, ids not null and unique. A query never finds the row
    of its own id. Returns query_id, rank (from 1), id, score. No rows or no queries: no result rows. Terms that
    only one side has add nothing, so a row without terms scores 0. Scores beyond a long are compared exactly and shown as the
    nearest long.
    """
    rows, queries = rows.select("id", "terms", "weights"), queries.select("id", "terms", "weights")
    count, asked = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wide = max(math.ceil(count / BLOCK_ROWS), min(cores, math.ceil(count / 1024)), 1)
    high = max(math.ceil(asked / BLOCK_QUERIES), 1)

    def cells(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = cells(queries, "high", high, "wide", wide), cells(rows, "wide", wide, "high", high)
    found = left.groupBy("high", "wide").cogroup(right.groupBy("high", "wide")).applyInArrow(
        lambda asking, held: _cell(asking, held, k), "query_id long, id long, score decimal(38,0)"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    shown = F.greatest(F.least(F.col("score"), F.lit(LONG.max).cast("decimal(38,0)")), F.lit(LONG.min).cast("decimal(38,0)"))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", shown.cast("long").alias("score"))
    )


def _ragged(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in rising order, and for every entry the place of its row, its term and its weight."""
    side = side.sort_by("id").combine_chunks()
    ids = side["id"].to_numpy()
    if not len(ids):
        return ids, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.fromiter((len(x) for x in side["terms"]), np.int64, len(ids))
    entries = [np.asarray(side[c].chunk(0).flatten()) for c in ("terms", "weights")]
    return ids, np.repeat(np.arange(len(ids)), lengths), entries[0].astype(np.int64), entries[1].astype(np.int64)


def _by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    begins = np.concatenate(([0], cuts)).astype(np.int64) if len(term) else np.empty(0, np.int64)
    ends = np.concatenate((cuts, [len(term)])).astype(np.int64) if len(term) else begins
    return {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(begins, ends)}


def _kind(asked: np.ndarray, held: np.ndarray, terms: int) -> type:
    """The narrowest number type in which no sum of products can overflow."""
    most = max((abs(int(x)) for side in (asked[:0],) for x in side), default=0)
    largest = [max(abs(int(side.max())), abs(int(side.min()))) if len(side) else 0 for side in (asked, held)]
    most = largest[0] * largest[1] * max(terms, 1)
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def _cell(asking: pa.Table, held: pa.Table, k: int) -> pa.Table:
    query_ids, q_row, q_term, q_weight = _ragged(asking)
    ids, row, term, weight = _ragged(held)
    longest = int(np.bincount(q_row).max()) if len(q_row) else 0
    kind = _kind(q_weight, weight, longest)
    size, out = len(ids), ([], [], [])
    postings = {}
    for t, (places, weights) in _by_term(row, term, weight).items():
        if 2 * len(places) > size:  # a posting list that covers most rows is a dense one
            full = np.zeros(size, kind)
            full[places] = weights.astype(kind)
            postings[t] = None, full
        else:
            postings[t] = places, weights.astype(kind)
    starts = np.searchsorted(q_row, np.arange(0, len(query_ids) + CHUNK, CHUNK))
    for c, first in enumerate(range(0, len(query_ids) if size else 0, CHUNK)):
        part = query_ids[first : first + CHUNK]
        own = slice(starts[c], starts[c + 1])
        scores = np.zeros((len(part), size), kind)
        for t, (who, weights) in _by_term(q_row[own] - first, q_term[own], q_weight[own]).items():
            if t not in postings:
                continue
            places, values = postings[t]
            if places is not None:
                scores[who[:, None], places] += np.multiply.outer(weights.astype(kind), values)
            elif 2 * len(who) > len(part):
                full = np.zeros(len(part), kind)
                full[who] = weights.astype(kind)
                scores += np.multiply.outer(full, values)
            else:
                scores[who] += np.multiply.outer(weights.astype(kind), values)
        keep = min(k + 1, size)  # one more, for the query's own row
        floor = np.partition(scores, size - keep, axis=1)[:, size - keep]
        for i, query in enumerate(part):
            best = np.flatnonzero(scores[i] >= floor[i])
            best = best[np.argsort(-scores[i][best], kind="stable")][:keep]  # ids rise, so ties stay in their order
            best = best[ids[best] != query][:k]
            out[0].append(np.full(len(best), query)), out[1].append(ids[best]), out[2].extend(int(x) for x in scores[i][best])
    whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out[:2]]
    return pa.table({"query_id": pa.array(whole[0], pa.int64()), "id": pa.array(whole[1], pa.int64()), "score": pa.array(out[2], pa.decimal128(38, 0))})

"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

Every input partition must know how many of its rows go to each shard. Those numbers are one row of a random matrix with fixed
margins (rows per partition, rows per shard). No one holds the matrix: each task draws its own row by walking down a
binary tree over the partitions, splitting what is left of every shard's room between the two halves; all tasks draw the
same splits, because each node seeds its own generator. Then rows are permuted locally (the labels are shuffled), exchanged,
and permuted again inside each cell, a bounded slice of a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a cell at most, so that the second permutation sorts bounded groups.
CELL_ROWS = 65_536
#: Beyond this the generator has no exact draw; a normal draw of the same mean and variance is rounded instead.
EXACT = 10**9 - 1


def sizes(total: int, shards: int) -> np.ndarray:
    """Exact sizes that differ by one at most."""
    return total // shards + (np.arange(shards) < total % shards)


def split(room: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How much of every colour's room falls to a half that takes ``left`` of all items."""
    out, rest, total = np.zeros_like(room), left, int(room.sum())
    for i in np.flatnonzero(room):
        good, bad = int(room[i]), total - int(room[i])
        if total <= EXACT:
            taken = int(rng.hypergeometric(good, bad, rest)) if rest else 0
        else:
            share = rest / total
            spread = math.sqrt(max(good * share * (1 - share) * bad / (total - 1), 0))
            taken = min(max(round(rng.normal(good * share, spread)), rest - bad, 0), good, rest)
        out[i], rest, total = taken, rest - taken, bad
    return out


def matrix_row(counts: np.ndarray, room: np.ndarray, place: int, seed: int) -> np.ndarray:
    """Row ``place`` of the matrix whose rows add up to ``counts`` and whose columns to ``room``."""
    low, high, node = 0, len(counts), 1
    until = np.concatenate(([0], np.cumsum(counts)))
    while high - low > 1:
        middle = (low + high) // 2
        left = split(room, int(until[middle] - until[low]), np.random.default_rng([seed, node]))
        if place < middle:
            room, high, node = left, middle, 2 * node
        else:
            room, low, node = room - left, middle, 2 * node + 1
    return room


def deal(rows: DataFrame, shards: int, seed: int = 7, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Every row with its shard (from 0) and its slot there (gapless from 0), a uniform random placement.

    Shard sizes differ by one at most, whatever the rows hold: nulls, repeated rows and long texts are rows like others, and no value is
    looked at, so nothing can be hot. An empty table gives an empty result; columns named like the two new ones are
    replaced. The scan of ``rows`` must yield the same rows per partition each time (a file scan does); a task that meets another
    number of rows than was counted fails rather than deal wrongly.
    """
    rows = rows.drop(shard, slot)
    counted = rows.groupBy(F.spark_partition_id().alias("place")).count().collect()  # one number per partition
    counts = np.zeros(max((r["place"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["place"]] = r["count"]
    total = int(counts.sum())
    each = max(1, math.ceil(total / shards / CELL_ROWS))
    room = np.concatenate([sizes(int(n), each) for n in sizes(total, shards)])
    begins = np.cumsum(room.reshape(shards, each), axis=1) - room.reshape(shards, each)
    shared = rows.sparkSession.sparkContext.broadcast((counts, room))
    cell, mix = "_deal_cell", "_deal_mix"
    schema = T.StructType([*rows.schema.fields, T.StructField(cell, T.IntegerType()), T.StructField(mix, T.LongType())])
    placed = rows.withColumn("_deal_place", F.spark_partition_id()).mapInArrow(lambda batches: _labelled(batches, shared.value, seed), schema)
    order = Window.partitionBy(cell).orderBy(mix)
    index = F.element_at(F.array([F.lit(int(x)) for x in begins.ravel()]), F.col(cell) + 1) if each > 1 else F.lit(0)
    return placed.withColumn(slot, (F.row_number().over(order) - 1 + index).cast("long")).withColumn(shard, F.floor(F.col(cell) / each).cast("int")).drop(cell, mix)


def _labelled(batches, shared, seed: int):
    counts, room = shared
    labels, done, place = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if labels is None:
            place = batch.column(batch.num_columns - 1)[0].as_py()
            rng = np.random.default_rng([seed, 0, place])
            held = int(counts[place]) if place < len(counts) else 0
            labels = np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(counts, room, place, seed)) if held else np.empty(0, np.int32)
            rng.shuffle(labels)
        if done + batch.num_rows > len(labels):
            raise RuntimeError(f"partition {place} yields other rows than were counted; write its table first")
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
        arrays += [pa.array(labels[done : done + batch.num_rows]), pa.array(rng.integers(-(2**63), 2**63 - 1, batch.num_rows))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "_deal_cell", "_deal_mix"])
        done += batch.num_rows
    if labels is not None and done != len(labels):
        raise RuntimeError(f"partition {place} yields other rows than were counted; write its table first")

"""Intermediate results, broadcasts that are checked, and exact sums."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from docquarry.session import new_location

BROADCAST_ROWS = 200_000

# Sums of doubles depend on the order in which a shuffle delivers them, and equal scores must
# stay equal for ties to resolve by address. Terms are added as whole multiples of 2^-46 instead.
_UNIT = float(1 << 46)


def exact_value(value: Column) -> Column:
    """A single value, as ``exact_sum`` would give it."""
    return F.rint(value * _UNIT) / _UNIT


def exact_sum(value: Column, window: WindowSpec | None = None) -> Column:
    """Order-independent sum of doubles, per group or over a window.

    Whole multiples of 2^-20 and what is left of each value, up to 2^26 units, are summed apart: sums up to 2^43 fit.
    """
    scaled = value * float(1 << 20)
    coarse = F.floor(scaled)
    fine = F.rint((scaled - coarse) * float(1 << 26)).cast("long")
    sums = [F.sum(part) if window is None else F.sum(part).over(window) for part in (coarse, fine)]
    return sums[0] / float(1 << 20) + sums[1] / _UNIT


_leased: ContextVar[list[str] | None] = ContextVar("leased", default=None)


@contextmanager
def released(spark: SparkSession):
    """Deletes, on leaving, the intermediate tables that were settled inside. Frames made of them must have been consumed by then."""
    mine: list[str] = []
    token = _leased.set(mine)
    try:
        yield
    finally:
        _leased.reset(token)
        for location in mine:
            delete(spark, location)


def delete(spark: SparkSession, location: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and safe against lost executors.

    Inside ``released`` the table lasts until its end, else until the owner of the folder clears it.
    """
    location = new_location(df.sparkSession, label)
    if (mine := _leased.get()) is not None:
        mine.append(location)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


@dataclass(frozen=True)
class Held:
    """An intermediate result with its exact row count."""

    rows: DataFrame
    count: int
    local: pa.Table | None = None  # the rows themselves, where the driver made them

    def side(self) -> DataFrame:
        """As a join side: broadcast only when its counted rows are few; else left to a shuffle."""
        return F.broadcast(self.rows) if self.count <= BROADCAST_ROWS else self.rows


def hold_table(df: DataFrame, label: str) -> Held:
    """For results that grow with the data or the number of queries."""
    table = settled(df, label)
    return Held(table, table.count())


def hold_local(df: DataFrame, label: str) -> Held:
    """For what belongs to one interactive query: a few rows per word, kept by the session itself."""
    rows = df.toArrow()
    return Held(df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows, rows)


@contextmanager
def narrow_rows(spark: SparkSession):
    """What is executed inside hands rows of a few numbers to Python. Their number alone bounds a batch: adding up its bytes anew for each row takes
    Spark longer than writing the row."""
    bytes_, rows = (f"spark.sql.execution.arrow.{name}" for name in ("maxBytesPerBatch", "maxRecordsPerBatch"))
    usual, bounded = spark.conf.get(bytes_, None), int(spark.conf.get(rows, None) or 1) > 0
    if bounded:
        spark.conf.set(bytes_, str((1 << 31) - 1))
    try:
        yield
    finally:
        if bounded and usual is None:
            spark.conf.unset(bytes_)
        elif bounded:
            spark.conf.set(bytes_, usual)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, spread over all of them; a larger one is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

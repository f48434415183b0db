"""What the operators share: reading, row keys, checked text columns and ragged numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed word rule of the contracts, as a Java or RE2 character class of separators.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row; a null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Words of a run. The share of distinct words falls with a text's length, so it is taken over runs of this many.
RUN = 1_000


def distinct_in_runs(words: Column) -> Column:
    """The distinct words of every run of ``RUN`` words (the last may be shorter), summed over all runs."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(RUN)))
    return F.coalesce(F.aggregate(starts, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice(words, i, RUN)))), F.lit(0))


def binary(values: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(values, pa.binary())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.repeat(starts - begins, lengths) + np.arange(total, dtype=np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and the offsets of its rows; nothing is copied."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def slices(sizes: np.ndarray, most: int):
    """Consecutive ranges of rows whose sizes add up to about ``most``; a larger row stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def parts_for(df: DataFrame, least: int = 1) -> int:
    """Partitions for an explicit exchange: the cluster's own number, never fewer than its cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)

"""Exact histogram of encoded lengths, and what suffix sums over it answer for every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import slices, whole_text
from docquarry.llm.tokens import shared_pieces
from docquarry.operators.sizing import settled

#: Lengths summed together before running totals are taken, so that the only global window has one row per so many lengths.
BUCKET = 1024


def encoded_lengths(docs: DataFrame, definition: bytes, pattern: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """The rows with the number of ids of their text; a null or empty text has 0. The text itself does not come back from Python."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a public vocabulary's file, under 2 MB
    held = docs.withColumn("_lengths_in", whole_text(text)).drop(text, name)
    schema = T.StructType([*held.drop("_lengths_in").schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        pieces = shared_pieces(shared.value, pattern)
        for batch in batches:
            column, counts = batch.column(batch.num_columns - 1), []
            for a, b in slices(np.asarray(pa.compute.binary_length(column)), 4_000_000):
                counts += [len(x) // 4 for x in pieces.ids(column.slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], name])

    return held.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """One row per length L that occurs, with the answers for a context limit of L.

    docs and tokens at this length; docs_up_to and tokens_up_to (documents that fit); docs_beyond (documents cut at L), docs_total;
    kept_tokens, the sum of min(length, L), and cut_tokens, the rest. The q-quantile of lengths is the first L with
    docs_up_to >= q * docs_total; a limit between two lengths keeps kept_tokens of the lower one plus docs_beyond times the gap.
    Null lengths count as 0. No rows: no lengths.
    """
    counts = lengths.groupBy(F.coalesce(F.col(name), F.lit(0)).alias("length")).agg(F.count(F.lit(1)).alias("docs"))
    counts = settled(counts, "lengths")  # a row per length; texts are encoded once for both uses
    counts = counts.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("bucket", F.floor(F.col("length") / BUCKET))
    sums = counts.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    ahead, whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # One row per 1,024 lengths meets in this window, so it is bounded by the longest text, not by the table.
    sums = sums.select(
        "bucket", F.coalesce(F.sum("d").over(ahead), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t0"),
        F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("bucket").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.join(sums, "bucket").select(
        "length", "docs", "tokens", (F.col("d0") + F.sum("docs").over(inside)).alias("docs_up_to"),
        (F.col("t0") + F.sum("tokens").over(inside)).alias("tokens_up_to"), "docs_total", "tokens_total",
    )
    beyond = F.col("docs_total") - F.col("docs_up_to")
    kept = F.col("tokens_up_to") + beyond * F.col("length")
    return run.select(
        "length", "docs", "tokens", "docs_up_to", "tokens_up_to", "docs_total", beyond.alias("docs_beyond"),
        kept.alias("kept_tokens"), (F.col("tokens_total") - kept).alias("cut_tokens"),
    )

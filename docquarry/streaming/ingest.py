"""An index kept by a stream of documents: every batch becomes one more segment."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.functions.paths import source_uri
from docquarry.operators.catalog import chunks_of, parse
from docquarry.operators.index import SearchIndex, build_index, open_index, refreshed
from docquarry.operators.sizing import settled
from docquarry.session import new_location

GENERATIONS = "batch long, location string"


def latest(rows: DataFrame) -> DataFrame:
    """Of the rows of one path the one of greatest ``version`` (null is least), ties to the greater text."""
    order = W.partitionBy("relative_path").orderBy(F.col("version").desc_nulls_last(), F.col("raw").desc_nulls_last())
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def current_generation(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """The last batch that was taken in whole, and the generation it left."""
    rows = spark.read.schema(GENERATIONS).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/generations")
    last = rows.orderBy(F.col("batch").desc()).first()  # a row per batch
    return (last.batch, last.location) if last else None


def streamed_index(spark: SparkSession, folder: str) -> SearchIndex | None:
    last = current_generation(spark, folder)
    return open_index(spark, last[1]) if last else None


def take_in(rows: DataFrame, batch: int, folder: str, scheme: str, analyzer: str = "en") -> None:
    """Make one batch part of the index in ``folder``. A batch that was taken in before changes nothing.

    ``rows``: file_path, relative_path, raw and version. A null raw takes the document out; a document that cannot be parsed leaves the index as
    one without chunks does.
    """
    spark = rows.sparkSession
    known = current_generation(spark, folder)
    if known and known[0] >= batch:
        return
    newest = settled(latest(rows), "batch")
    parsed = settled(parse(newest.filter("raw is not null").select("file_path", "relative_path", "raw"), scheme).filter("error is null"), "documents")
    fresh = chunks_of(parsed)
    if known is None:
        index = build_index(fresh, analyzer, new_location(spark, "index"))
    else:
        gone = newest.select(source_uri(F.col("relative_path"), scheme).alias("source_uri"))
        index = refreshed(open_index(spark, known[1]), fresh, gone)
    # Written last: a batch that failed before is taken in again, into a generation of its own.
    spark.createDataFrame([(batch, index.location)], GENERATIONS).coalesce(1).write.mode("append").parquet(f"{folder}/generations")


def follow(documents: DataFrame, folder: str, scheme: str = "doc", analyzer: str = "en", **trigger) -> StreamingQuery:
    """Start a query that indexes a stream of documents as they come; see ``take_in`` for their columns.

    ``folder`` lies in the shared folder and holds the checkpoint and the list of generations. Started again with the same folder, the stream goes on where it
    ended. Readers open ``streamed_index`` and are not disturbed by later batches.
    """
    spark = documents.sparkSession
    spark.createDataFrame([], GENERATIONS).write.mode("append").parquet(os.path.join(folder, "generations"))
    writer = documents.writeStream.foreachBatch(lambda rows, batch: take_in(rows, batch, folder, scheme, analyzer))
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

"""Tells apart documents that share a key but not a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import whole_text
from docquarry.llm.merkle import numbered


def numbers(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """(doc, h, number) of every key and hash of a text, numbered in their order; None where each key has one text only.

    Rows without a key are left out; a null text counts as empty. Operators that find their documents by a key use the number in its place:
    it keeps the order of keys. Two 64-bit numbers a row are shuffled.
    """
    held = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(whole_text(text)).alias("h")).where(F.col("doc").isNotNull())
    if held.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        return None
    placed = numbered(held.distinct().withColumn("g", F.lit("")), "g", ["doc", "h"], "documents")
    return placed.select("doc", "h", F.col("pos").alias("number"))


def with_number(docs: DataFrame, found: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """The rows with their document's number, null where the key is."""
    marks = found.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), F.col("number").alias(name))
    same = (F.col(key).cast("long") == F.col("_doc")) & (F.xxhash64(whole_text(text)) == F.col("_h"))
    return docs.join(marks, same, "left").drop("_doc", "_h")

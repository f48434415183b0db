"""Differences between the announced listing and a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.paths import addressable

COMPARED = ("name", "description", "mime_type")


def listing_diff(announced: DataFrame, current: DataFrame) -> DataFrame:
    """(uri, change) with change one of added, changed, removed. Addresses that are no URL take no part."""
    current = current.filter(addressable(F.col("uri")))
    old = announced.select("uri", F.struct(*COMPARED).alias("old"))
    new = current.select("uri", F.struct(*COMPARED).alias("new"))
    joined = old.join(new, "uri", "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return joined.select("uri", change.alias("change")).filter(F.col("change").isNotNull())

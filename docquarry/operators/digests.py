"""Digests of a listing and of contents, for change detection.

Every record is hashed on its own; records are then combined in key order within a narrow
range of key hashes, ranges within a wider one, and so on to a single value. Two tables have
the same digest exactly when they hold the same records, and no task concatenates more than
one range. An empty table has the digest of empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hexadecimal digits of the key's hash that name a range, from narrow to wide: 16 million, 4096, one.
LEVELS = (6, 3, 0)
NUL = "\u0000"


def _joined_hash(order: str) -> Column:
    joined = F.expr(f"listagg(part, '\\n') within group (order by {order})")
    return F.sha2(F.coalesce(joined, F.lit("")).cast("binary"), 256).alias("part")


def digest(df: DataFrame, key: Column, record: Column) -> DataFrame:
    """One row, one column ``digest``."""
    parts = df.select(
        F.sha2(key.cast("binary"), 256).alias("place"), key.alias("key"), F.sha2(record.cast("binary"), 256).alias("part")
    )
    order = "key, part"
    for digits in LEVELS:
        place = [F.substring("place", 1, digits).alias("place")] if digits else []
        parts = parts.groupBy(*place).agg(_joined_hash(order))
        order = "place"
    return parts.select(F.col("part").alias("digest"))


def listing_digest(listing: DataFrame) -> DataFrame:
    """Changes with any path, size or modification time; reads no contents."""
    record = F.concat("relative_path", F.lit(NUL), F.col("size").cast("string"), F.lit(NUL), F.col("mtime_ns").cast("string"))
    return digest(listing, F.col("relative_path"), record)


def content_digest(sources: DataFrame) -> DataFrame:
    """Changes with any address or fingerprint, not with a mere touch."""
    return digest(sources, F.col("uri"), F.concat("uri", F.lit(NUL), "fingerprint"))


def value(digest_frame: DataFrame) -> str:
    return digest_frame.first().digest

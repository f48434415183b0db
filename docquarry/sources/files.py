"""Reading the bytes of listed files on the executors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.operators.sizing import settled
from docquarry.sources.listing import as_path

RAW = "file_path string, relative_path string, raw binary, read_error string"
_RAW_ARROW = pa.schema(
    [("file_path", pa.string()), ("relative_path", pa.string()), ("raw", pa.binary()), ("read_error", pa.string())]
)
BYTES_PER_TASK = 128 * 1024 * 1024
BYTES_TO_OPEN = 4096  # what opening a file costs, as bytes read
BYTES_PER_BATCH = 16 * 1024 * 1024


def _read(batches):
    rows, held = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RAW_ARROW)], schema=_RAW_ARROW)

    for batch in batches:
        for path, relative in zip(batch.column("path").to_pylist(), batch.column("relative_path").to_pylist()):
            try:
                with open(as_path(path), "rb") as file:
                    data, error = file.read(), None
            except OSError as failure:
                data, error = None, str(failure)
            rows.append((path, relative, data, error))
            held += len(data or b"")
            if held >= BYTES_PER_BATCH:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()


def dealt(listing: DataFrame, cores: int) -> tuple[DataFrame, int]:
    """path, relative_path, size and the ``task`` that reads each file, and how many tasks there are.

    Files in path order are cut where the running sum of their bytes passes a task's share, so no task gets more than its share and one
    file. Ranges of paths are summed apart and hand on one number each.
    """
    weight = F.col("size") + BYTES_TO_OPEN
    total = listing.agg(F.sum(weight)).first()[0] or 0
    share = max(1, min(BYTES_PER_TASK, -(-total // cores)))
    ranged = settled(listing.select("path", "relative_path", "size").repartitionByRange("path").withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("range").agg(F.sum(weight).alias("sum"))  # a row per task
    before = sums.select("range", (F.sum("sum").over(W.orderBy("range")) - F.col("sum")).alias("before"))
    running = F.sum(weight).over(W.partitionBy("range").orderBy("path").rowsBetween(W.unboundedPreceding, W.currentRow)) - weight
    placed = ranged.withColumn("running", running).join(F.broadcast(before), "range")
    task = F.floor((F.col("before") + F.col("running")) / share).cast("int")
    return placed.select("path", "relative_path", "size", task.alias("task")), max(1, -(-total // share))


def read_files(listing: DataFrame) -> DataFrame:
    """Contents of the listed files. Tasks are sized by bytes, from the listing alone."""
    placed, tasks = dealt(listing, listing.sparkSession.sparkContext.defaultParallelism)
    return placed.repartitionById(tasks, F.col("task")).select("path", "relative_path").mapInArrow(_read, RAW)

"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

PACKAGE = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(context: SparkContext) -> None:
    """Make this package importable in every Python worker, wherever the driver was started."""
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix=f"{PACKAGE}-ship-")
    above = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(os.path.join(folder, PACKAGE), "zip", above, PACKAGE))
    _shipped.add(context.applicationId)


def build_session(app: str = "docquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package expects; callers may override any of them.

    Shuffle partitions stay at the cluster's own value: adaptive execution coalesces
    small ones, so a fixed low number would only hurt large inputs.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark.sparkContext)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local master gets a private folder of its own; on a cluster a machine-local
    folder would vanish with its executor, so an unset value is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="docquarry-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_location(spark: SparkSession, label: str) -> str:
    """A fresh, never reused location below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")

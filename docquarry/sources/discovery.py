"""From a content root to documents: the configured index and the older resources folder."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import paths
from docquarry.operators.catalog import CatalogError, parse
from docquarry.sources.files import RAW, read_files
from docquarry.sources.listing import Selection, list_files

log = logging.getLogger(__name__)


def discover(spark: SparkSession, root: str, selection: Selection, scheme: str, listing: DataFrame | None = None) -> DataFrame:
    """Documents of a content root (see ``catalog.parse`` for the columns).

    A strict selection must match something and every file must load; a lenient one warns
    and leaves out what does not. A selected file that is not Markdown is always an error.
    """
    listing = list_files(spark, root, selection) if listing is None else listing
    if selection.legacy:
        return _legacy(listing, scheme)
    if listing.isEmpty():
        if not selection.lenient:
            raise CatalogError("the selection holds no files")
        log.warning("No selected file below %s", root)
        return parse(spark.createDataFrame([], RAW), scheme)
    stray = listing.filter(~paths.is_markdown(F.col("path"))).select("path").orderBy("path").head()
    if stray:
        raise CatalogError(f"selected, but not Markdown: {stray.path}")
    return parse(read_files(listing), scheme)


def _legacy(listing: DataFrame, scheme: str) -> DataFrame:
    return described(read_files(listing), scheme)


def described(texts: DataFrame, scheme: str) -> DataFrame:
    """Documents that must have a header with a name and a description; the others carry an error."""
    documents = parse(texts, scheme, required_header=True)
    nameless = (F.coalesce("declared_name", F.lit("")) == "") | (F.coalesce("declared_description", F.lit("")) == "")
    return documents.withColumn("error", F.when(nameless & F.col("error").isNull(), "missing metadata").otherwise(F.col("error")))

"""Immutable generations of catalog and index, swapped by one reference assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from docquarry.operators.catalog import Catalog
from docquarry.operators.index import SearchIndex


@dataclass(frozen=True)
class Snapshot:
    listing: DataFrame
    documents: DataFrame  # with the rows that failed to load, which a refresh tries again
    catalog: Catalog
    index: SearchIndex
    announced: DataFrame
    versions: DataFrame  # what each source's part of the index was made of
    layers: int = 0  # refreshes since the documents were last written as one table


class SnapshotHolder:
    """A caller takes ``current`` once and works on that generation to the end."""

    def __init__(self, snapshot: Snapshot | None = None):
        self.current = snapshot

    def swap(self, snapshot: Snapshot) -> Snapshot | None:
        previous, self.current = self.current, snapshot
        return previous

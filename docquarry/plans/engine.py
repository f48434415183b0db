"""The engine: a content root opened for searching and reading, kept current by revalidation."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import search as ranked_search
from docquarry.operators.catalog import Catalog, check_unique, chunks_of, reject_or_skip, sources_of
from docquarry.operators.diff import listing_diff
from docquarry.operators.digests import content_digest, listing_digest, value
from docquarry.operators.index import MOST_CHANGED, MOST_SEGMENTS, SearchIndex, build_index, merged, refresh_index
from docquarry.operators.links import link_transformer
from docquarry.operators.page import nothing_found, page_text, search_pages
from docquarry.operators.sizing import hold_local, hold_table, released, settled
from docquarry.session import new_location, ship_package
from docquarry.settings import Settings
from docquarry.sources import manifest as man
from docquarry.sources.discovery import discover
from docquarry.sources.listing import list_files
from docquarry.sources.prompts import discover_prompts, get_prompt, list_prompts
from docquarry.streaming.refresh import REFRESH_INTERVAL, Revalidator, changed_files
from docquarry.streaming.snapshot import Snapshot, SnapshotHolder

log = logging.getLogger(__name__)


class EngineClosed(RuntimeError):
    pass


class Engine:
    """Open with ``Engine.open``. Searching and reading revalidate first; listings and prompts do not."""

    def __init__(self, spark: SparkSession, settings: Settings, manifest: man.Manifest, layout: man.Layout):
        self.spark, self.settings, self.manifest, self.layout = spark, settings, manifest, layout
        self.holder = SnapshotHolder()
        self.changes: DataFrame | None = None
        self.on_change: Callable[[DataFrame], None] = lambda changes: None
        self._layers = 0
        self._selection = manifest.effective_selection()
        self._root = layout.path(settings.content_dir, layout.resources) if self._selection.legacy else settings.content_dir

    @classmethod
    def open(
        cls,
        spark: SparkSession,
        settings: Settings,
        version: str = "",
        layout: man.Layout = man.Layout(),
        interval: float = REFRESH_INTERVAL,
        now: Callable[[], float] | None = None,
    ) -> Engine:
        ship_package(spark.sparkContext)
        engine = cls(spark, settings, man.load_manifest(settings.content_dir, version, layout), layout)
        # The listing is taken before the files are read: a file edited in between is pending work.
        listing = engine._list()
        found = engine._discover(listing)
        sources = found[1].filter("error is null")
        if engine.manifest.defaulted and man.resources_ignored(settings.content_dir, engine.manifest, sources.limit(1).count(), layout):
            log.warning("Found %s but no manifest; defaults index only %s", layout.path("", layout.resources), man.DEFAULT_INCLUDE)
        engine.prompts = settled(discover_prompts(spark, layout.path(settings.content_dir, layout.prompts)), "prompts")
        engine._publish(found)
        clock = {"now": now} if now else {}
        engine._revalidator = Revalidator(
            engine._listing_digest, engine._rediscover, engine._content_digest, engine._publish,
            value(listing_digest(listing)), engine._content_digest(found), interval, **clock,
        )
        return engine

    # Discovery

    def _list(self) -> DataFrame:
        return list_files(self.spark, self._root, self._selection)

    def _discover(self, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
        documents = discover(self.spark, self._root, self._selection, self.settings.uri_scheme, listing)
        documents = settled(documents, "documents")
        reject_or_skip(documents, self._selection.lenient or self._selection.legacy)
        return listing, documents

    def _listing_digest(self) -> str:
        self._listed = self._list()
        return value(listing_digest(self._listed))

    def _rediscover(self) -> tuple[DataFrame, DataFrame]:
        """Only files that are new, differ, or failed before are read; the rest is carried over where it is written."""
        published = self.holder.current
        loaded = published.documents.filter("error is null").select("file_path")
        known = published.listing.join(loaded.withColumnRenamed("file_path", "path"), "path", "left_semi")
        todo = changed_files(known, self._listed)
        kept = self._listed.join(todo.select("path"), "path", "left_anti").select(F.col("path").alias("file_path"))
        dropped = hold_table(published.documents.select("file_path").join(kept, "file_path", "left_anti"), "dropped")
        carried = published.documents.join(dropped.side(), "file_path", "left_anti") if dropped.count else published.documents
        if self._listed.isEmpty() or not todo.isEmpty():
            fresh = discover(self.spark, self._root, self._selection, self.settings.uri_scheme, self._listed if kept.isEmpty() else todo)
            carried = carried.unionByName(settled(fresh, "documents"))
        # Every refresh lays a table over those before; from time to time they become one again.
        self._layers = published.layers + 1
        if self._layers > MOST_SEGMENTS:
            carried, self._layers = settled(carried, "documents"), 0
        reject_or_skip(carried, self._selection.lenient or self._selection.legacy)
        return self._listed, carried

    def _content_digest(self, found: tuple[DataFrame, DataFrame]) -> str:
        return value(content_digest(found[1].filter("error is null")))

    def _publish(self, found: tuple[DataFrame, DataFrame]) -> None:
        listing, documents = found
        loaded = documents.filter("error is null")
        check_unique(loaded, "uri", "source URI")
        sources = sources_of(loaded)
        transformers = (link_transformer(sources),) if self.settings.cross_ref else ()
        catalog = Catalog(sources, chunks_of(loaded), transformers)
        versions = settled(self._versions(catalog), "versions")
        published = self.holder.current
        index = self._first_index(catalog) if published is None else self._next_index(catalog, loaded, versions, published)
        announced = settled(sources.select("uri", "name", "description", "mime_type"), "announced")
        previous = self.holder.swap(Snapshot(listing, documents, catalog, index, announced, versions, self._layers))
        if previous is not None:
            previous.index.release(keep=index)
            self.changes = settled(listing_diff(previous.announced, announced), "changes")
            if not self.changes.isEmpty():
                self.on_change(self.changes)

    def _versions(self, catalog: Catalog) -> DataFrame:
        """(source_uri, version): equal versions have equal chunks in the index."""
        own = catalog.sources.select(F.col("uri").alias("source_uri"), F.sha2(F.concat_ws("/", "fingerprint", "relative_path"), 256).alias("version"))
        if not catalog.transformers:
            return own
        # Rewritten text depends on other sources too.
        text = F.sort_array(F.collect_list(F.struct("chunk_id", F.sha2(F.col("content").cast("binary"), 256))))  # one document's chunks
        rewritten = catalog.indexed_chunks().groupBy("source_uri").agg(F.sha2(F.to_json(text).cast("binary"), 256).alias("rewritten"))
        return own.join(rewritten, "source_uri", "left").select("source_uri", F.concat_ws("/", "version", "rewritten").alias("version"))

    def _first_index(self, catalog: Catalog) -> SearchIndex:
        return build_index(catalog.indexed_chunks(), "en", new_location(self.spark, "index"), in_memory=self.settings.search.in_memory)

    def _next_index(self, catalog: Catalog, loaded: DataFrame, versions: DataFrame, published: Snapshot) -> SearchIndex:
        """The published index with the sources that differ written anew; a whole new one where most do."""
        changed = hold_table(versions.join(published.versions, ["source_uri", "version"], "left_anti").select("source_uri"), "changed")
        gone = published.versions.join(versions, ["source_uri", "version"], "left_anti").select("source_uri")
        if changed.count > MOST_CHANGED * versions.count():
            return self._first_index(catalog)
        mine = changed.side().withColumnRenamed("source_uri", "uri")
        part = loaded.join(mine, "uri", "left_semi")
        fresh = Catalog(sources_of(part), chunks_of(part), catalog.transformers).indexed_chunks()
        return merged(refresh_index(published.index, settled(fresh, "fresh"), gone))

    # What callers use

    def revalidate(self) -> bool:
        return self._revalidator.revalidate()

    def _index(self) -> SearchIndex | None:
        """The index of the current generation, brought up to date; none after ``close``."""
        if self.holder.current is None:
            return None
        self.revalidate()
        return self.holder.current.index

    def search(self, query: str, limit: int = 0) -> DataFrame | None:
        return ranked_search.search(self._index(), query, self.settings.search, limit)

    def search_page(self, query: str) -> str:
        """One page of results. What the search writes on its way is deleted again."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        index = self._index()
        with released(self.spark):
            return self._pages(index, asked, hold_local).first().page

    def search_page_many(self, queries: DataFrame) -> DataFrame:
        """(query_id, page) for a table of (query_id, query), all from one generation.

        Consumed inside ``sizing.released``, it leaves no intermediate tables.
        """
        return self._pages(self._index(), queries, hold_table)

    def _pages(self, index: SearchIndex | None, queries: DataFrame, hold) -> DataFrame:
        search = self.settings.search
        if index is None:
            return queries.select("query_id", nothing_found().alias("page"))
        return page_text(queries, search_pages(index, queries, search, hold=hold), search.result_mode)

    def _catalog(self) -> Catalog:
        if self.holder.current is None:
            raise EngineClosed("the engine is closed")
        return self.holder.current.catalog

    def read(self, uri: str) -> str:
        """Text behind an address, from the current generation; ``EngineClosed`` after ``close``."""
        if self.holder.current is not None:
            self.revalidate()
        return self._catalog().read(uri)

    def resources(self) -> DataFrame:
        return self._catalog().listing()

    def list_prompts(self) -> DataFrame:
        return list_prompts(self.prompts)

    def prompt(self, name: str, **arguments: str) -> dict:
        return {"description": f"Rendered prompt: {name}", "messages": get_prompt(self.prompts, name, arguments)}

    def tool(self, name: str) -> man.Tool:
        return self.manifest.tool(name)

    def document_count(self) -> int:
        """Chunks in the index; none while nothing is published."""
        return 0 if self.holder.current is None else self.holder.current.index.chunk_count

    def close(self) -> None:
        """Let go of the published generation; calling it again does nothing."""
        snapshot, self.holder.current = self.holder.current, None
        if snapshot is not None:
            snapshot.index.release()

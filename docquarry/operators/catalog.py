"""Sources and chunks: from raw text to the two tables everything else reads."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import paths
from docquarry.functions.outline import outline_of
from docquarry.operators.sizing import hold_table

log = logging.getLogger(__name__)

SOURCE_COLUMNS = (
    "id", "uri", "name", "description", "mime_type", "file_path", "relative_path",
    "content", "fingerprint", "body_start_line", "keywords", "path_labels",
)
CHUNK_COLUMNS = (
    "chunk_id", "source_id", "source_uri", "chunk_uri", "source_title", "source_path", "path_labels",
    "heading_path", "section_fragment", "fragment", "part", "part_count", "start_line", "end_line",
    "content", "keywords",
)
DESCRIPTION_LIMIT = 200


class CatalogError(ValueError):
    pass


class UnknownResource(KeyError):
    pass


class UnknownFragment(UnknownResource):
    pass


def _slice_bytes(text: Column, start: Column, count: Column) -> Column:
    """Bytes of a text by offset: constant work per slice, unlike counting code points."""
    return F.substr(text.cast("binary"), start.cast("int") + 1, count.cast("int")).cast("string")


def parse(texts: DataFrame, scheme: str, required_header: bool = False) -> DataFrame:
    """One row per document with its metadata, body and chunk ranges; ``error`` is null when all is well.

    ``texts`` has ``file_path``, ``relative_path`` and ``raw`` (text or bytes), and may have
    ``read_error``, and ``uri``, the address where it is known. The whole step is narrow: no row leaves its partition.
    """
    raw = F.col("raw")
    text = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\r\n"), F.lit("\n"))
    read_error = F.col("read_error") if "read_error" in texts.columns else F.lit(None).cast("string")
    outlined = texts.select(
        "file_path",
        "relative_path",
        read_error.alias("read_error"),
        F.sha2(raw.cast("binary"), 256).alias("fingerprint"),
        text.alias("text"),
        (F.col("uri") if "uri" in texts.columns else paths.source_uri(F.col("relative_path"), scheme)).alias("uri"),
        outline_of(text, required_header).alias("o"),
    )
    uri = F.col("uri")
    size = F.octet_length("text")
    body = F.when(F.col("o.body_byte") > 0, _slice_bytes(F.col("text"), F.col("o.body_byte"), size)).otherwise(F.col("text"))
    problem = (
        F.when(F.col("read_error").isNotNull(), F.concat(F.lit("unreadable: "), "read_error"))
        .when(F.col("o.error").isNotNull(), F.concat(F.lit("unparsable: "), "o.error"))
        .when(~paths.addressable(uri), F.lit("its path makes no valid address"))
    )
    return outlined.select(
        problem.alias("error"),
        uri.alias("id"),
        uri.alias("uri"),
        F.coalesce("o.name", F.lit("")).alias("name"),
        paths.truncate(F.coalesce("o.description", F.lit("")), DESCRIPTION_LIMIT).alias("description"),
        F.lit("text/markdown").alias("mime_type"),
        "file_path",
        "relative_path",
        body.alias("content"),
        "fingerprint",
        F.col("o.body_start_line").alias("body_start_line"),
        F.coalesce("o.keywords", F.array().cast("array<string>")).alias("keywords"),
        paths.path_labels(F.col("relative_path")).alias("path_labels"),
        F.col("o.declared_name").alias("declared_name"),
        F.col("o.declared_description").alias("declared_description"),
        F.col("o.ranges").alias("ranges"),
    )


def sources_of(documents: DataFrame) -> DataFrame:
    return documents.select(*SOURCE_COLUMNS)


def chunks_of(documents: DataFrame, numbered: bool = False) -> DataFrame:
    """One row per chunk. Text is sliced before the explode, so no row repeats its document.

    ``numbered`` adds ``nth``, the place (from 0) of a chunk among those of its source by ``chunk_id``.
    """
    cut = F.transform(
        "ranges",
        lambda r: F.struct(
            r["fragment"].alias("fragment"),  # comes first, as structs are sorted by it; it is unique in its source
            *(r[name].alias(name) for name in CHUNK_COLUMNS if name in RANGE_FIELDS and name != "fragment"),
            _slice_bytes(F.col("content"), r["start_byte"], r["byte_count"]).alias("content"),
        ),
    )
    exploded = documents.select("id", "uri", "name", "relative_path", "path_labels", "keywords", F.posexplode(F.array_sort(cut)).alias("nth", "c") if numbered else F.explode(cut).alias("c"))
    address = {"chunk_id": "id", "chunk_uri": "uri"}
    renamed = {
        "source_id": "id", "source_uri": "uri", "source_title": "name", "source_path": "relative_path",
        "path_labels": "path_labels", "keywords": "keywords",
    }
    return exploded.select(
        *(
            F.concat(address[name], F.lit("#"), "c.fragment").alias(name)
            if name in address
            else F.col(renamed.get(name, f"c.{name}")).alias(name)
            for name in CHUNK_COLUMNS
        ),
        *(["nth"] if numbered else []),
    )


RANGE_FIELDS = frozenset(
    {"heading_path", "section_fragment", "fragment", "part", "part_count", "start_line", "end_line"}
)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once. Counting combines on the map side, so a hot key costs nothing extra."""
    return df.groupBy(key).count().filter(F.col("count") > 1).select(key)


def check_unique(df: DataFrame, key: str, what: str) -> None:
    repeated = duplicates(df, key).orderBy(key).head()
    if repeated:
        raise CatalogError(f"duplicate {what}: {repeated[0]}")


def reject_or_skip(documents: DataFrame, lenient: bool) -> DataFrame:
    """Strict: the first failing file in path order is an error. Lenient: failing files are left out and counted in the log."""
    failures = documents.filter(F.col("error").isNotNull()).select("file_path", "error").orderBy("file_path")
    if lenient:
        if number := failures.count():
            log.warning("%d files are left out; the table of documents holds each with its error", number)
    elif (first := failures.head()) is not None:
        raise CatalogError(f"{first.file_path}: {first.error}")
    return documents.filter(F.col("error").isNull())


Transformer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Catalog:
    """An immutable pair of tables. Transformers rewrite ``content`` of frames that carry
    ``source_path`` and ``file_path``; they apply in order to every way of reading."""

    sources: DataFrame
    chunks: DataFrame
    transformers: tuple[Transformer, ...] = field(default=())

    @classmethod
    def build(cls, sources: DataFrame, chunks: DataFrame, *transformers: Transformer) -> Catalog:
        check_unique(sources, "uri", "source URI")
        check_unique(chunks, "chunk_id", "chunk ID")
        check_unique(chunks, "chunk_uri", "chunk URI")
        return cls(sources, chunks, transformers)

    @classmethod
    def from_documents(cls, documents: DataFrame, *transformers: Transformer) -> Catalog:
        """Chunk addresses are a unique source address plus a fragment unique in it, so one check is enough."""
        check_unique(documents, "uri", "source URI")
        return cls(sources_of(documents), chunks_of(documents), transformers)

    def with_transformer(self, transformer: Transformer) -> Catalog:
        return replace(self, transformers=(*self.transformers, transformer))

    def _transformed(self, df: DataFrame) -> DataFrame:
        for transformer in self.transformers:
            df = df.transform(transformer)
        return df

    def listing(self) -> DataFrame:
        return self.sources.select("uri", "name", "description", "mime_type", "file_path").orderBy("file_path").drop("file_path")

    def documents(self) -> DataFrame:
        """The per-document stream: address, name, text and keywords."""
        return self._transformed(self.sources).select("uri", "name", "content", "keywords")

    def indexed_chunks(self) -> DataFrame:
        """Chunks with transformed text, as they enter the search index."""
        if not self.transformers:
            return self.chunks
        home = self.sources.select(F.col("uri").alias("source_uri"), "file_path")
        joined = self.chunks.join(home, "source_uri", "left")
        return self._transformed(joined).select(*self.chunks.columns)

    def _lookup(self, df: DataFrame, uri: str) -> str | None:
        row = self._transformed(df).select("content").head()
        return None if row is None else row.content

    def read(self, uri: str) -> str:
        """Text behind an address: a document, else a chunk, else a section."""
        found = self._lookup(self.sources.filter(F.col("uri") == uri), uri)
        if found is not None:
            return found
        bases = [uri[:i] for i, char in enumerate(uri) if char == "#"]
        if bases:
            # The source address can only be a prefix that ends before a '#'; this filter reaches the scan.
            near = self.chunks.filter(F.col("source_uri").isin(bases))
            home = self.sources.filter(F.col("uri").isin(bases)).select(F.col("uri").alias("source_uri"), "file_path")
            for candidate in (near.filter(F.col("chunk_uri") == uri), sections(near).filter(F.col("section_uri") == uri)):
                found = self._lookup(candidate.join(home, "source_uri", "left"), uri)
                if found is not None:
                    return found
            if not self.sources.filter(F.col("uri") == bases[0]).isEmpty():
                raise UnknownFragment(f"unknown resource fragment: {uri}")
        raise UnknownResource(f"unknown resource: {uri}")


KINDS = ("document", "chunk", "section")


def read_many(catalog: Catalog, wanted: DataFrame) -> DataFrame:
    """(uri, kind, content) for a table of addresses, with the precedence of a single read.

    ``kind`` is document, chunk, section, unknown fragment or unknown resource. Addresses are settled first, without text: which of those wanted
    there are, and as what. A text then moves once, to the address that is read as it.
    """
    chunks = catalog.chunks.withColumn("section_uri", _section_uri())
    there = (catalog.sources.select("uri"), chunks.select(F.col("chunk_uri").alias("uri")), chunks.select(F.col("section_uri").alias("uri")))
    numbered = reduce(DataFrame.unionByName, (rows.withColumn("n", F.lit(n)) for n, rows in enumerate(there)))
    first = numbered.groupBy("uri").agg(F.min("n").alias("n"))
    chosen = hold_table(wanted.select("uri").distinct().join(first, "uri", "left"), "addresses")

    def read_as(n: int, rows: DataFrame, address: str) -> DataFrame:
        own = chosen.rows.filter(F.col("n") == n).select(F.col("uri").alias(address))
        return rows.join(replace(chosen, rows=own).side(), address)

    # A section of one part has the address of its chunk; the chunk comes first.
    pieces = chunks.filter(F.col("chunk_uri") != F.col("section_uri")).select("source_uri", "section_uri", "part", "content")
    found = (
        read_as(0, catalog.sources.select("uri", "content"), "uri").withColumn("source_uri", F.col("uri")),
        read_as(1, chunks.select("chunk_uri", "content", "source_uri"), "chunk_uri").withColumnRenamed("chunk_uri", "uri"),
        _joined(read_as(2, pieces, "section_uri")).withColumnRenamed("section_uri", "uri"),
    )
    texts = reduce(DataFrame.unionByName, (rows.withColumn("kind", F.lit(kind)) for kind, rows in zip(KINDS, found)))
    if catalog.transformers:
        home = catalog.sources.select(F.col("uri").alias("source_uri"), "file_path")
        texts = catalog._transformed(texts.join(home, "source_uri", "left").drop("source_uri"))
    known = catalog.sources.select(F.col("uri").alias("base"), F.lit(True).alias("known"))
    missing = chosen.rows.filter("n is null").withColumn("base", paths.base_uri(F.col("uri"))).join(known, "base", "left")
    reason = F.when(paths.has_fragment(F.col("uri")) & F.col("known"), "unknown fragment").otherwise("unknown resource")
    unread = missing.select("uri", reason.alias("kind"), F.lit(None).cast("string").alias("content"))
    return texts.select("uri", "kind", "content").unionByName(unread)


def with_home(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks with the source they belong to; an orphan keeps a stub made of its own addresses."""
    home = sources.select(F.col("uri").alias("source_uri"), F.struct("id", "uri", "name", "relative_path").alias("found"))
    stub = F.struct(
        F.col("source_id").alias("id"), F.col("source_uri").alias("uri"), F.lit("").alias("name"), F.lit("").alias("relative_path")
    )
    return chunks.join(home, "source_uri", "left").withColumn("source", F.coalesce("found", stub)).drop("found")


def _section_uri() -> Column:
    return F.concat("source_uri", F.lit("#"), "section_fragment")


def _joined(parts: DataFrame) -> DataFrame:
    return parts.groupBy("source_uri", "section_uri").agg(F.expr(r"listagg(content, '\n\n') within group (order by part)").alias("content"))


def sections(chunks: DataFrame) -> DataFrame:
    """Whole sections: the parts of each joined by a blank line. A group never exceeds one document."""
    return _joined(chunks.withColumn("section_uri", _section_uri()))

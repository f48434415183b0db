"""Corpora derived from the given tables: whole tables, whole texts, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import paths
from docquarry.operators.catalog import Catalog, chunks_of, parse, sources_of
from docquarry.operators.index import SearchIndex, build_index, ranges_for
from docquarry.operators.sizing import spread

SCHEME = "doc"
HEADING_EVERY = 4  # lines
HEADING_WORDS = r"[\p{L}\p{N}]+(?: [\p{L}\p{N}]+){0,2}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heading_of(line: Column, number: Column) -> Column:
    level = 1 + (F.floor(number / HEADING_EVERY) * 2) % 3
    words = F.regexp_extract(line, HEADING_WORDS, 0)
    return F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), F.when(words == "", "Part").otherwise(words))


def as_markdown(text: Column) -> Column:
    """Each line as a paragraph; every fourth line gets a heading made of its first words."""
    pieces = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.when(i % HEADING_EVERY == 0, F.array(heading_of(line, i), line)).otherwise(F.array(line)),
    )
    return F.concat(F.array_join(F.flatten(pieces), "\n\n"), F.lit("\n"))


def as_blocks(text: Column) -> Column:
    """Each line as a Markdown block, of eight kinds in turn, made of its first words."""

    def block(line: Column, i: Column) -> Column:
        found = F.regexp_extract(line, HEADING_WORDS, 0)
        w = F.when(found == "", "Part").otherwise(found)
        kinds = (
            ("```\n", "\n\n", "\n```"), ("- ", "\n- ", "\n\n  end"), ("|a|b|\n|-|-|\n|", "|", "|"), ("<div>\n", " ", "\n</div>"),
            ("", "", "\n---"), ("> ", "\n", ""), ("    ", " ", ""), ("", " ", ""),
        )
        made = [F.concat(F.lit(a), w, F.lit(b), F.when(F.lit(b != ""), w).otherwise(F.lit("")), F.lit(c)) for a, b, c in kinds]
        return F.get(F.array(*made), (i % len(kinds)).cast("int"))

    return F.concat(F.array_join(F.transform(F.split(text, "\n"), block), "\n\n"), F.lit("\n"))


def relative_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("/corpus/"), relative_path()).alias("file_path"),
        relative_path().alias("relative_path"),
        as_markdown(F.col("text")).alias("raw"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(texts(spark, sf_dir), SCHEME).filter("error is null")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing of the corpus: size in bytes and a stand-in for the modification time."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        relative_path().alias("relative_path"),
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 1_000_000_007).alias("mtime_ns"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    parsed = documents(spark, sf_dir)
    return Catalog(sources_of(parsed), chunks_of(parsed))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as search queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def ranged_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Chunks in ranges of their addresses, and the number of ranges. Given texts are moved, once, and parsed where they come to lie."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", paths.source_uri(relative_path(), SCHEME).alias("uri"))
    ranges = ranges_for(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    laid = docs.repartitionByRange(ranges, "uri")
    raw = laid.select("uri", F.concat(F.lit("/corpus/"), relative_path()).alias("file_path"), relative_path().alias("relative_path"), as_markdown(F.col("text")).alias("raw"))
    return chunks_of(parse(raw, SCHEME).filter("error is null"), numbered=True), ranges


def new_index(spark: SparkSession, sf_dir: str, analyzer: str = "en", near: bool = True) -> SearchIndex:
    """Parse and chunk the whole table once, in the order of addresses, and index the chunks."""
    chunks, ranges = ranged_chunks(spark, sf_dir)
    return build_index(chunks, analyzer, buckets=ranges, near=near, ranged=True)


_INDEXES: dict[tuple[str, str, str, bool], SearchIndex] = {}


def index(spark: SparkSession, sf_dir: str, analyzer: str = "plain", near: bool = True) -> SearchIndex:
    """The corpus index, written once per application and data folder; without neighbours for queries that look up exact terms only."""
    key = (spark.sparkContext.applicationId, sf_dir, analyzer)
    if not near and (*key, True) in _INDEXES:
        near = True
    if (*key, near) not in _INDEXES:
        _INDEXES[*key, near] = new_index(spark, sf_dir, analyzer, near)
    return _INDEXES[*key, near]


def linked_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with their anchors as Markdown links, and the link targets that exist."""
    pages = table(spark, sf_dir, "pages")
    markdown = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[$2](../site$1#top)")
    first = F.regexp_extract("html", r'href="(/[^"]*)"', 1)
    targets = pages.select(first.alias("h")).filter("h != ''").distinct()
    return (
        pages.select("page_id", F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_path"), markdown.alias("content")),
        targets.select(F.concat(F.lit("/site"), "h").alias("file_path"), F.concat(F.lit("doc://site"), "h").alias("uri")),
    )

"""The inverted index: a log of segments, each with postings, dictionary, term neighbours and stored chunks as tables.

A full build is one segment, number 0. A refresh appends a segment that holds the chunks of new and changed sources only, and entries for what
they replace: which sources of which segment are dead (``dead``), and the document frequencies these still add to a dictionary (``fading``). Nothing
written before is touched, so an older generation stays readable. Lookups go through all segments and subtract; equal scores are put in the order
of addresses across segments by ``order``, the place of each later source among those of the first segment.

``merged`` folds the log once it has grown: small segments into one, or everything into a new first one.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.analysis import counted_by_term, deletions, term_counts
from docquarry.operators.sizing import Held, hold_table, settled
from docquarry.session import new_location

FIELDS = ("keywords", "heading_path", "source_title", "path_labels", "content")
ARRAY_FIELDS = frozenset({"keywords", "heading_path", "path_labels"})
STORED = (
    "chunk_id", "source_id", "source_uri", "chunk_uri", "source_title", "source_path",
    "heading_path", "start_line", "end_line", "content",
)

FIELD_NUMBER = {name: number for number, name in enumerate(FIELDS)}
BUCKET_BYTES = 1 << 24  # of text in a range of addresses, whose postings the writing and the scoring task sort in memory: some 1.8 million rows
PART_BYTES = 1 << 26  # of chunk text whose terms share a file
#: A chunk's number: its segment, the file it is stored in, and its place there.
FILE_BITS, SEGMENT_BITS = 33, 53
#: Later segments that a lookup may go through, and the share of dead and later chunks, before the log is folded.
MOST_SEGMENTS, MOST_CHANGED = 4, 0.25


def field_texts(chunks: DataFrame, *keys: str) -> DataFrame:
    """One row per chunk and searchable field that has text."""

    def text_of(name: str) -> Column:
        return F.array_join(name, " ") if name in ARRAY_FIELDS else F.col(name)

    pairs = F.array(*(F.struct(F.lit(name).alias("field"), text_of(name).alias("text")) for name in FIELDS))
    return chunks.select(*keys, F.inline(pairs)).filter("text != ''")


def count_postings(texts: DataFrame, analyzer: str, *keys: str) -> DataFrame:
    """Term frequency and field length for every term of a text. Narrow: counted inside each text."""
    counted = texts.select(*keys, term_counts(F.col("text"), analyzer).alias("terms"))
    return counted.select(*keys, F.inline("terms")).withColumnRenamed("total", "field_length")


def postings_of(chunks: DataFrame, analyzer: str = "en") -> DataFrame:
    """(field, term, chunk) with term frequency and field length."""
    return count_postings(field_texts(chunks, "chunk_id"), analyzer, "chunk_id", "field")


def dictionary_of(postings: DataFrame, field: str = "field") -> DataFrame:
    """Document frequency per field and term; counted on the map side first, so hot terms do not pile up."""
    return postings.groupBy(field, "term").agg(F.count(F.lit(1)).alias("df"))


def neighbours_of(dictionary: DataFrame) -> DataFrame:
    """Numbers of terms by the hashes of their one-character deletions, for distance-1 lookups by equality."""
    return deletions(dictionary.select("term").distinct(), "term", "term_no")


def field_number() -> Column:
    numbers = F.create_map(*(F.lit(x) for name, number in FIELD_NUMBER.items() for x in (name, number)))
    return numbers[F.col("field")].cast("tinyint")


def part_of(key: Column, parts: int) -> Column:
    """The part that a term or variant is stored in."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Segment:
    """Tables of one segment as written. ``dead`` names sources replaced or removed since, ``order`` the place of later ones."""

    number: int
    location: str
    buckets: int
    parts: int
    chunk_count: int
    chunks: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    neighbours: DataFrame | None  # none in an index for exact terms only
    dead: Held | None = None
    order: Held | None = None

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows (with ``source_no``) without those of dead sources."""
        return rows if self.dead is None else rows.join(self.dead.side(), "source_no", "left_anti")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows (with chunk_no and source_no) and two numbers that, before chunk_no, put chunks of all segments in the order of their addresses."""
        if self.order is None:
            return rows.withColumns({"order_no": F.col("chunk_no"), "order_sub": F.lit(0).cast("long")})
        return rows.join(self.order.side(), "source_no").withColumnsRenamed({"next_no": "order_no", "seq": "order_sub"})

    def live_chunks(self) -> DataFrame:
        return self.alive(self.chunks)


@dataclass(frozen=True)
class SearchIndex:
    """One index generation. ``chunk_count`` is the collection size of the ranking formula: live chunks only."""

    location: str
    analyzer: str
    chunk_count: int
    segments: tuple[Segment, ...]
    fading: DataFrame | None = None
    in_memory: bool = False

    def over_segments(self, per_segment) -> DataFrame:
        return reduce(DataFrame.unionByName, map(per_segment, self.segments))

    @property
    def near(self) -> bool:
        return all(s.neighbours is not None for s in self.segments)

    @property
    def chunks(self) -> DataFrame:
        """Live chunks with their numbers."""
        return self.over_segments(Segment.live_chunks)

    @property
    def postings(self) -> DataFrame:
        """(chunk_no, source_no, field_no, term, tf, field_length) of live chunks."""
        return self.over_segments(lambda s: s.alive(s.postings.drop("part", "range_no")))

    @property
    def dictionary(self) -> DataFrame:
        """(field_no, term, df) over live chunks."""
        return self.counted(self.over_segments(lambda s: s.dictionary.drop("part")), self.fading)

    def counted(self, entries: DataFrame, fading: DataFrame | None) -> DataFrame:
        """Dictionary entries of all segments as one each, less what dead sources add."""
        if len(self.segments) == 1 and fading is None:
            return entries
        if fading is not None:
            entries = entries.unionByName(fading.select("field_no", "term", (-F.col("df")).alias("df")))
        return entries.groupBy("field_no", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    @property
    def neighbours(self) -> DataFrame:
        """Of an index for near terms too."""
        return self.over_segments(lambda s: s.neighbours.drop("part"))

    def release(self, keep: SearchIndex | None = None) -> None:
        """Free what the index holds in memory, but for segments that ``keep`` reads too. Files stay for readers still at work on them."""
        kept = {s.location for s in keep.segments} if keep else set()
        for segment in self.segments:
            if segment.location not in kept:
                for table in (segment.postings, segment.dictionary, segment.neighbours):
                    if table is not None:
                        table.unpersist()
                segment.chunks.sparkSession.sql(f"DROP TABLE IF EXISTS {table_name(segment.location)}")


def table_name(location: str) -> str:
    return "docquarry_postings_" + hashlib.md5(location.encode()).hexdigest()


def open_postings(spark: SparkSession, location: str, buckets: int) -> DataFrame:
    """The bucketed postings. Spark needs a table definition to know how the files are laid out. A source's number is told by a chunk's place in it."""
    name = table_name(location)
    if not spark.catalog.tableExists(name):
        quoted = location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} (chunk_no BIGINT, nth INT, field_no TINYINT, term STRING, tf INT, field_length INT, range_no INT, part INT) USING parquet "
            f"PARTITIONED BY (part) CLUSTERED BY (range_no) SORTED BY (term, chunk_no) INTO {buckets} BUCKETS LOCATION '{quoted}/postings'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name).withColumn("source_no", F.col("chunk_no") - F.col("nth")).drop("nth")


def ranges_for(spark: SparkSession, octets: int) -> int:
    """Ranges of addresses, and so buckets of postings, for so much text."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(most, max(spark.sparkContext.defaultParallelism, octets // BUCKET_BYTES + 1))


def _range_numbers(spark: SparkSession, buckets: int) -> DataFrame:
    """file_no and range_no, a number that bucketing by hash puts into the bucket file_no; so a bucket holds one range. At most 100,000 rows."""
    numbers = spark.range(32 * buckets).select(F.col("id").cast("int").alias("range_no"))
    return numbers.groupBy(F.pmod(F.hash("range_no"), F.lit(buckets)).alias("file_no")).agg(F.min("range_no").alias("range_no"))


@contextmanager
def _single_files(spark: SparkSession):
    """Scans planned inside give a task one file of chunks, not many."""
    name = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(BUCKET_BYTES // 2))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def write_segment(
    chunks: DataFrame, analyzer: str, location: str, number: int = 0, buckets: int | None = None, parts: int | None = None, near: bool = True, ranged: bool = False
) -> None:
    """Write one segment; its neighbours, several rows for each term, only for searches that are ``near``.

    Chunks are stored in address order and numbered in it, so that a number stands for both
    addresses wherever equal scores are put in order; ``source_no`` is the number of the first chunk
    of the same source. Files of chunks are partitions of their own (``file_no`` is part of a chunk's number).
    Postings are bucketed by the same ranges of addresses: all terms of a document lie in one bucket, so that scoring its chunks and choosing among them
    needs no shuffle, and a term found everywhere is spread evenly. Terms are dealt out to parts by hash, and a part's file is sorted by
    term, so a lookup opens the files of its terms only. The numbers of ranges and parts follow the amount of text. Text is shuffled once, into
    address order, and its terms are counted where its chunks were written; counted terms take some three times its bytes and are not shuffled.
    The input is read three times (summed up, sampled, moved); pass a settled table, not a long computation, or chunks that are ``ranged``: they
    lie in ``buckets`` ranges of ``source_uri``, one a partition, have their place in their source as ``nth``, and are read once.
    """
    spark = chunks.sparkSession
    wanted = chunks.select(*STORED, *(name for name in FIELDS if name not in STORED), *(["nth"] if ranged else []))
    if buckets is None:
        buckets = ranges_for(spark, wanted.agg(F.sum(F.octet_length("content"))).first()[0] or 0)
    if not ranged:
        wanted = wanted.repartitionByRange(buckets, "source_uri")
    in_order = wanted.withColumn("file_no", F.spark_partition_id()).sortWithinPartitions("file_no", "source_uri", "chunk_id")
    numbered = in_order.withColumn("chunk_no", F.monotonically_increasing_id() + F.lit(number << SEGMENT_BITS))
    in_source = W.partitionBy("source_uri").orderBy("chunk_id")  # at most one document, and already together and in order
    # Python between the ranges and here hides from Spark how the chunks lie: a window would move them.
    numbered = numbered.withColumn("source_no", F.col("chunk_no") - F.col("nth") if ranged else F.min("chunk_no").over(in_source)).drop("nth")
    text = Observation()
    observed = numbered.observe(text, F.sum(F.octet_length("content")).alias("octets"))
    observed.write.partitionBy("file_no").option("compression", "zstd").parquet(f"{location}/chunks")
    parts = parts or (text.get["octets"] or 0) // buckets // PART_BYTES + 1

    stored = _stored(spark, location, numbered)
    placed = stored.join(F.broadcast(_range_numbers(spark, buckets)), "file_no", "left").withColumn("range_no", F.coalesce("range_no", "file_no"))
    keys = ("chunk_no", "nth", "range_no")
    texts = field_texts(placed.withColumn("nth", (F.col("chunk_no") - F.col("source_no")).cast("int")), *keys).select(*keys, field_number().alias("field_no"), "text")
    postings = counted_by_term(texts, analyzer).select(
        "chunk_no", "nth", "field_no", "term", "tf", F.col("total").alias("field_length"), "range_no", part_of(F.col("term"), parts).alias("part")
    )
    writer = postings.write.partitionBy("part").bucketBy(buckets, "range_no").sortBy("term", "chunk_no").option("compression", "zstd")
    with _single_files(spark):
        writer.option("path", f"{location}/postings").saveAsTable(table_name(location))

    dictionary = dictionary_of(spark.table(table_name(location)), "field_no").withColumn("part", part_of(F.col("term"), parts))
    dictionary = dictionary.repartitionByRange("part", "term").sortWithinPartitions("part", "term")
    dictionary.write.partitionBy("part").parquet(f"{location}/dictionary")
    if near:
        terms = spark.read.schema(dictionary.schema).parquet(f"{location}/dictionary")
        # Terms are dealt out, not their variants, which are several rows for each of them and never shuffled.
        variants = neighbours_of(terms.select("term").repartition(buckets, "term")).withColumn("part", part_of(F.col("variant"), parts))
        variants.write.partitionBy("part").parquet(f"{location}/neighbours")
    _one_row(spark, near=F.lit(near), analyzer=F.lit(analyzer), number=F.lit(number), buckets=F.lit(buckets), parts=F.lit(parts), chunk_count=F.lit(stored.count()).cast("long")).write.parquet(f"{location}/summary")


def _stored(spark: SparkSession, location: str, like: DataFrame | None = None) -> DataFrame:
    """The chunks of a segment. An empty one has no files that could tell the columns."""
    reader = spark.read if like is None else spark.read.schema(like.schema)
    return reader.parquet(f"{location}/chunks")


_TEXT, _LIST = "string", "array<string>"
CHUNK_TABLE = ", ".join(f"{c} {_LIST if c in ARRAY_FIELDS else 'int' if c.endswith('_line') else _TEXT}" for c in (*STORED, *(f for f in FIELDS if f not in STORED)))
CHUNK_TABLE += ", chunk_no long, source_no long, file_no int"


def open_segment(spark: SparkSession, location: str, in_memory: bool = False) -> Segment:
    summary = spark.read.parquet(f"{location}/summary").first()
    tables = {
        "chunks": spark.read.schema(CHUNK_TABLE).parquet(f"{location}/chunks"),
        "dictionary": spark.read.schema("field_no tinyint, term string, df long, part int").parquet(f"{location}/dictionary"),
        "neighbours": spark.read.schema("term_no long, variant long, part int").parquet(f"{location}/neighbours") if summary.near else None,
        "postings": open_postings(spark, location, summary.buckets),
    }
    if in_memory:
        for name in ("postings", "dictionary", "neighbours") if summary.near else ("postings", "dictionary"):
            tables[name] = tables[name].persist(StorageLevel.MEMORY_AND_DISK)
    return Segment(summary.number, location, summary.buckets, summary.parts, summary.chunk_count, **tables)


def build_index(
    chunks: DataFrame, analyzer: str = "en", location: str | None = None, buckets: int | None = None, in_memory: bool = False, parts: int | None = None,
    near: bool = True,
    ranged: bool = False,
) -> SearchIndex:
    """Write a new index generation of one segment and open it. An older generation is untouched, whatever happens here."""
    spark = chunks.sparkSession
    location = location or new_location(spark, "index")
    write_segment(chunks, analyzer, location, 0, buckets, parts, near, ranged)
    segment = open_segment(spark, location, in_memory)
    _write_log(spark, location, analyzer, segment.chunk_count, [location])
    return SearchIndex(location, analyzer, segment.chunk_count, (segment,), None, in_memory)


def _write_log(spark: SparkSession, location: str, analyzer: str, chunk_count: int, segments: list[str]) -> None:
    """Written last: a generation without it never was."""
    _one_row(spark, analyzer=F.lit(analyzer), chunk_count=F.lit(chunk_count), segments=F.array(*map(F.lit, segments))).write.parquet(f"{location}/log")


def _one_row(spark: SparkSession, **values: Column) -> DataFrame:
    return spark.range(1, numPartitions=1).select(*(value.alias(name) for name, value in values.items()))


DEAD, ORDER = "segment int, source_no long", "segment int, source_no long, source_uri string, next_no long, seq long"
FADING = "segment int, field_no tinyint, term string, df long"


def open_index(spark: SparkSession, location: str, in_memory: bool = False) -> SearchIndex:
    """An index generation, read from its files or kept in executor memory; results are the same."""
    log = spark.read.parquet(f"{location}/log").first()
    segments = tuple(open_segment(spark, s, in_memory) for s in log.segments)
    index = SearchIndex(location, log.analyzer, log.chunk_count, segments, None, in_memory)
    return index if log.segments == [location] else _with_changes(index)


def _with_changes(index: SearchIndex) -> SearchIndex:
    """The index with what its generation says of dead sources, fading terms and the order of later ones."""
    spark = index.segments[0].chunks.sparkSession
    dead, order, fading = (spark.read.schema(schema).parquet(f"{index.location}/{name}") for name, schema in (("dead", DEAD), ("order", ORDER), ("fading", FADING)))
    gone = {r.segment: r.n for r in dead.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per segment
    later = {r.segment: r.n for r in order.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}

    def changed(segment: Segment) -> Segment:
        n = segment.number
        return replace(
            segment,
            dead=Held(dead.filter(F.col("segment") == n).select("source_no"), gone[n]) if n in gone else None,
            order=Held(order.filter(F.col("segment") == n).select("source_no", "next_no", "seq"), later.get(n, 0)) if n else None,
        )

    return replace(index, segments=tuple(map(changed, index.segments)), fading=fading if gone else None)


def refresh_index(index: SearchIndex, fresh: DataFrame, gone: DataFrame, location: str | None = None) -> SearchIndex:
    """A generation in which the chunks ``fresh`` are added and those of the sources ``gone`` (source_uri) are not found any more.

    A changed source is in both. Only the fresh chunks are analysed into postings; of replaced ones, just the dictionary's share is counted again.
    ``fresh`` is read twice.
    """
    spark = index.segments[0].chunks.sparkSession
    location = location or new_location(spark, "index")
    number = index.segments[-1].number + 1
    lost = gone.select("source_uri").distinct()
    lost = hold_table(lost, "gone")
    dying = index.over_segments(lambda s: s.live_chunks().join(lost.side(), "source_uri", "left_semi").withColumn("segment", F.lit(s.number)))
    dying = settled(dying, "dying")
    dead = [dying.filter("chunk_no = source_no").select("segment", "source_no")]
    texts = field_texts(dying, "segment").withColumn("field_no", field_number())
    counted = count_postings(texts.select("segment", "field_no", "text"), index.analyzer, "segment", "field_no")
    fading = [counted.groupBy("segment", "field_no", "term").agg(F.count(F.lit(1)).alias("df"))]
    for segment in index.segments:
        if segment.dead is not None:
            dead.append(segment.dead.rows.select(F.lit(segment.number).alias("segment"), "source_no"))
    if index.fading is not None:
        fading.append(index.fading)
    reduce(DataFrame.unionByName, dead).write.parquet(f"{location}/dead")
    summed = reduce(DataFrame.unionByName, fading).groupBy("segment", "field_no", "term").agg(F.sum("df").alias("df"))
    summed.sortWithinPartitions("term").write.parquet(f"{location}/fading")

    segments = list(index.segments)
    write_segment(fresh, index.analyzer, location, number, near=index.near)
    segments.append(open_segment(spark, location, index.in_memory))
    later_order(segments).write.parquet(f"{location}/order")
    count = index.chunk_count - dying.count() + segments[-1].chunk_count
    _write_log(spark, location, index.analyzer, count, [s.location for s in segments])
    return _with_changes(SearchIndex(location, index.analyzer, count, tuple(segments), None, index.in_memory))


def later_order(segments: list[Segment]) -> DataFrame:
    """Where each source of a later segment belongs: before the chunk ``next_no`` of the first segment, as ``seq`` among its like.

    Source addresses of all segments are sorted by range. A source's next is the first one of the first segment at or after it, in its range or a later
    one; what ranges hand on is one number each. Running minima go from the end backwards: a frame that ends with its partition is computed anew for each
    row, in time that grows with the square of a range.
    """
    first = segments[0].chunks.filter("chunk_no = source_no").select("source_uri", F.col("source_no").alias("first_no"), F.lit(0).alias("segment"), "source_no")
    later = [s.chunks.filter("chunk_no = source_no").select("source_uri", F.lit(None).cast("long").alias("first_no"), F.lit(s.number).alias("segment"), "source_no") for s in segments[1:]]
    heads = reduce(DataFrame.unionByName, later, first).repartitionByRange("source_uri")
    heads = heads.withColumn("range", F.spark_partition_id()).sortWithinPartitions("source_uri", "segment")
    heads = settled(heads.withColumn("at", F.monotonically_increasing_id()), "heads")
    ahead = W.orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = heads.groupBy("range").agg(F.min("first_no").alias("least"))  # a row per task
    ranges = ranges.select("range", F.min("least").over(ahead).alias("beyond"))
    backwards = F.col("source_uri").desc(), F.col("first_no").isNull()
    inside = W.partitionBy("range").orderBy(*backwards).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = heads.withColumn("near", F.min("first_no").over(inside)).join(F.broadcast(ranges), "range").filter("segment > 0")
    nearest = F.coalesce("near", "beyond", F.lit((1 << 63) - 1))
    # Before a chunk of the first segment (whose second number is 0), in the order of addresses.
    return placed.select("segment", "source_no", "source_uri", nearest.alias("next_no"), (F.col("at") - F.lit(1 << 62)).alias("seq"))


def due(index: SearchIndex) -> str:
    """What the log needs: "all" of it in one segment, the "later" ones in one, or nothing."""
    first, *later = index.segments
    if first.dead is None and not later:
        return ""
    return _due(first.chunk_count, [s.chunk_count for s in later], index.segments[-1].number, index.chunk_count)


def _due(first: int, later: list[int], number: int, live: int) -> str:
    """The same for a log of so many chunks in its first and later segments, of which ``live`` are not dead."""
    lost = first + sum(later) - live
    if sum(later) + lost > MOST_CHANGED * first or number >= 1000:
        return "all"
    return "later" if len(later) > MOST_SEGMENTS else ""


def refreshed(index: SearchIndex, fresh: DataFrame, gone: DataFrame) -> SearchIndex:
    """What ``merged`` makes of ``refresh_index``. Where the refresh makes all of the log due, the fresh chunks go into the one segment with the live ones
    at once, not first into a segment of their own that would be indexed, placed among the others and dropped. ``fresh`` is read once more."""
    lost = hold_table(gone.select("source_uri").distinct(), "gone")
    kept = index.over_segments(lambda s: s.live_chunks().join(lost.side(), "source_uri", "left_anti"))
    added, last = fresh.count(), index.segments[-1]
    later = [s.chunk_count for s in index.segments[1:]]
    if _due(index.segments[0].chunk_count, [*later, added], last.number + 1, kept.count() + added) != "all":
        return merged(refresh_index(index, fresh, lost.rows))
    columns = _written_columns(index)
    chunks = kept.select(*columns).unionByName(fresh.select(*columns))
    return build_index(chunks, index.analyzer, new_location(chunks.sparkSession, "index"), None, index.in_memory, near=index.near)


def _written_columns(index: SearchIndex) -> list[str]:
    return [c for c in index.segments[0].chunks.columns if c not in ("chunk_no", "source_no", "file_no")]


def merged(index: SearchIndex, what: str | None = None) -> SearchIndex:
    """The same chunks with a shorter log, as a new generation; the index itself while nothing is due. Readers of the old one are not disturbed."""
    what = due(index) if what is None else what
    spark = index.segments[0].chunks.sparkSession
    columns = _written_columns(index)
    if what == "all":
        return build_index(index.chunks.select(*columns), index.analyzer, new_location(spark, "index"), None, index.in_memory, near=index.near)
    if what != "later":
        return index
    first, *later = index.segments
    location, number = new_location(spark, "index"), later[-1].number + 1
    live = reduce(DataFrame.unionByName, (s.live_chunks() for s in later)).select(*columns)
    write_segment(live, index.analyzer, location, number, near=index.near)
    segments = [first, open_segment(spark, location, index.in_memory)]
    later_order(segments).write.parquet(f"{location}/order")
    dead = first.dead.rows if first.dead is not None else spark.createDataFrame([], "source_no long")
    dead.select(F.lit(0).alias("segment"), "source_no").write.parquet(f"{location}/dead")
    fading = index.fading if index.fading is not None else spark.createDataFrame([], FADING)
    fading.filter("segment = 0").write.parquet(f"{location}/fading")
    _write_log(spark, location, index.analyzer, index.chunk_count, [s.location for s in segments])
    return _with_changes(SearchIndex(location, index.analyzer, index.chunk_count, tuple(segments), None, index.in_memory))

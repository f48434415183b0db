"""A log of index segments ranks like one index of the same chunks, and lookups open few files."""

import bisect
import os
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docquarry.operators import index as idx
from docquarry.operators import search as srch
from docquarry.operators.page import search_pages
from docquarry.operators.sizing import hold_local, hold_table
from docquarry.plans import corpus
from docquarry.settings import CONTENT, SearchSettings
from tests.test_search import chunks_of

SF_DIR = "/root/testdata/sf0.01"
BEFORE = {
    "b/kelp": "# Kelp\n\nKelp forests shelter otters.\n\n## Holdfast\n\nIt grips stone.\n",
    "d/limpet": "# Limpet\n\nA limpet grazes stone.\n\n## Shell\n\nThe shell is a low cone of stone grey.\n",
    "f/otter": "# Otter\n\nOtters crack shells on stone.\n",
    "h/urchin": "# Urchin\n\nUrchins graze kelp forests bare.\n",
}
CHANGES = [
    ({"a/anemone": "# Anemone\n\nAn anemone clings to stone.\n", "d/limpet": "# Limpet\n\nA limpet returns to its scar.\n\n## Radula\n\nTeeth like stone.\n"}, ()),
    ({"e/mussel": "# Mussel\n\nA mussel clings to stone.\n", "z/whelk": "# Whelk\n\nA whelk drills shells.\n"}, ("f/otter",)),
    ({"d/limpet": "# Limpet\n\nStone stone stone.\n", "c/gull": "# Gull\n\nA gull clings to stone.\n"}, ("a/anemone",)),
    ({}, ("z/whelk",)),
]
QUERIES = ["stone", "clings to stone", "kelp forest", "shels", "limpit scar", "*", "anemone whelk", "otters"]


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def everything(spark, index, **more):
    ranked = srch.candidates(index, asked(spark), limit=50, **more)
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in ranked.collect())


@pytest.fixture(scope="module")
def history(spark):
    """(index, texts) after every change."""
    texts, index = dict(BEFORE), idx.build_index(chunks_of(spark, BEFORE), buckets=3, parts=4)
    made = [(index, dict(texts))]
    for fresh, lost in CHANGES:
        gone = [f"doc://{n}" for n in (*fresh, *lost)]
        rows = chunks_of(spark, fresh) if fresh else chunks_of(spark, BEFORE).limit(0)
        index = idx.refresh_index(index, rows, spark.createDataFrame([(g,) for g in gone], "source_uri string"))
        texts = {k: v for k, v in {**texts, **fresh}.items() if k not in lost}
        made.append((index, dict(texts)))
    return made


def test_segments_rank_like_a_rebuild(spark, history):
    index, texts = history[-1]
    whole = idx.build_index(chunks_of(spark, texts), buckets=2)
    assert index.chunk_count == whole.chunk_count == index.chunks.count()
    columns = ("field_no", "term", "df")
    assert sorted(index.dictionary.select(*columns).collect()) == sorted(whole.dictionary.select(*columns).collect())
    expected = everything(spark, whole)
    assert everything(spark, index) == expected
    assert everything(spark, idx.open_index(spark, index.location)) == expected
    settings = replace(SearchSettings(), result_mode=CONTENT)
    pages = [[tuple(r) for r in search_pages(i, asked(spark), settings).orderBy("query_id", "position").collect()] for i in (index, whole)]
    assert pages[0] == pages[1] and pages[0]


def test_folding_the_log_changes_nothing(spark, history):
    index, texts = history[-1]
    later = idx.merged(index, "later")
    assert everything(spark, later) == everything(spark, idx.merged(index, "all"))
    mussel = chunks_of(spark, {"e/mussel": BEFORE["f/otter"]})
    again = idx.refresh_index(later, mussel, spark.createDataFrame([("doc://e/mussel",)], "source_uri string"))
    assert everything(spark, again) == everything(spark, idx.build_index(chunks_of(spark, {**texts, "e/mussel": BEFORE["f/otter"]})))


def test_a_refresh_that_folds_the_log_writes_one_segment(spark, history, monkeypatch):
    """The fresh chunks used to become a segment of their own first, which the fold read and dropped."""
    written, write = [], idx.write_segment
    index, texts = history[-1]
    fresh = {"e/mussel": BEFORE["f/otter"], "y/kelp": BEFORE["b/kelp"]}
    gone = spark.createDataFrame([("doc://e/mussel",), ("doc://y/kelp",), ("doc://b/kelp",), ("doc://b/kelp",), (None,)], "source_uri string")
    left = {k: v for k, v in {**texts, **fresh}.items() if k != "b/kelp"}
    expected = everything(spark, idx.build_index(chunks_of(spark, left)))
    monkeypatch.setattr(idx, "write_segment", lambda *args, **more: written.append(args) or write(*args, **more))
    folded = idx.refreshed(index, chunks_of(spark, fresh), gone)
    assert len(written) == len(folded.segments) == 1 and everything(spark, folded) == expected
    assert idx.refreshed(folded, chunks_of(spark, fresh).limit(0), gone.limit(0)).chunk_count == folded.chunk_count
    monkeypatch.setattr(idx, "MOST_CHANGED", 9.0)  # nothing due: a segment more
    monkeypatch.setattr(idx, "MOST_SEGMENTS", 9)
    appended = idx.refreshed(index, chunks_of(spark, fresh), gone)
    assert len(appended.segments) == len(index.segments) + 1 and everything(spark, appended) == expected


def test_a_refresh_writes_the_postings_of_what_changed(spark, history):
    (before, _), (after, _) = history[:2]
    assert [s.location for s in after.segments[:-1]] == [s.location for s in before.segments]
    written = {r.chunk_id for r in after.segments[-1].postings.join(after.segments[-1].chunks, "chunk_no").select("chunk_id").collect()}
    assert written == {"doc://a/anemone#anemone", "doc://d/limpet#limpet", "doc://d/limpet#radula"}
    assert everything(spark, before) == everything(spark, idx.build_index(chunks_of(spark, BEFORE)))  # older readers are not disturbed


def test_the_log_is_folded_when_due(spark, history, monkeypatch):
    first, last = history[0][0], history[-1][0]
    assert idx.due(first) == "" and idx.merged(first) is first and idx.due(last) == "all" and len(idx.merged(last).segments) == 1
    monkeypatch.setattr(idx, "MOST_CHANGED", 9.0)
    assert idx.due(last) == "" and idx.merged(last) is last
    monkeypatch.setattr(idx, "MOST_SEGMENTS", 2)
    assert idx.due(last) == "later" and [s.number for s in idx.merged(last).segments] == [0, 5]


def test_lookups_open_only_files_that_hold_something(spark):
    texts = {f"n{i:03}": f"# T{i}\n\nword{i} common\n" for i in range(120)}
    (segment,) = idx.build_index(chunks_of(spark, texts).repartition(6), buckets=2, parts=64).segments
    opened = segment.postings.withColumn("file", F.col("_metadata.file_path"))
    for count in (1, 2000):  # the same plan at any count
        terms = spark.range(7, 7 + count).select(F.lit(4).cast("tinyint").alias("field_no"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("term"))
        place = idx.part_of(F.col("term"), segment.parts)
        found = srch.found_in(opened, "part", place, hold_table(terms, "wanted"), ["field_no", "term"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruningexpression" in plan and "BroadcastHashJoin" in plan
        assert found.count() == min(count, 113)
        if count == 1:
            (part,) = terms.select(place).first()
            assert all(f"part={part}/" in r.file for r in found.collect())
    local = hold_local(terms.limit(1), "wanted")
    plan = srch.found_in(segment.postings, "part", place, local, ["field_no", "term"])._jdf.queryExecution().executedPlan().toString()
    assert "(part#" in plan.split("PartitionFilters")[1][:200]  # named when the query is planned


def test_no_shuffle_before_the_choice(spark, history):
    """Scoring and the cap per source stay in the buckets: only the leading rows of each task are exchanged."""
    index = history[0][0]
    looked_up = srch.leaves(index, asked(spark), SearchSettings().boosts())
    scored = srch.scores(index, looked_up, 1)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" in plan


def test_capped_lists_merge_exactly(spark):
    rows = [(0, n, n % 7, float((n * 37) % 50)) for n in range(300)]
    scored = spark.createDataFrame(rows, "query_id long, chunk_no long, source_no long, score double")
    one = [(r.chunk_no, r["rank"]) for r in srch.best(srch.capped(scored.coalesce(1), 2), 9).orderBy("rank").collect()]
    many = [(r.chunk_no, r["rank"]) for r in srch.best(srch.capped(scored.repartition(11), 2), 9).orderBy("rank").collect()]
    assert one == many


def test_later_sources_are_placed_in_one_pass(spark):
    """A frame that ends with its partition takes the square of a range's sources: 99 s for 51,282 of them."""

    def segment(number, names):
        rows = [(f"doc://{n:05}", n + (number << 53), n + (number << 53)) for n in names]
        return SimpleNamespace(number=number, chunks=spark.createDataFrame(rows, "source_uri string, source_no long, chunk_no long"))

    first, later = list(range(0, 900, 3)), {1: list(range(0, 1000, 7)), 2: list(range(1, 1000, 11))}
    order = idx.later_order([segment(0, first), *(segment(k, names) for k, names in later.items())])
    assert "unboundedfollowing" not in order._jdf.queryExecution().executedPlan().toString().lower()
    nexts = {(r.segment, r.source_uri): r.next_no for r in order.collect()}
    beyond = [*first, (1 << 63) - 1]
    assert nexts == {(k, f"doc://{n:05}"): beyond[bisect.bisect_left(first, n)] for k, names in later.items() for n in names}


def test_text_is_shuffled_once_and_ranges_keep_to_their_bucket(spark):
    """Text used to be written as parsed documents, moved into the order of addresses, and moved again into buckets."""
    status = spark._jsc.sc().statusStore()

    def stages():
        rows = status.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {(r.stageId(), r.attemptId()): r.shuffleWriteBytes() for r in (rows.apply(i) for i in range(rows.size()))}

    before = stages()
    index = corpus.new_index(spark, SF_DIR, "plain", near=False)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    given = os.path.getsize(f"{SF_DIR}/documents.parquet")
    moved = [size for stage, size in stages().items() if stage not in before and size > given / 2]
    assert len(moved) == 1
    (segment,) = index.segments
    bucket = F.pmod(F.hash("range_no"), F.lit(segment.buckets)).alias("bucket")
    held = segment.postings.groupBy(bucket, "range_no").agg(F.min("source_no").alias("a"), F.max("source_no").alias("b")).orderBy("a").collect()
    assert len({r.bucket for r in held}) == len(held) == segment.buckets and all(x.b < y.a for x, y in zip(held, held[1:]))


def test_chunks_that_lie_in_ranges_are_numbered_like_others(spark):
    chunks, ranges = corpus.ranged_chunks(spark, SF_DIR)
    columns = [c for c in chunks.columns if c != "nth"]
    settled = corpus.catalog(spark, SF_DIR).chunks
    assert chunks.select(*columns).exceptAll(settled.select(*columns)).isEmpty() and chunks.count() == settled.count()
    made = [idx.build_index(chunks, "plain", buckets=ranges, near=False, ranged=True), idx.build_index(settled, "plain", buckets=3, near=False)]
    orders = [[(r.chunk_id, r.chunk_no - r.source_no) for r in index.chunks.orderBy("chunk_no").collect()] for index in made]
    assert orders[0] == orders[1] and len(orders[0]) == made[0].chunk_count

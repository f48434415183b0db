"""A streamed index equals one build of the same documents, goes on where it ended, and takes no batch in twice."""


from docquarry.operators import index as idx
from docquarry.operators import search as srch
from docquarry.operators.index import build_index
from docquarry.plans import queries
from docquarry.streaming import ingest
from tests.test_search import chunks_of

SCHEMA = "file_path string, relative_path string, raw string, version long"


def put(spark, folder, rows):
    rows = [(f"/c/{name}.md", f"{name}.md", raw, version) for name, raw, version in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/inbox")


def follow(spark, folder):
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/inbox")
    ingest.follow(arriving, folder).awaitTermination()
    return ingest.streamed_index(spark, folder)


def hits(index):
    return [(r.chunk_id, r.score) for r in srch.search(index, "tide pool crab").collect()]


def test_streamed_index(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, [("crab", "# Crab\n\nA crab hides.\n", 1), ("tide", "# Tide\n\nTide pool.\n", 1), ("crab", "# Crab\n\nOld crab crab.\n", 0)])
    first = follow(spark, folder)
    assert hits(first) == hits(build_index(chunks_of(spark, {"crab": "# Crab\n\nA crab hides.\n", "tide": "# Tide\n\nTide pool.\n"})))
    put(spark, folder, [("tide", "# Tide\n\nThe tide turns.\n", 2), ("pool", "# Pool\n\nA pool with a crab.\n", 1)])
    put(spark, folder, [("crab", None, 3)])
    last = follow(spark, folder)
    assert hits(last) == hits(build_index(chunks_of(spark, {"tide": "# Tide\n\nThe tide turns.\n", "pool": "# Pool\n\nA pool with a crab.\n"})))
    batch, location = ingest.current_generation(spark, folder)
    ingest.take_in(spark.createDataFrame([("/c/x.md", "x.md", "crab", 9)], SCHEMA), batch, folder, "doc")  # replayed
    assert ingest.current_generation(spark, folder) == (batch, location) == (2, last.location)


def test_nothing_has_come(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    assert follow(spark, str(tmp_path)) is None


def test_latest_of_a_batch(spark):
    rows = [("a", "a.md", "1", 1), ("a", "a.md", "2", 2), ("a", "a.md", None, None), ("b", "b.md", "x", 1), ("b", "b.md", "y", 1)]
    got = {r.relative_path: r.raw for r in ingest.latest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a.md": "2", "b.md": "y"}


def test_the_corpus_arrives_in_files_of_many_tasks(spark, tmp_path, monkeypatch):
    """Each of the three batches was written, and so read, by a single task before."""
    monkeypatch.setattr(queries, "new_location", lambda *_: str(tmp_path))
    assert queries.streamed_search(spark, "/root/testdata/sf0.001").count()
    assert len(list((tmp_path / "inbox").glob("*.parquet"))) >= 3 * spark.sparkContext.defaultParallelism
    assert ingest.current_generation(spark, str(tmp_path))[0] == 2


def test_a_batch_is_indexed_once(spark, tmp_path, monkeypatch):
    """A batch that makes the log due was written as a segment, and then again with all others."""
    written, write = [], idx.write_segment
    monkeypatch.setattr(idx, "write_segment", lambda *args, **more: written.append(args) or write(*args, **more))
    spark.createDataFrame([], ingest.GENERATIONS).write.parquet(f"{tmp_path}/generations")
    for batch, name in enumerate(("crab", "tide", "pool")):
        rows = [(f"/c/{name}.md", f"{name}.md", f"# {name}\n\nA crab in a tide pool.\n", 1)]
        ingest.take_in(spark.createDataFrame(rows, SCHEMA), batch, str(tmp_path), "doc")
    assert len(written) == 3 and hits(ingest.streamed_index(spark, str(tmp_path))) == hits(
        build_index(chunks_of(spark, {name: f"# {name}\n\nA crab in a tide pool.\n" for name in ("crab", "tide", "pool")}))
    )

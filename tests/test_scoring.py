import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.functions import analysis, scoring
from docquarry.operators import search as srch
from docquarry.operators.catalog import Catalog, parse
from docquarry.operators.index import build_index, neighbours_of
from docquarry.operators.sizing import hold_table
from docquarry.plans import corpus
from docquarry.settings import SearchSettings


def many(spark, documents=120):
    rows = [(f"/c/{i}.md", f"{i}.md", f"# Page {i}\n\ncommon {'rare ' * (i % 7)}\n\n## Other\n\ncommon words {i % 11}\n") for i in range(documents)]
    chunks = Catalog.from_documents(parse(spark.createDataFrame(rows, "file_path string, relative_path string, raw string"), "doc")).chunks
    return build_index(chunks, "plain", buckets=3)


def asked(spark, number=40):
    return spark.createDataFrame([(i, f"common rare words {i}") for i in range(number)], "query_id long, query string")


def test_tasks_send_the_leading_rows_only(spark):
    """240 chunks match each query; a task sends five rows of them, and what it was sent itself does not depend on the number of queries."""
    index = many(spark)
    few, more = (srch.leaves(index, asked(spark, n), SearchSettings().boosts()) for n in (1, 40))
    found = srch.scores(index, more, 0, 5)
    sizes = found.groupBy(F.spark_partition_id(), "query_id").count()
    assert sizes.agg(F.max("count")).first()[0] <= 5
    every = srch.scores(index, more)
    assert every.count() == 40 * 240
    top = [[tuple(r) for r in srch.best(s, 5).select("query_id", "chunk_no", "score", "rank").orderBy("query_id", "rank").collect()] for s in (found, every)]
    assert top[0] == top[1] and len(top[0]) == 200
    assert srch.scores(index, few).count() == 240


def test_a_lookup_in_slices_finds_the_same(spark, monkeypatch):
    index = many(spark, 30)
    looked_up = srch.leaves(index, asked(spark, 9), SearchSettings().boosts())
    whole = sorted(map(tuple, srch.scores(index, looked_up, 1, 4).collect()))
    monkeypatch.setattr(srch, "LEAVES", 7)
    assert sorted(map(tuple, srch.scores(index, looked_up, 1, 4).collect())) == whole


def test_counts_of_clauses_are_those_of_their_matches(spark):
    index, fields = many(spark, 30), ("heading_path", "content")
    found = srch.clause_matches(index, asked(spark, 5), fields).groupBy("query_id", "field").agg(F.count(F.lit(1)).alias("any"), F.count_if("every_term").alias("all"))
    counts = srch.clause_counts(index, asked(spark, 5), fields)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, counts.select("query_id", "field", "any", "all").collect()))


def test_leading_rows_with_ties_and_caps(monkeypatch):
    monkeypatch.setattr(scoring, "PENDING", 10)
    rng = np.random.default_rng(7)
    total = rng.integers(0, 6, (3, 90)).astype(float)
    chunk, group = np.arange(90), np.arange(90) // 4
    for cap in (0, 1, 2):
        kept = scoring.Leading(3, 5, cap)
        for a in range(0, 90, 8):
            part = slice(a, a + 8)
            kept.add(chunk[part], group[part], total[:, part], total[:, part] > 0)
        rows = list(zip(*(x.tolist() for x in kept.choose())))
        for q in range(3):
            want, taken = [], {}
            for c in sorted(np.flatnonzero(total[q]).tolist(), key=lambda c: (-total[q, c], c)):
                taken[group[c]] = taken.get(group[c], 0) + 1
                if not cap or taken[group[c]] <= cap:
                    want.append(c)
            assert [c for n, c, _, _ in rows if n == q] == want[:5]


def test_blocks_hold_whole_chunks(monkeypatch):
    monkeypatch.setattr(scoring, "ROWS", 5)
    chunk = np.repeat(np.arange(9), [1, 7, 2, 1, 1, 9, 3, 1, 2]) * 10
    rows = [chunk, chunk // 20, np.arange(len(chunk)), np.ones(len(chunk))]
    batches = (pa.RecordBatch.from_arrays([pa.array(x[i : i + 4]) for x in rows], names=list("abcd")) for i in range(0, len(chunk), 4))
    found = list(scoring.blocks(batches, 2))
    assert np.concatenate([b[0] for b in found]).tolist() == list(range(0, 90, 10)) and max(len(b[0]) for b in found) <= 2
    assert np.concatenate([b[3] for b in found]).tolist() == list(range(len(chunk)))
    assert np.concatenate([b[0][b[2]] for b in found]).tolist() == chunk.tolist()


def test_an_index_for_exact_terms_has_no_neighbours(spark):
    rows = [("/c/a.md", "a.md", "# One\n\ncommon words\n")]
    chunks = Catalog.from_documents(parse(spark.createDataFrame(rows, "file_path string, relative_path string, raw string"), "doc")).chunks
    index = build_index(chunks, "plain", buckets=3, near=False)
    assert index.segments[0].neighbours is None
    found = srch.candidates(index, asked(spark, 1), fuzziness=lambda field: 0)
    assert found.count() == 1
    with pytest.raises(ValueError, match="exact terms"):
        srch.candidates(index, asked(spark, 1))


def test_an_index_leaves_no_parsed_documents_and_moves_no_variants(spark, monkeypatch):
    frame, made, ranged = type(spark.range(1)), [], []
    ranges, settle = frame.repartitionByRange, corpus.settled
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *by: ranged.append(by) or ranges(self, *by))
    monkeypatch.setattr(corpus, "settled", lambda df, label: made.append(settle(df, label)) or made[-1])
    index = corpus.new_index(spark, "/root/testdata/sf0.001", "plain")
    (path,) = {os.path.dirname(f) for f in made[0].inputFiles()}
    assert not os.path.exists(path.removeprefix("file://"))
    assert ranged == [("source_uri",), ("part", "term")]
    assert not index.neighbours.exceptAll(neighbours_of(index.dictionary)).count() and not neighbours_of(index.dictionary).exceptAll(index.neighbours).count()


def a_plan(queries, terms, weight=0.01, seed=3):
    """Each query asks for ``terms`` terms in two fields, of which each is one of two index terms; keys 0 to 49."""
    rng = np.random.default_rng(seed)
    rows = [
        (q, f, t, 1 + t % 3, 2 * terms, 2, weight * rng.random(), key)
        for q in range(queries) for f in (1, 4) for t in range(terms) for key in rng.choice(50, 2, replace=False).tolist()
    ]
    names = ("query_id", "field_no", "term_no", "repeats", "token_count", "leaf_count", "leaf_weight", "key")
    return rows, scoring.plan_of(pa.table(dict(zip(names, map(list, zip(*rows))))), 2, True)


def exact(values):
    """``exact_sum``, by whole numbers."""
    units = sum(int(x) * 2**26 + int(np.rint((v * 2.0**20 - x) * 2.0**26)) for v in values for x in [np.floor(v * 2.0**20)])
    return units / 2**46


@pytest.mark.parametrize("weight", [0.01, 1e4])  # the latter's sums of units do not fit one number
def test_scores_of_a_block_are_exact_sums_of_its_matches(weight):
    rows, plan = a_plan(3, 4, weight)
    rng = np.random.default_rng(5)
    chunk = np.repeat(np.arange(6), 9)
    key, base = np.concatenate([rng.choice(np.intersect1d(plan.keys, np.arange(50)), 9, replace=False) for _ in range(6)]), rng.random(54)
    score, matched = scoring.field_scores(plan, chunk, key, base, 7)
    assert score.shape == matched.shape == (6, 7) and not matched[:, 6].any()
    for at, (q, f) in enumerate((q, f) for q in range(3) for f in (1, 4)):
        for c in range(6):
            there = dict(zip(key[chunk == c].tolist(), base[chunk == c].tolist()))
            terms = {}
            for _, _, t, repeats, tokens, count, w, k in (r for r in rows if r[:2] == (q, f) and r[7] in there):
                terms.setdefault((t, repeats, tokens, count), []).append(there[k] * w)
            asked = sum(r for _, r, _, _ in terms)
            total = exact(r * (exact(v) * len(v) / n) for (_, r, _, n), v in terms.items())
            assert matched[at, c] == asked and score[at, c] == total * asked / 8


def test_a_block_works_on_matches_not_on_all_cells():
    """Sums, shares and parts of all cells of query terms by chunks, nearly all of them empty, took most of the time of a fuzzy search."""
    _, plan = a_plan(40, 200)
    width = plan.width
    chunk, key = np.arange(width), np.resize(plan.keys[:1], width)
    tracemalloc.start()
    scoring.field_scores(plan, chunk, key, np.ones(width), width)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * width * len(plan.repeats)


def test_counted_terms_come_in_runs_by_term(spark, monkeypatch):
    """Terms used to come text by text, so that writing the postings sorted them from scratch."""
    texts = [(n, n % 5, f"w{n % 7} Common w{n % 7} É{n % 3}-x 日本 common" if n % 6 else None) for n in range(90)]
    rows = spark.createDataFrame(texts, "n long, f int, text string").coalesce(1)
    found = [tuple(r) for r in analysis.counted_by_term(rows, "plain").collect()]
    counts = rows.select("n", "f", F.inline(analysis.term_counts(F.col("text"), "plain"))).collect()
    assert found == sorted(map(tuple, counts), key=lambda r: (r[2].encode(), r[0])) and len(found) == 75 * 5
    schema = pa.schema([("n", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("total", pa.int32())])
    batches = [pa.RecordBatch.from_pydict({"n": [n], "text": [text]}) for n, _, text in texts if text]
    for name in ("RUN_ROWS", "RUN_BYTES"):  # what a task holds is bounded
        with monkeypatch.context() as m:
            m.setattr(analysis, name, 60)
            runs = [[tuple(r.values()) for r in b.to_pylist()] for b in analysis._term_runs("plain", schema, iter(batches))]
        assert len(runs) > 3 and all(run == sorted(run, key=lambda r: (r[1].encode(), r[0])) for run in runs)
        assert sorted(r for run in runs for r in run) == sorted((n, *rest) for n, _, *rest in found)


def test_batches_of_scoring_are_bounded_by_their_rows(spark):
    """Spark added up a batch's bytes anew for every posting, in some 1.4 microseconds each."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []

    def hold(df, label):
        if label == "ranked":
            seen.append(spark.conf.get(name, None))
        return hold_table(df, label)

    index, asked_ = many(spark, 3), asked(spark, 1)
    srch.candidates(index, asked_, hold=hold)
    assert seen == [str((1 << 31) - 1)] and spark.conf.get(name, None) is None
    spark.conf.set(name, "1000000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")  # nothing else bounds a batch
    try:
        srch.candidates(index, asked_, hold=hold)
        assert seen[1:] == ["1000000"] == [spark.conf.get(name)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset(name)

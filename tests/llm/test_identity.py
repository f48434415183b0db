"""Documents that share a doc_id but not a text lose nothing for it, in the operators and in the pipeline's stages."""

import numpy as np
import pytest

from docquarry.llm import fmindex, suffixes

RNG = np.random.default_rng(21)


def prose(n):
    return " ".join(f"w{x}" for x in RNG.integers(0, 5000, n))


A, B, C = prose(90), prose(80), prose(70)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(2)


@pytest.mark.parametrize("operator, left", [(suffixes, {(1, A), (2, ""), (2, B), (2, ""), (None, C)}), (fmindex, {(1, ""), (2, ""), (2, B), (None, C)})])
def test_unrepeated_text_stays(spark, operator, left):
    rows = operator.deduplicated(table(spark, (1, A), (2, A), (2, B), (2, None), (None, C))).collect()
    assert len(rows) == 5 and {(r.doc_id, bytes(r.text).decode()) for r in rows} == left


def test_repeated_rows_are_one_document(spark):
    rows = suffixes.deduplicated(table(spark, (1, A), (1, A), (1, B)), carry=("source",)).collect()
    assert sorted((r.doc_id, bytes(r.text).decode(), r.source) for r in rows) == sorted([(1, A, "s"), (1, A, "s"), (1, B, "s")])


def test_near_duplicates_keep_unlike_texts(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, (1, A), (2, A), (2, B), (2, B), (3, C), (None, C), (None, C))
    kept = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, A), (2, B), (3, C), (None, C), (None, C)], key=str)
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0

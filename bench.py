"""Headline timings over the given tables; prints one JSON line.

Build: parse, chunk and index the whole document table into files. Search: batches of queries
against that index, each batch in one plan, ranked lists of ten written out. Every part runs
once on the smallest data first, so that interpreter and code generation start-up is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from docquarry.operators import search as ranked_search  # noqa: E402
from docquarry.operators.page import search_pages  # noqa: E402
from docquarry.plans import corpus  # noqa: E402
from docquarry.plans.queries import REGISTRY  # noqa: E402
from docquarry.session import build_session  # noqa: E402
from docquarry.settings import SearchSettings  # noqa: E402

CPUS = int(os.environ.get("BENCH_CPUS", "8"))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
# The query rotation of the published baseline.
ROTATION = ("authentication", "how do i configure the search index", "token rotation", "content directory layout")
TABLE_QUERIES = ("source_listing", "chunk_catalog", "read_section", "link_rewrite", "content_digests", "listing_changes", "postings", "dictionary")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def titles(spark, sf_dir):
    """Each document's first three words as a query of its own."""
    first = F.regexp_extract("text", corpus.HEADING_WORDS, 0)
    return corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), first.alias("query"))


def run(spark, sf_dir: str) -> tuple[dict[str, float], dict[str, float]]:
    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    for name in TABLE_QUERIES:
        timed(name, lambda: consume(REGISTRY[name](spark, sf_dir)))
    index = timed("index_build_disk", lambda: corpus.new_index(spark, sf_dir))
    settings, by_title = SearchSettings(), titles(spark, sf_dir)
    passages = corpus.queries_of(spark, sf_dir)
    query_count, passage_count = by_title.count(), passages.count()
    timed("search_titles_exact", lambda: consume(ranked_search.candidates(index, by_title, settings, 10, lambda field: 0)))
    timed("search_passages", lambda: consume(ranked_search.candidates(index, passages, settings, 10)))
    rotation = spark.createDataFrame(list(enumerate(ROTATION)), "query_id long, query string")
    timed("search_pages_rotation", lambda: consume(search_pages(index, rotation, settings)))
    timed("search_single", lambda: ranked_search.search(index, ROTATION[2], settings).collect())
    rates = {
        "chunks": index.chunk_count,
        "build_chunks_per_sec": round(index.chunk_count / seconds["index_build_disk"], 1),
        "title_queries": query_count,
        "exact_title_queries_per_sec": round(query_count / seconds["search_titles_exact"], 1),
        "passage_queries": passage_count,
        "fuzzy_passage_queries_per_sec": round(passage_count / seconds["search_passages"], 1),
    }
    return seconds, rates


def main() -> None:
    spark = build_session(
        "docquarry-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, WARM_DIR)
    seconds, rates = run(spark, SF_DIR)
    result = {
        "metric": "document analytics: total of build and search batches",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rates": rates,
        "setup": {"cores": CPUS, "shuffle_partitions": CPUS, "index": "parquet files, not cached", "state": "warm"},
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

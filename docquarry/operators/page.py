"""The result page: the best matches, few of each source, and its text form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.paths import breadcrumb
from docquarry.operators.index import SearchIndex
from docquarry.operators.search import (
    Fuzziness,
    Hold,
    field_fuzziness,
    leaves,
    ranked_candidates,
    with_stored,
)
from docquarry.operators.sizing import hold_table
from docquarry.settings import CONTENT, REFERENCES, SearchSettings

def source_cap(mode: str) -> int:
    return 1 if mode == REFERENCES else 2


def _two_decimals(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v:.2f}" for v in values.to_pylist()], pa.string())


def two_decimals(value: Column) -> Column:
    """Two decimals of the exact binary value; the JVM's own formatting rounds its decimal print instead."""
    return F.arrow_udf(_two_decimals, T.StringType())(value)


def hit_text(mode: str) -> Column:
    head = F.concat(F.lit("- **"), "source_title", F.lit("** · ["), "chunk_uri", F.lit("]("), "chunk_uri", F.lit(")\n"))
    lines = F.concat(F.lit(" · lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    place = F.concat(F.lit("  - "), breadcrumb(F.col("source_path"), F.col("heading_path")), lines)
    score = F.concat(F.lit(" · score "), two_decimals(F.col("score")), F.lit("\n"))
    extract = F.concat(F.lit("  - "), "snippet", F.lit("\n"))
    body = F.concat(F.lit("\n"), "content", F.lit("\n")) if mode == CONTENT else F.lit("")
    return F.concat(head, place, score, extract, body, F.lit("\n"))


def nothing_found() -> Column:
    return F.concat(F.lit("No results found for '"), "query", F.lit("'"))


def page_text(queries: DataFrame, page: DataFrame, mode: str) -> DataFrame:
    """(query_id, page) for every query; a page holds at most the requested number of results."""
    lines = page.select("query_id", "position", hit_text(mode).alias("line"))
    bodies = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("hits"))
    joined = queries.join(bodies, "query_id", "left")
    body = F.array_join(F.transform("hits", lambda h: h["line"]), "")
    found = F.concat(F.lit("Search results for '"), "query", F.lit("':\n\n"), body)
    return joined.select("query_id", F.when(F.col("hits").isNull(), nothing_found()).otherwise(found).alias("page"))


def search_pages(
    index: SearchIndex, queries: DataFrame, settings: SearchSettings, fuzziness: Fuzziness = field_fuzziness, hold: Hold = hold_table
) -> DataFrame:
    """Result pages of many queries, chosen from all matches: one chunk of a source (references) or two."""
    looked_up = leaves(index, queries, settings.boosts(), fuzziness, hold)
    chosen = ranked_candidates(index, queries, looked_up, settings.max_results, source_cap(settings.result_mode))
    return with_stored(index, hold(chosen, "page"), looked_up).withColumnRenamed("rank", "position")

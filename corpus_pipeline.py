"""The corpus pipeline: quality classifier, quality rules, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes every result and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import identity, packing, rules, simhash, suffixes, weak
from docquarry.llm.common import table
from docquarry.llm.queries import packed_digest, vocabulary
from docquarry.operators.sizing import settled
from docquarry.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages follow a trained model, fingerprints and a tokenizer, none of which SQL can express.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their order; further ones are left behind, missing ones are null."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier takes for junk or toxic."""
    ship_package(spark.sparkContext)
    docs = _documents(docs)
    model = weak.fit(settled(weak.observed(docs, carry=("doc_id",)), "pipeline-seen"), table(spark, sf_dir, "labels"))
    return weak.passing(weak.observed(docs), model).select(*COLUMNS)  # read again, so no copy of the texts is kept


def obey_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the policy clean-2 rejects; it lets short texts pass."""
    return rules.passing(_documents(docs), "clean-2").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one of least doc_id. Rows without doc_id stay.

    Of rows that repeat a doc_id and a text one stays; different texts of one doc_id are different documents.
    """
    ship_package(spark.sparkContext)
    docs = _documents(docs)
    keyed = docs.where(F.col("doc_id").isNotNull())
    shared = identity.numbers(keyed, "doc_id", "text")
    keyed = keyed.withColumn("number", F.col("doc_id")) if shared is None else identity.with_number(keyed, shared, "doc_id", "text", "number")
    groups = simhash.similar_groups(keyed, "number")
    kept = groups.where("component_id = number").select("number").distinct()
    left = keyed.join(kept, "number", "left_semi").dropDuplicates(["number"])
    return left.select(*COLUMNS).union(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without bytes that repeat an earlier string of 100 bytes; what is left of a cut character goes too, and so do emptied documents."""
    ship_package(spark.sparkContext)
    docs = _documents(docs)
    left = suffixes.deduplicated(docs.withColumn("had_text", F.col("text").isNotNull()), carry=("lang", "source", "n_chars", "had_text"))
    cut = F.col("n_removed") > 0
    new = F.col("text").cast("string")
    new = F.when(~cut | F.is_valid_utf8(new), new).otherwise(F.replace(F.make_valid_utf8(new), F.lit("\ufffd"), F.lit("")))
    left = left.where(~cut | (F.col("n_removed") < F.col("n_bytes"))).withColumn("text", F.when(F.col("had_text"), new))
    return left.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens, as pieces, with their checksums."""
    ship_package(spark.sparkContext)
    return packed_digest(packing.pack(_documents(docs), vocabulary("packing"), public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", obey_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

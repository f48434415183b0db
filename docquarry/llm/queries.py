"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each is thin: it reads its table whole, applies one operator with its production parameters and derives the columns of its contract.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, collisions, deal, fmindex, lengths, merkle, packing, periods, rules, simhash, suffixes, topk, weak
from docquarry.llm.common import SEPARATORS, table, whole_text
from docquarry.operators.sizing import settled
from docquarry.session import ship_package

TOKENIZERS = {"packing": "byte_bpe_50k.json", "lengths": "byte_bpe_50k.json", "bpe": "byte_bpe_multi_50k.tiktoken"}


def vocabulary(use: str, path: str | None = None) -> bytes:
    """The content of a public vocabulary's file, read on the driver; tasks get it by broadcast."""
    with open(path or public_tokenizers.path(TOKENIZERS[use]), "rb") as file:
        return file.read()


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per vec_id takes part (of several the smallest); rows without a vec_id or with an unsound vector take none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("q"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("q").isNotNull()).groupBy("vec_id").agg(F.min("q").alias("q"))
    terms, weights = topk.sparse(F.col("q"))
    rows = vectors.select(F.col("vec_id").alias("id"), terms.alias("terms"), weights.alias("weights"))
    return topk.top_k(rows, rows.where(F.col("id") % 20 == 0), 20).withColumnRenamed("id", "vec_id")


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("packing"), public_tokenizers.PATTERN)
    return packed_digest(pieces)


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(rules.mask(rules.BASE))) != 0
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return book.select("doc_id", *counts, base.alias("base_failed"), (~rules.rejected("strict-1")).alias("kept"), F.col("failed").alias("failed_bits"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = settled(weak.observed(docs, carry=("doc_id",)), "op5-seen")
    return weak.score(seen, weak.fit(seen, table(spark, sf_dir, "labels"))).select("doc_id", "junk", "toxic", "rejected", (~F.col("rejected")).alias("kept"))


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = deal.deal(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return dealt.select(
        "doc_id", (F.octet_length(whole_text()) + 8).cast("long").alias("size"), F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, pattern = vocabulary("bpe"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words, pattern)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), words, pattern)
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = fmindex.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lengths.encoded_lengths(table(spark, sf_dir, "documents").select("text"), vocabulary("lengths"), public_tokenizers.PATTERN)
    return lengths.length_histogram(counted)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per vec_id takes part (of several the smallest); rows without a vec_id or with an unsound vector take none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", collisions.sound("embedding").alias("vector"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = settled(vectors.withColumnRenamed("vec_id", "id"), "op11-vectors")  # read four times
    return collisions.nearest(rows, rows.where(F.col("id") % 20 == 0), 20).withColumnRenamed("id", "vec_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, sf_dir, "documents").select(*fields)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    frames = {c: merkle.framed(c) for c in fields}
    changed = merkle.digest(*(frames | {"n_chars": merkle.framed(F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")))}).values())
    leaves = docs.select("doc_id", "lang", merkle.digest(*frames.values()).alias("leaf"), F.when(tampered, changed).alias("changed"))
    made = merkle.manifest(leaves, "lang", ["doc_id"], ["changed"])
    made = made.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.collapsed(looped(docs))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    found = found.withColumn("first", first)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.s").alias("start"), (-F.col("first.l")).alias("length"), F.col("first.p").alias("period"),
        F.floor(-1000 * F.col("first.l") / F.col("first.p")).alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """The contract's documents: where 10 divides the checksum of doc_id, the words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text"), SEPARATORS), lambda w: w != "")

    def repeated(ws):
        a = g % F.size(ws)
        p = 1 + F.floor((F.size(ws) - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    once = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise("")), F.lit(0))  # the words are made once
    return docs.withColumn("text", F.when(F.col("text").isNotNull() & (h % 10 == 0), once).otherwise(F.col("text")))


_ALL = {
    query.__name__: query
    for query in (
        op1_exact_top_k, op2_pack_documents, op3_quality_rules, op4_simhash_near_dedup, op5_quality_classifier,
        op6_shard_documents, op7_byte_bpe, op8_fm_index_dedup, op9_suffix_array_dedup, op10_token_counts, op11_nearest_neighbours,
        op12_merkle_manifest, op13_periodic_runs,
    )
}


def _shipping(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark.sparkContext)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipping(query) for name, query in _ALL.items()}

ORACLE = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op3_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents),
        tri AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM tri) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                   coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_upper,
                   length(t) - length(replace(t, '!', '')) AS n_exclamations, len(list_distinct(ws)) AS n_distinct_words,
                   len(list_filter(ws, lambda x, i: x = ws[i + 1])) AS n_doubled_words
            FROM d LEFT JOIN covered c USING (doc_id)),
        b AS (
            SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
        FROM b""".replace("{bits}", " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(rules.RULES))),
    "op12_merkle_manifest": """
        WITH RECURSIVE framed AS (
            SELECT doc_id, coalesce('=' || lang, '') AS g,
                   list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, CAST(n_chars + 1 AS VARCHAR)],
                                  lambda x: CASE WHEN x IS NULL THEN '-' ELSE CAST(strlen(x) AS VARCHAR) || ':' || x END) AS f,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
                           lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS crc
            FROM documents),
        d AS (SELECT doc_id, g, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf,
                     CASE WHEN crc % 7 = 0 THEN sha256(f[1] || f[2] || f[3] || f[6] || f[5]) END AS changed FROM framed),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM d),
        up AS (
            SELECT g, CAST(0 AS BIGINT) AS level, pos, leaf AS h, m FROM leaves
            UNION ALL
            SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (m + 1) // 2 FROM up WHERE m > 1 GROUP BY g, level, pos // 2, m),
        subroots AS (SELECT g, h AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM up WHERE m = 1),
        top AS (
            SELECT CAST(0 AS BIGINT) AS level, pos, subroot AS h, m FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (m + 1) // 2 FROM top WHERE m > 1 GROUP BY level, pos // 2, m),
        ends AS (SELECT h AS root, level AS height FROM top WHERE m = 1),
        below AS (
            SELECT l.g, l.pos, list(CASE WHEN (l.pos >> k.level) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(u.h, '') ORDER BY k.level) AS path
            FROM leaves l JOIN subroots s USING (g) JOIN (SELECT DISTINCT level FROM up) k ON k.level < s.height
            LEFT JOIN up u ON u.g = l.g AND u.level = k.level AND u.pos = xor(l.pos >> k.level, 1) GROUP BY l.g, l.pos),
        above AS (
            SELECT s.g, list(CASE WHEN (s.pos >> k.level) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(u.h, '') ORDER BY k.level) AS path
            FROM subroots s JOIN (SELECT DISTINCT level FROM top) k ON k.level < (SELECT height FROM ends)
            LEFT JOIN top u ON u.level = k.level AND u.pos = xor(s.pos >> k.level, 1) GROUP BY s.g),
        whole AS (
            SELECT l.doc_id, l.leaf, l.changed, s.subroot, e.root, list_concat(coalesce(b.path, []), coalesce(a.path, [])) AS path
            FROM leaves l JOIN subroots s USING (g) CROSS JOIN ends e LEFT JOIN below b ON b.g = l.g AND b.pos = l.pos LEFT JOIN above a ON a.g = l.g),
        folds AS (
            SELECT *, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x[2:]), 'string_agg', ''), '')) AS proof_sha256,
                   list_reduce(list_prepend(coalesce(changed, leaf), path),
                       lambda h, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || h ELSE h || x[2:] END)) AS folded_root FROM whole)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds""",
}

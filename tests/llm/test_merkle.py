"""The Merkle manifest against a plain tree, with null groups and keys, repeated rows, lone leaves and odd runs."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from docquarry.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout):
    """The last node, and for every node the digests of its runs without its own."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % fanout
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
        nodes, at = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [p // fanout for p in at]
    return nodes[0], paths


def plain(rows, fanout):
    """rows: (group, key, leaf). A multiset of (group, key, leaf, subroot, root, path)."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ends, inner = {}, {}
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        ends[g], inner[g] = climb([r[2] for r in groups[g]], fanout)
    root, outer = climb([ends[g] for g in order], fanout)
    return collections.Counter(
        (*row, ends[g], root, tuple(inner[g][i] + outer[k])) for k, g in enumerate(order) for i, row in enumerate(groups[g])
    )


def found(spark, rows, fanout, levels):
    df = spark.createDataFrame([(g, k, leaf, "x", 1) for g, k, leaf in rows], "lang string, doc_id long, leaf string, path string, pos int").repartition(3)
    out = merkle.manifest(df, "lang", ["doc_id"], ["lang"], fanout, levels)
    held = out.collect()
    assert all(r.root == x for r, x in zip(held, (r[0] for r in out.select(merkle.folded(F.col("leaf"), F.col("path"))).collect())))
    return collections.Counter((r.lang, r.doc_id, r.leaf, r.subroot, r.root, tuple((x.before, x.after) for x in r.path)) for r in held)


@pytest.mark.parametrize("fanout, levels", [(2, 2), (3, 1)])
def test_manifest_is_the_plain_tree(spark, fanout, levels):
    rows = [("hot", i, h(str(i))) for i in range(77)] + [("b", 5, h("b")), (None, 1, h("n")), (None, None, h("m")), ("", 2, h("e")), ("é", 3, h("é"))]
    rows += [("hot", 7, h("7")), ("hot", 7, h("7")), ("hot", 7, h("other")), ("hot", None, h("none"))]  # repeated rows, ties, no key
    assert found(spark, rows, fanout, levels) == plain(rows, fanout)


def test_small_manifests(spark):
    assert found(spark, [("a", 1, h("x"))], 2, 5) == plain([("a", 1, h("x"))], 2)
    assert merkle.manifest(spark.createDataFrame([], "lang string, doc_id long, leaf string"), "lang", ["doc_id"]).count() == 0
    frames = spark.createDataFrame([("é1",), ("",), (None,)], "t string").select(merkle.framed("t").alias("f")).collect()
    assert [r.f for r in frames] == ["3:é1", "0:", "-"]


def test_tampering_moves_the_root(spark):
    rows = [("a", i, h(str(i))) for i in range(9)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string")
    out = merkle.manifest(df, "lang", ["doc_id"]).select("root", merkle.folded(F.sha2(F.concat("leaf", F.lit("!")), 256), F.col("path")).alias("other"))
    assert all(r.root != r.other for r in out.collect())

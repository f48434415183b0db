"""Merkle manifest of a dataset by slot pivots.

Leaves stand in order inside their group; consecutive runs of ``fanout`` nodes become the hash of their digests, until one node, the
group's subroot, remains. Subroots in turn make up one tree whose last node is the root.

A tree is built block by block: conditional aggregates spread the nodes of one block (``fanout ** LEVELS`` of them) into slot columns, and
concatenating neighbouring columns hashes a whole subtree inside the row. The siblings of a node are the columns of its run without
its own. Blocks of one exchange are the nodes of the next, so a tree of n leaves takes log(n) / log(slots) exchanges, each ``slots`` times smaller than
the one before. Coming back, a block's row meets only the path of its own node and hands it to its nodes.

Positions need no window over a group: rows are sorted by range, and each adds the rows of the ranges before it.
Everything is made of column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.operators.sizing import BROADCAST_ROWS, hold_table, settled

#: Levels of the tree that one exchange builds (with a fanout of 2, so blocks of 32 nodes).
LEVELS = 5
#: Low bits of a generated row number that count inside its partition.
LOCAL_BITS = 33


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated; null parts add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def framed(column: str | Column) -> Column:
    """A value as bytes that cannot be confused with another: ``-`` if null, else its UTF-8 length, a colon and the value."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def numbered(rows: DataFrame, group: str, order: Sequence[str], label: str) -> DataFrame:
    """The rows with ``pos``, their place in the group by ``order``, and ``total``, the rows of the group.

    ``group`` holds no nulls; nulls of ``order`` come first. Equal rows stand next to each other, in any order. A group may hold all rows: ranges cut through it
    and through equal rows, as a number of the row is part of the range key.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "salt")]
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    placed = settled(ranged.withColumn("at", F.monotonically_increasing_id()), label)
    part, local = F.shiftright("at", LOCAL_BITS), F.col("at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    placed = placed.select(*rows.columns, part.alias("part"), local.alias("local"))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per task
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    # Ranges follow the group first, so a group's rows are one stretch: its first number and its length say all.
    starts = placed.groupBy("part", group).agg(F.min("local").alias("local"), F.count(F.lit(1)).alias("n")).join(before, "part")
    groups = starts.groupBy(group).agg(F.min(F.col("before") + F.col("local")).alias("first"), F.sum("n").alias("total"))
    held = hold_table(groups, f"{label}-groups")
    joined = placed.join(F.broadcast(before), "part").join(held.side(), group)
    out = joined.select(*rows.columns, (F.col("before") + F.col("local") - F.col("first")).alias("pos"), "total")
    # Too many groups to broadcast: the join is written, so that the rows of a large group are split in it.
    return out if held.count <= BROADCAST_ROWS else settled(out, f"{label}-placed")


def _pivoted(nodes: DataFrame, fanout: int, levels: int, label: str) -> DataFrame:
    """One row per block: g, pos and total of the block as a node, its ``digest``, and what its nodes need to get their paths.

    ``nodes``: g, pos, total, node (a struct that begins with its digest).
    """
    slots = fanout**levels
    slot = F.col("pos") % slots
    spread = [F.max(F.when(slot == i, F.col("node"))).alias(f"c{i}") for i in range(slots)]
    blocks = nodes.groupBy("g", F.floor(F.col("pos") / slots).alias("block"), "total").agg(*spread)
    # A level hashes as long as several nodes remain in the group.
    left, remain = [F.col("total")], []
    for _ in range(levels):
        remain.append(left[-1] > 1)
        left.append(F.floor((left[-1] + (fanout - 1)) / fanout))
    row = [f"c{i}.digest" for i in range(slots)]
    rows = [row]
    for level in range(levels):
        made = []
        for k in range(len(row) // fanout):
            run = [F.col(c) for c in row[k * fanout : (k + 1) * fanout]]
            made.append(F.when(run[0].isNotNull(), F.when(remain[level], digest(*run)).otherwise(run[0])).alias(f"n{level}_{k}"))
        blocks = blocks.select("*", *made)
        row = [f"n{level}_{k}" for k in range(len(made))]
        rows.append(row)
    levels_done = sum((x.cast("int") for x in remain[1:]), remain[0].cast("int"))
    table = F.array(*(F.array(*(F.col(c) for c in r)) for r in rows[:-1]))
    return settled(
        blocks.select(
            "g", F.col("block").alias("pos"), left[-1].alias("total"), F.col(row[0]).alias("digest"), levels_done.alias("depth"),
            F.array(*(F.col(f"c{i}") for i in range(slots))).alias("nodes"), table.alias("rows"),
        ), label
    )


def _path(rows: Column, depth: Column, place: Column, fanout: int) -> Column:
    """The digests before and after the node's own, on each level of its block: the columns of a run, its own left out."""

    def at(level: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(fanout)), level)).cast("int")
        first = own - own % fanout
        row = F.get(rows, level)
        before = F.array_join(F.slice(row, first + 1, own - first), "")
        after = F.array_join(F.slice(row, own + 2, first + fanout - 1 - own), "")
        return F.struct(before.alias("before"), after.alias("after"))

    none = F.array().cast("array<struct<before:string,after:string>>")
    return F.when(depth > 0, F.transform(F.sequence(F.lit(0), depth - 1), at)).otherwise(none)


def _handed_down(blocks: DataFrame, fanout: int) -> DataFrame:
    """Every node of the blocks with its ``path`` to the end of the tree. ``blocks`` carry ``above``, the path of their own node."""
    inner = F.transform("nodes", lambda node, i: F.struct(i.alias("i"), node.alias("node")))
    held = blocks.withColumn("held", F.explode(F.filter(inner, lambda x: x["node"].isNotNull())))
    path = F.concat(_path(F.col("rows"), F.col("depth"), F.col("held.i"), fanout), F.col("above"))
    return held.withColumn("path", path).withColumn("node", F.col("held.node")).withColumn("slot", F.col("held.i")).drop("held", "nodes", "rows", "above")


def tree(nodes: DataFrame, fanout: int, levels: int, label: str) -> tuple[DataFrame, DataFrame]:
    """The last node of every group (g, digest), and the lowest blocks with ``above``, the path from them to it.

    ``nodes``: g, pos, total and node, as ``numbered`` and ``_pivoted`` have them.
    """
    slots = fanout**levels
    most = nodes.agg(F.max("total")).first()[0] or 1
    steps = 1
    while slots**steps < most:
        steps += 1
    blocks = []
    for _ in range(steps):
        blocks.append(_pivoted(nodes, fanout, levels, label))
        nodes = blocks[-1].select("g", "pos", "total", F.struct("digest").alias("node"))
    above = blocks[-1].withColumn("above", F.array().cast("array<struct<before:string,after:string>>"))
    for lower in reversed(blocks[:-1]):
        paths = _handed_down(above, fanout).select("g", (F.col("pos") * slots + F.col("slot")).alias("pos"), F.col("path").alias("above"))
        above = lower.join(paths, ["g", "pos"])
    return blocks[-1].select("g", "digest"), above


def manifest(leaves: DataFrame, group: str, order: Sequence[str], carry: Sequence[str] = (), fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """leaf, subroot, root, path and the columns of ``carry`` for every row of ``leaves``.

    ``leaves`` has ``leaf`` (a digest in hex), the group's column (string; null is a group of its own, before the others) and the columns of
    ``order``. Leaves of a group ascend by these, nulls first, ties by leaf; wholly equal rows stay apart as leaves. Only these columns and ``carry`` are
    read. ``path`` is an array of (before, after), the digests of the others in each run from the leaf's to the root's: see ``folded``. A lone leaf
    is its group's subroot, and a lone subroot the root. No rows: no rows.
    """
    kept = list(dict.fromkeys(["leaf", *order, *carry]))
    # A group as text that is never null and sorts as the group does, null first.
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    held = leaves.select(g.alias("g"), *(F.col(c) for c in kept))
    held = settled(held, "merkle-leaves")  # hashed once, though the ranges are sampled first
    node = F.struct(F.col("leaf").alias("digest"), *(F.col(c) for c in kept if c != "leaf"))
    placed = numbered(held, "g", [*order, "leaf"], "merkle-order")
    subroots, lowest = tree(placed.select("g", "pos", "total", node.alias("node")), fanout, levels, "merkle-block")
    named = subroots.select(F.lit("").alias("all"), "g", F.col("digest").alias("leaf"))
    over = numbered(named, "all", ["g"], "merkle-groups")
    over = over.select(F.col("all").alias("g"), "pos", "total", F.struct(F.col("leaf").alias("digest"), F.col("g").alias("of")).alias("node"))
    root, top = tree(over, fanout, levels, "merkle-top")
    ends = _handed_down(top, fanout).select(F.col("node.of").alias("g"), F.col("node.digest").alias("subroot"), F.col("path").alias("rest"))
    last = root.first()  # one digest, or none
    ends = hold_table(ends.withColumn("root", F.lit(last.digest if last else None).cast("string")), "merkle-ends")
    whole = lowest.join(ends.side(), "g").withColumn("above", F.concat("above", "rest")).drop("rest")
    found = _handed_down(whole, fanout)
    columns = (F.col("node.digest").alias(c) if c == "leaf" else F.col(f"node.{c}").alias(c) for c in kept)
    return found.select(*columns, "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests of its path lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))

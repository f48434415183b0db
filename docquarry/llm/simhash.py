"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree on one of four blocks of sixteen; so each distinct fingerprint goes to four
shards, and each shard's top pattern is the block its members share. Inside a shard they stand in the order of their Gray rank, where
neighbours share most bits. Groups of neighbours, and groups of groups, keep the bits all members share as a masked pattern; a node
compares only the bits its parent has not compared yet, adds their differences to the parent's sum, and a whole group
is left out once the sum exceeds the radius. A group whose open bits cannot exceed the radius any more is linked whole, by one link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.anchors import BASE, mixed
from docquarry.llm.common import parts_for, whole_text
from docquarry.llm.components import components
from docquarry.operators.sizing import settled

SEED = 42
BLOCKS, WIDTH = 4, 16
#: A shard with more distinct fingerprints than this is parted again: up to radius 3 by the same rule, into four times 4,096 shards;
#: for wider radii into slices of about this size, of which every two meet in a shard.
CROWDED = 20_000
#: Members of a node, and query-member pairs that a task looks at in one step at most.
FAN, STEP = 16, 2_000_000
#: Rows after which a task searches the complete shards it has gathered.
GATHER = 200_000


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key and ``fp``, a long that holds the 64 bits. Words of ASCII-lower-cased text, in ``shingle``-word shingles with repeats.

    Fewer words: the whole sequence is the one shingle. A text without words, or null, has fingerprint 0.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            values = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=[key, "fp"])

    return docs.select(key, whole_text(text).cast("binary")).mapInArrow(run, schema)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # bytes: only A-Z are lowered, and only \x20 and \x09-\x0D part words
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    begins = ends - lengths + 1
    spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def gray_rank(value: Column) -> Column:
    """The place of a word in the reflected Gray sequence: every bit becomes the parity of the bits above and including it."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value


def _rotated(value: Column, by: int) -> Column:
    by %= 64
    return value if not by else F.shiftrightunsigned(value, by).bitwiseOR(F.shiftleft(value, 64 - by))


def shards(prints: DataFrame) -> DataFrame:
    """Distinct ``fp`` and the shards (b, key, sub, low) they belong to, for a radius of at most three."""
    places = F.array(*[F.struct(F.lit(b).alias("b"), _rotated(F.col("fp"), WIDTH * b).bitwiseAND(F.lit(0xFFFF)).alias("key"), _rotated(F.col("fp"), WIDTH * (b + 1)).alias("rest")) for b in range(BLOCKS)])
    rows = prints.select("fp", F.inline(places))
    crowded = rows.groupBy("b", "key").count().where(F.col("count") > CROWDED).select("b", "key", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["b", "key"], "left")
    parts = F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(-1)))
    rows = rows.withColumn("sub", F.explode(parts))
    low = F.expr("case when sub < 0 then 0 else shiftrightunsigned(rest, 12 * sub) & 4095 end")
    return rows.select("b", "key", "sub", low.alias("low"), "fp")


def met(members: DataFrame) -> DataFrame:
    """Members (b, key, slices, id, fp and more) of shards, in shards (b, key, sub, low) of at most two slices, of which every two meet."""
    mine, last = F.pmod(F.xxhash64("id"), F.col("slices")), F.col("slices") - 1
    rows = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumns({"sub": F.least("mine", "other"), "low": F.greatest("mine", "other")}).drop("mine", "other", "slices")


def links(prints: DataFrame, radius: int = 3, mode: str = "forest") -> DataFrame:
    """Links (u, v) between fingerprints at most ``radius`` bits apart that share a shard.

    ``prints`` are distinct fingerprints fp, where a radius up to 3 is exact; or members (b, key, slices, id, fp) of bands, where pairs
    of the same band are sought, whatever the radius, and u and v are ids.

    "forest": they connect all that such pairs connect, as few as a shard allows. "seeds": these, and neighbours in Gray order; a few per fingerprint and shard, and every
    fingerprint of a pair is in one. "across": all pairs whose ``root`` differs; groups of one root are pruned whole.
    """
    held = (met(prints) if "slices" in prints.columns else shards(prints)).repartition(parts_for(prints), "b", "key", "sub", "low").sortWithinPartitions("b", "key", "sub", "low", gray_rank(F.col("fp")))

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= GATHER:
                rest = yield from search(kept, False)
                kept = [rest] if rest is not None else []
        if kept:
            yield from search(kept, True)

    def search(kept, last):
        table = pa.Table.from_batches(kept).combine_chunks()
        names = [table[c].to_numpy() for c in ("b", "key", "sub", "low")]
        new = np.zeros(table.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in names], axis=0)
        begins = np.flatnonzero(new)
        end = table.num_rows if last else int(begins[-1]) if len(begins) else 0
        if end:
            values = table["fp"].to_numpy()[:end].view(np.uint64)
            ids = table["id"].to_numpy()[:end] if "id" in table.column_names else values.view(np.int64)
            roots = table["root"].to_numpy()[:end] if mode == "across" else None
            for left, right in found(values, np.cumsum(new[:end]), radius, mode, roots):
                yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], names=["u", "v"])
        rest = table.slice(end).to_batches()
        return rest[0] if rest else None

    return held.mapInArrow(run, "u long, v long")


def found(values: np.ndarray, shard: np.ndarray, radius: int, mode: str, roots: np.ndarray | None = None):
    """Links among members of the same shard, as arrays of places; ``values`` stand by shard and Gray rank."""
    sizes = np.bincount(shard)
    several = (sizes > 1)[shard]
    origin = np.flatnonzero(several)
    if not len(origin):
        return
    values, shard = values[origin], np.unique(shard[origin], return_inverse=True)[1]
    roots = None if roots is None else roots[origin]
    tree = Tree(values, shard, roots)
    counts = np.bincount(shard)[shard]
    ahead = np.concatenate(([0], np.cumsum(counts)))
    left, right, start = [], [], 0
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(ahead, ahead[start] + STEP, "right")) - 1)
        a, b = tree.search(np.arange(start, min(stop, len(values))), radius)
        start = stop
        if mode == "across":
            yield origin[a], origin[b]
        else:
            left.append(a), right.append(b)
    if mode != "across":
        label = smallest(len(values), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(label != np.arange(len(values)))
        yield origin[moved], origin[label[moved]]
    if mode == "seeds":
        near = np.flatnonzero((shard[1:] == shard[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= radius))
        yield origin[near], origin[near + 1]


class Tree:
    """Level 0 are the values; a node of a higher level stands for up to FAN nodes below it, all of one shard.

    With ``roots``, links are only sought between values of different roots, and then all of them.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray, roots: np.ndarray | None = None):
        self.values, self.shard, self.roots = values, shard, roots
        self.ranges = [(roots, roots)]  # least and greatest root below each node, by level
        low = high = values
        fixed = np.full(len(values), ~np.uint64(0))
        first, end = np.arange(len(values)), np.arange(1, len(values) + 1)
        self.levels = [(values, fixed, first, end, None, None)]
        owner = shard
        while True:
            counts = np.bincount(owner)
            if counts.max() == 1:
                break
            place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
            heads = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            fixed = ~(low ^ high)
            ends = np.append(heads[1:], len(owner))
            first, end = first[heads], end[ends - 1]
            self.levels.append((low & fixed, fixed, first, end, heads, ends))
            owner = owner[heads]
            if self.roots is not None:
                below = self.ranges[-1]
                self.ranges.append((np.minimum.reduceat(below[0], heads), np.maximum.reduceat(below[1], heads)))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of each query to later members of its shard."""
        node, query = self.shard[queries], queries
        done = np.zeros(len(queries), np.uint8)
        known = np.zeros(len(queries), np.uint64)  # bits that have been compared
        out: tuple[list, list] = ([], [])
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, fixed, first, end, heads, ends = self.levels[level]
            mask = fixed[node]
            done = done + np.bitwise_count((self.values[query] ^ pattern[node]) & mask & ~known)
            keep = (done <= radius) & (end[node] > query + 1)
            if self.roots is not None:
                lowest, highest = self.ranges[level]
                keep &= (lowest[node] != self.roots[query]) | (highest[node] != self.roots[query])
            node, query, done, mask = node[keep], query[keep], done[keep], mask[keep]
            whole = done + np.bitwise_count(~mask) <= radius if self.roots is None or not level else np.zeros(len(node), bool)
            out[0].append(query[whole]), out[1].append(np.maximum(first[node[whole]], query[whole] + 1))
            if not level:
                break
            node, query, done, known = node[~whole], query[~whole], done[~whole], mask[~whole]
            begin, many = heads[node], ends[node] - heads[node]
            index = np.repeat(np.arange(len(node)), many)
            node = np.arange(len(index)) - np.repeat(np.cumsum(many) - many, many) + begin[index]
            query, done, known = query[index], done[index], known[index]
        return np.concatenate(out[0]), np.concatenate(out[1])


def smallest(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    label = np.arange(size)
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nearer = label[label]
            if (nearer == label).all():
                break
            label = nearer


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """key, fingerprint (16 lower-case hex digits) and component_id, the least key reachable by links of at most ``radius`` bits.

    One row per row of ``docs``. Texts without words share fingerprint 0 and link like others. Rows without a key get the least
    key of their component, null if it has none; repeated keys and texts are rows like others; other columns are not carried along.
    An empty table gives an empty result. Equal fingerprints are summed up before anything is searched, so copies cost nothing.
    """
    held = settled(fingerprints(docs, key, text, shingle), "simhash-prints")
    prints = settled(held.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    roots = components(links(prints.select("fp"), radius), "simhash-stars")
    return _named(held, prints, roots, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(held: DataFrame, prints: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    rooted = prints.join(roots, prints[node] == roots.u, "left").select(node, "least", F.coalesce("root", node).alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select(node, "component_id")
    return held.join(named, node)


#: Bands of a sketch, and least values that a band takes together. Sets of similarity s agree on a band with probability s^5, so on one
#: of fourteen with 0.996 at 0.8 and 0.36 at 0.5.
BANDS, TOGETHER = 14, 5
FACTORS = mixed(np.arange(1, BANDS * TOGETHER + 1, dtype=np.uint64) * BASE) | np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A number per band; a band has the least values that a set takes under some of the ``FACTORS``, which equal sets share."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for start in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[None, start : start + 4096] * FACTORS[:, None]).min(axis=1))
    return mixed((mixed(least) * FACTORS).reshape(BANDS, TOGETHER).sum(axis=1, dtype=np.uint64))


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """key, ``id`` of the text's set of shingles, the set's fingerprint ``fp`` and its ``bands``: how often a shingle stands in the text is no matter."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in batch.column(1).to_pylist()]
            prints = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            places = pa.array([bands(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([named(x) for x in sets], pa.int64()), pa.array(prints), places], names=[key, "id", "fp", "bands"])

    return docs.select(key, whole_text(text).cast("binary")).mapInArrow(run, schema)


def named(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 18, least: float = 0.8) -> DataFrame:
    """key and component_id, linked by a Jaccard similarity of ``least`` or more between the sets of ``shingle``-word shingles.

    Sets that agree on one of fourteen bands meet in a shard; there the index proposes pairs that differ in at most ``radius`` bits, and
    each is then compared exactly. Found are about 99 in 100 pairs at 0.8 and more above (README has the measured recall). Texts of equal
    sets always link; different sets are compared even if their fingerprints are equal.

    Two passes: seeds, a few links per text, connect most of every group; the second compares all pairs that the first has not
    connected, so no proposed link is left out. What the seeds connect costs some n comparisons for n texts; texts whose fingerprints are
    close but whose similarity is below ``least`` stay apart and are still compared pair by pair (README has a count).
    """
    held = settled(sketches(docs, key, text, shingle), "similar-prints")
    prints = settled(held.groupBy("id").agg(F.min(key).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "similar-distinct")
    rows = prints.select("id", "fp", F.posexplode("bands").alias("b", "key"))
    several = rows.groupBy("b", "key").count().where("count > 1").select("b", "key", F.ceil(F.col("count") / CROWDED).alias("slices"))
    members = settled(rows.join(several, ["b", "key"]), "similar-members")
    seeds = settled(links(members, radius, "seeds").distinct(), "similar-seeds")
    ends = seeds.select(F.col("u").alias("id")).union(seeds.select(F.col("v").alias("id"))).distinct()
    chosen = prints.join(ends, "id", "left_semi").select(F.col("least").alias(key)).distinct()
    texts = docs.select(key, whole_text(text).cast("binary").alias("t")).join(chosen, key, "left_semi")

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([named(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "s"])

    # Texts that share a key all come here; each names its own set.
    sets = settled(texts.select("t").mapInArrow(run, "id long, s array<long>").dropDuplicates(["id"]).join(ends, "id", "left_semi"), "similar-sets")

    def same(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
        common = F.size(F.array_intersect("a", "b"))
        return both.where(common >= least * (F.size("a") + F.size("b") - common)).select("u", "v")

    first = components(forest(same(seeds)), "similar-stars")
    rooted = members.join(sets.select("id"), "id", "left_semi").join(first, F.col("id") == F.col("u"), "left").withColumn("root", F.coalesce("root", "id")).drop("u")
    others = settled(links(rooted, radius, "across").distinct(), "similar-across")
    edges = first.select("u", F.col("root").alias("v")).union(forest(same(others)))
    return _named(held, prints, components(edges, "similar-stars"), "id").select(key, "component_id")


#: Links that a task reduces to a forest at a time.
FOREST = 2_000_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what the given ones connect, fewer where they are dense: each task that compares keeps a star per component it sees."""

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= FOREST:
                yield stars(kept)
                kept = []
        if kept:
            yield stars(kept)

    def stars(kept):
        table = pa.Table.from_batches(kept)
        names, places = np.unique(np.concatenate([table[c].to_numpy() for c in ("u", "v")]), return_inverse=True)
        label = smallest(len(names), *np.split(places, 2))
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")

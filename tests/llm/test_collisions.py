"""Collision counting against brute force: recall, exact scores, ties, unsound vectors and small tables."""

import collections

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from docquarry.llm import collisions
from docquarry.llm.queries import QUERIES

RNG = np.random.default_rng(5)
SCHEMA = "vec_id long, embedding array<float>, id long, vector int, rank int, score string"


def brute(vectors, k):
    """{query: [(score, id)]}, nearest first; scores summed in the order of components."""
    ids, width = sorted(vectors), max((len(v) for v in vectors.values()), default=0)
    full = np.array([list(map(float, vectors[i])) + [0.0] * (width - len(vectors[i])) for i in ids]).reshape(len(ids), width)
    out = {}
    for row, i in enumerate(ids):
        if i % 20 == 0:
            scores = np.zeros(len(ids))
            for j in range(width):
                scores += full[:, j] * full[row, j]
            out[i] = sorted((-s, n) for s, n in zip(scores.tolist(), ids) if n != i)[:k]
    return out


def found(spark, folder):
    got = collections.defaultdict(dict)
    for r in QUERIES["op11_nearest_neighbours"](spark, str(folder)).collect():
        assert r["rank"] not in got[r.query_id]
        got[r.query_id][r["rank"]] = (-r.score, r.vec_id)
    return {q: [found[n] for n in range(1, len(found) + 1)] for q, found in got.items()}


def recall(got, want):
    whole = {q: set(x) for q, x in got.items()}
    assert all(x == sorted(x) and len(x) == len(want[q]) for q, x in got.items()) and set(got) == {q for q, x in want.items() if x}
    return sum(len(whole[q] & set(x)) for q, x in want.items()) / max(sum(map(len, want.values())), 1)


def test_recall_on_the_given_table(spark):
    folder = "/root/testdata/sf0.1"
    held = pq.read_table(f"{folder}/embeddings.parquet").to_pydict()
    vectors = {i: v for i, v in zip(held["vec_id"], held["embedding"])}
    assert recall(found(spark, folder), brute(vectors, 20)) >= 0.95


def test_norms_ties_and_unsound_vectors(spark, tmp_path):
    same = RNG.normal(size=6).astype("f4")
    vectors = {i: (RNG.normal(size=6) * 10 ** RNG.uniform(-2, 2)).astype("f4") for i in range(300)}
    vectors |= {i: same for i in range(100, 160)}  # ties: the smaller ids
    vectors |= {400: np.array([1, 2], "f4"), 420: np.array([0, 0, -3], "f4")}  # shorter ones
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    rows += [(500, None), (520, []), (540, [0.0, 0.0]), (560, [1.0, None]), (580, [float("nan")]), (600, [float("inf"), 1.0]), (None, [1.0])]
    rows.append((0, [9e3] * 6))  # of two vectors of one id the smaller takes part
    rows = [(i, v, 7, 7, 7, "x") for i, v in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors[0] = min(vectors[0].tolist(), [9e3] * 6)
    got, want = found(spark, tmp_path), brute(vectors, 20)
    assert recall(got, want) >= 0.95
    assert got[120] == want[120] or set(n for _, n in got[120]) & set(range(100, 160)) == set(n for _, n in want[120]) & set(range(100, 160))


def test_small_tables(spark, tmp_path):
    for n, rows in enumerate(([], [(20, [1.0])], [(20, [1.0]), (40, [-1.0]), (3, [0.5])])):
        spark.createDataFrame([(*r, 1, 1, 1, "") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
    assert found(spark, tmp_path / "0") == {} and found(spark, tmp_path / "1") == {}
    assert found(spark, tmp_path / "2") == {20: [(-0.5, 3), (1.0, 40)], 40: [(0.5, 3), (1.0, 20)]}  # all candidates, also far ones


def test_blocks_miss_little():
    points = RNG.normal(size=(3000, 24)) + RNG.integers(0, 12, 3000)[:, None]
    table = pa.table({"id": np.arange(3000), "vector": pa.array(points.tolist(), pa.list_(pa.float64()))})
    made = collisions._cell(table.slice(0, 60), table, 10, 24, 1.0, float(np.sqrt((points**2).sum(1).max())))
    got = collections.defaultdict(set)
    for q, i in zip(made["query_id"].to_pylist(), made["id"].to_pylist()):
        got[q].add(i)
    scores = points[:60] @ points.T
    scores[np.arange(60), np.arange(60)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len(got[q] & set(w)) / 10 for q, w in enumerate(want.tolist())]) >= 0.95

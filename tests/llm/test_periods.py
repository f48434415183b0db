"""Periodic runs against a quadratic search, and the registered query against the contract spelled out."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from docquarry.llm import periods
from docquarry.llm.queries import QUERIES

RNG = np.random.default_rng(13)


def plain(words, least):
    """(start, end, period) of all maximal repetitions; of equal stretches the one of least period."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(2 * p, least):
                best.setdefault((start, i + p), p)
            i += i == start
    return sorted((s, p, e) for (s, e), p in best.items())


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def odd_texts():
    yield from ([], [1], [1, 1], [1] * 500, [0, 1] * 100 + [0] + [0, 1] * 100 + [0], thue_morse(700), fibonacci(600))
    for n in (3, 40, 200, 500):
        yield from (RNG.integers(0, k, n).tolist() for k in (2, 3, 20))
    for _ in range(40):  # powers of short words, side by side, twice
        text = []
        for _ in range(int(RNG.integers(1, 5))):
            text += (RNG.integers(0, 3, int(RNG.integers(1, 7))).tolist() * 40)[: int(RNG.integers(1, 120))]
        yield text + RNG.integers(0, 2, 3).tolist() + text
    long = RNG.integers(0, 90, 900).tolist()
    yield long + long + long[:100]


def test_runs_are_those_of_a_plain_search():
    texts = list(odd_texts())
    codes = np.array([c for t in texts for c in t], np.int64)
    home = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, end, period = periods.runs_of(codes, home)
    first = np.cumsum([0, *map(len, texts)])
    for i, text in enumerate(texts):
        mine = home[start] == i
        got = sorted(zip((start[mine] - first[i]).tolist(), period[mine].tolist(), (end[mine] - first[i]).tolist()))
        assert got == plain(text, 4), text


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words, 12)
    top = min(((-(e - s), s, p) for s, p, e in runs), default=None)
    dropped = {i for s, p, e in runs for i in range(s + p, e)}
    lines = "".join(f"{s},{e - s},{p}\n" for s, p, e in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_query(spark, tmp_path, case):
    texts = [None, "", " \t\n", "one", "a " * 300, "é ß " * 40, "lead\x0b" + "x y z\r\n" * 9 + "tail", "p q r s t " * 200 + "u"]
    texts += [" ".join(f"w{x}" for x in RNG.integers(0, k, n)) for k in (2, 5, 4000) for n in (30, 300, 1500)]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts * 5)] + [(None, texts[4], "en", 1), (4, texts[4], "en", 1)]
    df = spark.createDataFrame(rows if case == "odd" else [], "doc_id long, text string, runs string, key int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(r[0], r[1]) for r in rows) if case == "odd" else [], key=str)


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    small = [d for d in docs if len(d["text"] or "") < 6000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert len(got) == len(docs) and all(got[d["doc_id"]] == expected(d["doc_id"], d["text"]) for d in small)


def test_a_text_of_megabytes(spark):
    words = [f"w{x}" for x in RNG.integers(0, 50_000, 400_000)]
    text = " ".join(words[:300_000] + words[:300_000] + ["x"] * 50_000)
    row = periods.collapsed(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (300_000, 600_000) == (row.runs[0].period, row.runs[0].length) and any(r.period == 1 and r.length == 50_000 for r in row.runs)
    assert bytes(row.text) == " ".join(words[:300_000] + ["x"]).encode()

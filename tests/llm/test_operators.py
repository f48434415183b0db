"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquarry.llm import anchors, bpe, deal, fmindex, lengths, packing, rules, simhash, suffixes, topk, weak
from docquarry.llm.queries import vocabulary
from docquarry.llm.tokens import ranked_pieces, ranks_of
from docquarry.operators.sizing import settled

PATTERN = public_tokenizers.PATTERN
RNG = np.random.default_rng(3)
WORDS = ["the", "river", "Bends", "near", "old", "été", "straße", "x", "#1", "hill.", "and", "so", "it", "goes", "on\nwards"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rank int, k string, t string"


def prose(count):
    return " ".join(RNG.choice(WORDS, count))


PASSAGE = prose(80)
TEXTS = (
    [None, "", " \t\n", "one", "two words", "  lead  and trail ", "a" * 700, "ab" * 400, PASSAGE, PASSAGE, PASSAGE + " tail", prose(30) + " " + PASSAGE + " " + prose(30)]
    + [prose(int(n)) for n in RNG.integers(1, 120, 20)] + [prose(6000)] + ["Line of text\n" * 40, "!!! ### !!!"]
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "r", 1, None, "z") for i, t in enumerate(TEXTS)]
    rows.append(rows[8])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_top_k(spark):
    vectors = RNG.integers(-3, 4, (90, 7))
    vectors[10:40] = vectors[10]  # ties
    rows = [(i, [j for j, x in enumerate(v) if x], [int(x) for x in v if x]) for i, v in enumerate(vectors)] + [(90, [], []), (91, [3], [2**40])]
    df = spark.createDataFrame(rows, "id long, terms array<int>, weights array<long>")
    found = collections.defaultdict(dict)
    for r in topk.top_k(df, df.where("id % 9 = 0"), 6).collect():
        found[r.query_id][r["rank"]] = (r.id, r.score)
    dense = {i: {j: x for j, x in zip(t, w)} for i, t, w in rows}
    for q in range(0, 92, 9):
        scores = sorted((-sum(x * dense[q].get(j, 0) for j, x in v.items()), i) for i, v in dense.items() if i != q)[:6]
        assert found[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(scores)}
    assert topk.top_k(df.limit(0), df, 3).count() == 0 and topk.top_k(df, df.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(1, [0.5, None]), (2, None), (3, [float("nan")]), (4, [float("inf")]), (5, [-0.01, 0.99]), (6, [])], "vec_id long, e array<float>")
    assert {r.vec_id: r.q for r in odd.select("vec_id", topk.quantised("e").alias("q")).collect()} == {1: None, 2: None, 3: None, 4: None, 5: [-1, 63], 6: []}


def test_pieces_are_the_tokenizers(docs):
    given = vocabulary("packing")
    tokenizer = Tokenizer.from_buffer(given)
    texts = [t or "" for t in TEXTS] + [" a  b\n c", "trail  ", "a \n b", "a\n \nb", "don't  can't", "   é"]
    ids = ranked_pieces(given, PATTERN).ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_have_their_ids():
    given = vocabulary("packing")
    tokenizer = Tokenizer.from_buffer(given)
    texts = ["end <|endoftext|> begin", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  c ", "<|endoftext", "plain text", "", "x\n<|endoftext|>\n é"]
    ids = [np.frombuffer(x, "<u4").tolist() for x in ranked_pieces(given, PATTERN).ids(texts)]
    assert ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and ids[0] == [437, 220, 50256, 2221]


def test_bpe(docs, empty):
    given = vocabulary("bpe")
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(given), special_tokens={})
    rows = bpe.decode(bpe.encode(docs, given, PATTERN), given, PATTERN).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == coder.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, given, PATTERN).count() == 0
    replay = bpe.MergeReplay(ranks_of(given))
    words = ["aaaaaaa", "abababab", "", "日本語テキスト", "=-=-===-=-", "z"]
    ids, counts = replay.encode([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [replay.one(w.encode()) for w in words]


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_buffer(vocabulary("packing"))
    rows = packing.pack(docs, vocabulary("packing"), PATTERN, size=64).collect()
    held, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        held[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, len(r.ids) // 4))
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for _, p, _ in sorted(held[i])[:: 2 if i == 8 else 1] for x in p] == ids or i == 8
        assert {n for *_, n in held[i]} == {len(ids)}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 64
    assert packing.pack(empty, vocabulary("packing"), PATTERN).count() == 0


def test_cuts_are_optimal():
    for _ in range(30):
        places = [0, *sorted(RNG.choice(np.arange(1, 60), 14, replace=False).tolist())]
        penalties = RNG.integers(0, 5, 15).tolist()
        if max(np.diff(places)) > 16:
            continue
        cost, _ = packing.cost_cuts(places, penalties, 16)
        best = [0.0]
        for j in range(1, 15):
            options = [(places[j] - places[i], best[i]) for i in range(j) if places[j] - places[i] <= 16]
            best.append(penalties[j] + min(b + (0 if n & (n - 1) == 0 else 16 - n) for n, b in options))
        assert cost == best


def test_lengths(docs, empty):
    tokenizer = Tokenizer.from_buffer(vocabulary("lengths"))
    sizes = np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in [*TEXTS, TEXTS[8]]])
    rows = lengths.length_histogram(lengths.encoded_lengths(docs, vocabulary("lengths"), PATTERN)).collect()
    assert {r.length: r.docs for r in rows} == collections.Counter(sizes.tolist())
    for r in rows:
        kept = np.minimum(sizes, r.length).sum()
        assert (r.docs_up_to, r.kept_tokens, r.cut_tokens, r.docs_beyond) == ((sizes <= r.length).sum(), kept, sizes.sum() - kept, (sizes > r.length).sum())
    assert lengths.length_histogram(lengths.encoded_lengths(empty, vocabulary("lengths"), PATTERN)).count() == 0


def test_deal(spark, docs, empty, monkeypatch):
    rows = deal.deal(docs, 5).collect()
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(TEXTS) + 1 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)
    assert deal.deal(empty, 5).count() == 0
    monkeypatch.setattr(deal, "CELL_ROWS", 50)
    many = deal.deal(spark.range(3001).repartition(4), 3).collect()
    assert all(sorted(r.slot for r in many if r.shard == s) == list(range(1000 + (s < 1))) for s in range(3))
    low = sum(r.id < 1500 for r in many if r.shard == 0)
    assert 400 < low < 600  # a uniform deal has 500 of them, give or take 14
    counts, room = np.array([5, 0, 9, 4]), np.array([6, 6, 6])
    matrix = np.array([deal.matrix_row(counts, room, i, 1) for i in range(4)])
    assert (matrix.sum(axis=0) == room).all() and (matrix.sum(axis=1) == counts).all() and (matrix >= 0).all()


def test_rules(docs, empty):
    book = rules.ledger(docs)
    for r in book.collect():
        words = (r.text or "").encode().split()
        words = [w.decode() for w in words]
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert bool(r.failed & 3) == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    bits = [r.failed for r in book.collect()]
    for policy, names in rules.POLICIES.items():
        assert rules.passing(docs, policy).count() == sum(not b & rules.mask(names) for b in bits)
        for r in rules.ablations(book, policy).collect():
            assert (r.failed, r.only) == (sum(bool(b & rules.mask((r.rule,))) for b in bits), sum(b & rules.mask(names) == rules.mask((r.rule,)) for b in bits))
    assert rules.ledger(empty).count() == 0 and rules.ablations(rules.ledger(empty), "strict-1").first().failed == 0


def test_long_texts_are_not_rejected_for_length(spark):
    draw = lambda n: " ".join(f"w{i}" for i in RNG.integers(0, n, 30_000))
    texts = [draw(5_000), draw(100), "", "few words stand here and so they pass"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in rules.passing(df, "clean-2").collect()} == {0, 2, 3}
    runs = [sum(len(set(w[i : i + 1000])) for i in range(0, len(w), 1000)) for w in map(str.split, texts)]
    assert [r.n_distinct_in_runs for r in rules.measured(df).orderBy("doc_id").collect()] == runs
    seen = {r.k: r["junk.word_variety"] for r in weak.observed(df).collect()}
    assert seen[0] == 0 and seen[1] == 1


def print_of(text, shingle):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    prints = [print_of(t, 3) for t in TEXTS]
    least = list(range(len(TEXTS)))
    for _ in TEXTS:
        least = [min(least[j] for j in range(len(TEXTS)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(TEXTS))]
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", least[r.doc_id]) for r in rows)
    assert simhash.near_duplicates(empty).count() == 0
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert groups[9] == 8 and groups[12] == 12


def test_two_passes_find_the_links_of_all_pairs(spark):
    values = RNG.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << RNG.choice(64, 4, replace=False).astype(np.uint64)) for _ in range(200)]
    near = np.unique(np.concatenate((values, np.repeat(values[:4], 50) ^ np.array(flips))))
    shard = np.zeros(len(near), int)
    pairs = {(i, j) for i in range(len(near)) for j in range(i + 1, len(near)) if int(near[i] ^ near[j]).bit_count() <= 8}
    seeds = np.concatenate([np.stack(x, 1) for x in simhash.found(near, shard, 8, "seeds")])
    seeds = {tuple(sorted(x)) for x in seeds.tolist()}
    assert {x for p in seeds for x in p} == {x for p in pairs for x in p} and len(seeds) < 2 * len(near)
    for roots in (np.arange(len(near)), np.arange(len(near)) // 7, np.zeros(len(near), int)):
        across = {(a, b) for x, y in simhash.found(near, shard, 8, "across", roots) for a, b in zip(x.tolist(), y.tolist())}
        assert across == {(i, j) for i, j in pairs if roots[i] != roots[j]}


def test_near_copies_link_by_similarity(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)]
    for i in range(40):
        copy = list(words)
        copy[int(RNG.integers(0, 400))] = f"new{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"v{i}x{k}" for i in range(300)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert groups == {i: 0 if i <= 40 else i for i in range(61)}


def test_equal_fingerprints_do_not_link_unlike_texts(spark):
    line = " ".join(f"common{i}" for i in range(7)) + " "
    own = [" ".join(f"own{k}x{i}" for i in range(630)) for k in range(8)]
    again = own[0].split()
    again[300] = "other"
    texts = [line * 80 + x for x in [*own, " ".join(again)]]
    assert len({print_of(t, 5) for t in texts}) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: i % 8 for i in range(9)}
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == want
    equal = spark.createDataFrame([(0, 7, 1, 5, i, i) for i in range(20)], "b int, key long, slices long, fp long, id long, root long")
    assert {tuple(sorted(r)) for r in simhash.links(equal, 13, mode="across").collect()} == {(i, j) for j in range(20) for i in range(j)}


def test_pairs_just_above_the_bound_are_found(spark):
    texts, wanted = [], []
    for i in range(300):  # pairs of 400 words; each changed word changes five shingles
        words = [f"d{i}x{k}" for k in range(400)]
        copy = list(words)
        for at in range(8, 400, 400 // (i % 8 + 1))[: i % 8 + 1]:
            copy[at] = f"new{i}"
        a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (words, copy))
        wanted.append(len(a & b) / len(a | b) >= 0.8)
        texts += [" ".join(words), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    linked = [groups[2 * i + 1] == 2 * i for i in range(300)]
    assert all(groups[2 * i] == 2 * i for i in range(300)) and not any(x and not w for x, w in zip(linked, wanted))
    assert sum(linked) >= 0.97 * sum(wanted)


def test_suffix_dedup_carries_columns(spark):
    rows = [(1, "abc " * 60, "x", None), (2, None, "y", 3), (None, "q" * 300, None, 4), (2, "abc " * 60, "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string, n int")
    found = suffixes.deduplicated(df, carry=("rest", "n")).collect()
    assert sorted((r.doc_id or 0, r.rest or "", r.n or 0) for r in found) == [(0, "", 4), (1, "x", 0), (2, "y", 3), (2, "z", 5)]


def test_index_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 40)
    values = RNG.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.concatenate([values] + [values[:30] ^ (np.uint64(1) << RNG.integers(0, 64, 30).astype(np.uint64)) for _ in range(4)])
    near = np.unique(np.concatenate((near, near[:40] ^ np.uint64(0b10010001), np.arange(300, dtype=np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    pairs = simhash.links(df).collect()
    label = {int(x): int(x) for x in near.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in pairs:
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() > 0
        label[root(r.u)] = root(r.v)
    signed = near.view(np.int64)
    for i in range(len(near)):
        for j in np.flatnonzero(np.bitwise_count(near ^ near[i]) <= 3):
            assert root(int(signed[i])) == root(int(signed[j]))


def test_crowded_shards_lose_no_wide_pair(spark, monkeypatch):
    center = RNG.integers(0, 2**63, 1, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << (16 + RNG.choice(48, 6, replace=False)).astype(np.uint64)) for _ in range(150)]
    near = np.unique(center ^ np.array(flips))  # all agree on the lowest block
    signed = [int(x) for x in near.view(np.int64)]
    want = {(i, j) for i in range(len(near)) for j in range(i + 1, len(near)) if int(near[i] ^ near[j]).bit_count() <= 13}
    place = {int(x): i for i, x in enumerate(near.view(np.int64))}
    for crowded in (simhash.CROWDED, 40):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        df = spark.createDataFrame([(0, 7, -(-len(near) // crowded), x, x, x) for x in signed], "b int, key long, slices long, id long, fp long, root long")
        assert {tuple(sorted((place[r.u], place[r.v]))) for r in simhash.links(df, 13, mode="across").collect()} == want


def test_classifier(spark, empty):
    stock = ["".join(RNG.choice(list("abcdefghilmnoprstu"), int(n))) for n in RNG.integers(2, 9, 900)]
    talk = lambda n: " ".join(RNG.choice(stock, int(n)))
    good = [talk(n) for n in RNG.integers(20, 90, 150)]
    bad = [" ".join(w + "###" for w in talk(40).split()) for _ in range(25)]
    rude = [talk(30) + " you are scum and trash " + talk(20) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(good + bad + rude)] + [(None, None), (500, ""), (0, good[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("junk", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(not 150 <= i < 175), int(i >= 175)) for i in range(200)] + [(4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    seen = settled(weak.observed(frame), "test-seen")
    for marks, most in ((labels, 4), (None, 50), (labels.limit(0), 50)):  # without annotations so few rows convince no one
        model = weak.fit(seen, marks)
        verdict = {r.doc_id: r.rejected for r in weak.score(seen, model).collect()}
        assert {r.doc_id for r in weak.passing(seen, model).collect()} == {k for k, bad in verdict.items() if not bad}
        wrong = sum(verdict[i] != (i >= 150) for i in range(200))
        assert wrong <= most and not verdict[500] and sum(verdict[i] for i in range(150)) <= 2
    nothing = settled(weak.observed(empty), "test-none")
    assert weak.score(nothing, weak.fit(nothing, labels)).count() == 0


@pytest.mark.parametrize("marked", [1, 20])
def test_few_annotations_do_not_shrink_the_fit(spark, monkeypatch, marked):
    rows = [(i, f"word{i % 50} and some other words of text number {i}") for i in range(2000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(marked)], "doc_id long, quality int, toxic int")
    seen = settled(weak.observed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "test-few")
    sizes, train = [], weak.train
    monkeypatch.setattr(weak, "FIT_ROWS", 100)
    monkeypatch.setattr(weak, "train", lambda places, soft, *a: sizes.append(len(places)) or train(places, soft, *a))
    weak.fit(seen, labels)
    assert sizes == [100, 100]


def test_accuracies_are_recovered():
    truth = RNG.random(20_000) < 0.3
    right = [0.9, 0.75, 0.65, 0.85]
    votes = np.stack([np.where(RNG.random(20_000) < r, truth, ~truth) for r in right], axis=1).astype(int)
    votes[RNG.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, found, prior = weak.estimate(patterns, counts.astype(float), np.full(4, 0.5))
    assert abs(prior - 0.3) < 0.03 and np.abs(found - np.array(right)[:, None]).max() < 0.05


def test_suffix_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(data[a : a + 100])
        want[i] = (len(data), gone.sum(), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(np.frombuffer(data, np.uint8)[~gone[:-1]]))
    rows = suffixes.deduplicated(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) == want[r.doc_id] for r in rows)
    assert suffixes.deduplicated(empty).count() == 0
    assert suffixes.deduplicated(docs.withColumn("doc_id", F.lit(None).cast("long"))).agg(F.sum("n_removed")).first()[0] == 0


def test_suffix_order():
    parts = [bytes(RNG.integers(97, 99, int(n)).astype(np.uint8)) for n in RNG.integers(30, 60, 12)] + [b"a" * 40, b"\0" * 35, b"ba" * 20]
    text, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    begins, owner = ends - [len(p) for p in parts], np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    wanted = np.array([len(p) - 19 for p in parts])
    order = suffixes.suffix_order(text, begins, ends, wanted, suffixes.eight(text, ends, owner), owner, 20)
    found = [text[i : i + 20].tobytes() for i in order]
    assert found == sorted(found) and len(found) == wanted.sum() and len(set(order.tolist())) == len(order)


def test_fm_dedup(docs, empty):
    words = {i: (t or "").encode().split() for i, t in enumerate(TEXTS)}
    counts = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in fmindex.deduplicated(docs).collect():
        mine = words[r.doc_id]
        gone = {i + k for i in range(len(mine) - 34) if counts[tuple(mine[i : i + 35])] > 1 for k in range(35)}
        assert (r.n_words, r.n_removed) == (len(mine), len(gone))
        assert bytes(r.text) == b" ".join(w for i, w in enumerate(mine) if i not in gone)
    assert fmindex.deduplicated(empty).count() == 0


@pytest.mark.parametrize("operator", ["fmindex", "suffixes"])
def test_crowded_anchors_are_split(spark, docs, monkeypatch, operator):
    """A passage in every text, with other surroundings: all windows at its edges have the same anchor."""
    module, turns = {"fmindex": fmindex, "suffixes": suffixes}[operator], []
    edge = " ".join(f"p{i}" for i in range(60))
    more = spark.createDataFrame([(1000 + i, " ".join(f"q{i}x{k}" for k in range(40)) + f" {edge} " + " ".join(f"r{i}x{k}" for k in range(40))) for i in range(300)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    want = sorted(map(tuple, module.deduplicated(both).collect()))
    fetched = anchors.fetched
    monkeypatch.setattr(anchors, "fetched", lambda *a: turns.append(fetched(*a)) or turns[-1])
    monkeypatch.setattr(anchors, "CROWDED", 100)
    monkeypatch.setattr(module, "SHARD_BYTES", 2_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(map(tuple, module.deduplicated(both).collect())) == want
        assert turns[0].where("not h").groupBy("g").count().agg(F.max("count")).first()[0] <= 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wavelet_ranks():
    values = RNG.integers(0, 37, 1000)
    index = fmindex.Wavelet(values, 37)
    for place in (0, 1, 63, 64, 65, 999, 1000):
        assert (index.rank(np.arange(37), np.full(37, place)) == np.bincount(values[:place], minlength=37)).all()


def test_long_texts_are_cut_like_short_ones(monkeypatch):
    monkeypatch.setattr(anchors, "STARTS", 100)
    values, cut = RNG.integers(97, 100, 1500).astype(np.uint8), anchors.Cut("bytes", 30, 8)
    covered = np.zeros(1500, int)
    for _, _, _, a, n in anchors.segments_of(values, np.array([0, 700, 700, 715, 1500]), cut):
        for x, y in zip(a, n):
            assert y > 0
        covered[0] += n.sum()
    assert covered[0] == (700 - 29) + (785 - 29)



import math
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from docquarry.functions.analysis import WORD, english_term
from docquarry.operators import search as srch
from docquarry.operators.catalog import CHUNK_COLUMNS, Catalog, parse
from docquarry.operators.index import FIELDS, build_index, open_index
from docquarry.operators.page import page_text, search_pages
from docquarry.operators.sizing import exact_sum
from docquarry.settings import CONTENT, REFERENCES, SearchSettings

TEXTS = {
    "README": "# Allotment\n\nThe allotment feeds forty families.\n\n## Watering\n\nBarrels are shared. See the rota.\n",
    "handbook/watering": "# Watering\n\nWater early in the day.\n\n## Rain barrels\n\nA rain barrel holds two hundred litres.\n\n## Hoses\n\nCoil a hose after use.\n",
    "handbook/seasons/frost": "# Cold nights\n\nFleece shields young leaves.\n",
    "handbook/soil": "# Ground work\n\nBeds are never trodden.\n\n## Compost\n\nTurn the heap with a fork monthly.\n\n## Green manure\n\nClover is dug in before flowering.\n",
    "handbook/tools/blades": "# Shed\n\n## Blade cleaning\n\nScrape compost, wash compost and wipe compost.\n",
    "handbook/plots": "# Allocation\n\n## Waiting list\n\nNames move up each spring.\n\n## Greenhouse keys\n\nBorrow the greenhouse key.\n",
    "handbook/pests": "# Pests\n\n## Leaves with holes\n\nLook for slugs at dusk.\n\n## Leaves with spots\n\nRemove sick foliage on frosty days.\n",
    "handbook/harvest": "---\nname: Harvest\ndescription: Yields\nkeywords: [preserves]\n---\n# Picking\n\nWeigh every basket.\n",
}


def chunks_of(spark, texts):
    rows = [(f"/c/{name}.md", f"{name}.md", text) for name, text in texts.items()]
    return Catalog.from_documents(parse(spark.createDataFrame(rows, "file_path string, relative_path string, raw string"), "doc")).chunks


@pytest.fixture(scope="module")
def index(spark):
    return build_index(chunks_of(spark, TEXTS), buckets=3)


def ranked(index, query, limit=25, settings=SearchSettings(), fuzziness=srch.field_fuzziness):
    rows = srch.candidates(index, srch.one_query(index, query), settings, limit, fuzziness, srch.hold_local).orderBy("rank").collect()
    return [(r.chunk_id.removeprefix("doc://"), r.score) for r in rows]


def rank_of(hits, address):
    return next((n for n, (chunk, _) in enumerate(hits, 1) if address in (chunk, chunk.split("#")[0])), 0)


def test_known_answers_in_one_batch(spark, index):
    expected = {
        "watering": "handbook/watering#watering",
        "rain barrel": "handbook/watering#rain-barrels",
        "frost": "handbook/seasons/frost#cold-nights",
        "compost": "handbook/soil#compost",
        "slugs": "handbook/pests#leaves-with-holes",
        "greenhouse key": "handbook/plots#greenhouse-keys",
        "clover": "handbook/soil#green-manure",
        "preserves": "handbook/harvest#picking",
        "watring": "handbook/watering#watering",
        "compst": "handbook/soil#compost",
        "greenhouze": "handbook/plots#greenhouse-keys",
        "compsot": None,
        "harvset": None,
        "the and of": None,
    }
    queries = spark.createDataFrame(list(enumerate(expected)), "query_id long, query string")
    first = {r.query_id: r.chunk_id for r in srch.candidates(index, queries, limit=25).filter("rank = 1").collect()}
    for number, (query, target) in enumerate(expected.items()):
        if target is None:
            assert number not in first, query
        else:
            assert first[number].removeprefix("doc://").startswith(target), query


def test_path_labels_match_exactly(index):
    shipped = ranked(index, "plow")
    everywhere = ranked(index, "plow", fuzziness=lambda field: 1)
    nowhere = ranked(index, "plow", fuzziness=lambda field: 0)
    assert rank_of(shipped, "handbook/plots") == rank_of(nowhere, "handbook/plots") == 0 < rank_of(everywhere, "handbook/plots")


@pytest.mark.parametrize(("boost", "heading", "body"), [(0.0, 2, 1), (2.5, 1, 2), (1000.0, 1, 2)])
def test_heading_boost(index, boost, heading, body):
    hits = ranked(index, "compost", settings=replace(SearchSettings(), heading_boost=boost))
    assert (rank_of(hits, "handbook/soil#compost"), rank_of(hits, "handbook/tools/blades#blade-cleaning")) == (heading, body)


def test_any_and_every_term(spark, index):
    found = srch.clause_matches(index, srch.one_query(index, "slugs compost pests"), ("heading_path", "source_title", "content"))
    counts = {r.field: (r.any, r.all) for r in found.groupBy("field").agg(F.count("*").alias("any"), F.count_if("every_term").alias("all")).collect()}
    assert all(any_ > 0 and all_ == 0 for any_, all_ in counts.values()) and len(counts) == 3


def brute_force(chunks, query, boosts, fuzziness):
    """The ranking formula, term by term over plain Python collections."""

    def terms(text):
        return [t for t in (english_term(m.group()) for m in WORD.finditer(text)) if t is not None]

    def near(a, b):
        if a == b:
            return 0
        short, long = sorted((a, b), key=len)
        if len(long) - len(short) == 1:
            return 1 if any(long[:i] + long[i + 1 :] == short for i in range(len(long))) else None
        return 1 if len(long) == len(short) and sum(x != y for x, y in zip(a, b)) == 1 else None

    texts = {(c.chunk_id, f): Counter(terms(" ".join(c[f]) if isinstance(c[f], list) else c[f])) for c in chunks for f in FIELDS}
    df = Counter((f, t) for (_, f), counted in texts.items() for t in counted)
    asked = Counter(terms(query))
    leaves, squares = {}, 0.0
    for field, boost in boosts.items():
        for q, repeats in asked.items():
            options = {t: near(q, t) for f, t in df if f == field} if fuzziness(field) else {q: 0}
            for t, distance in options.items():
                if distance is not None:
                    idf = 1 + math.log(len(chunks) / (df[field, t] + 1))
                    weight = boost / (1 + distance) * idf
                    squares += repeats * weight**2
                    leaves.setdefault((field, q), {})[t] = (idf, weight)
    scores = {}
    for c in chunks:
        total, matched_fields = 0.0, 0
        for field in boosts:
            counted = texts[c.chunk_id, field]
            field_sum = tokens = 0
            for q, repeats in asked.items():
                group = leaves.get((field, q), {})
                found = [t for t in group if t in counted]
                if found:
                    leaf = sum(math.sqrt(counted[t]) / math.sqrt(counted.total()) * group[t][0] * group[t][1] / math.sqrt(squares) for t in found)
                    field_sum += repeats * leaf * len(found) / len(group)
                    tokens += repeats
            if tokens:
                total += field_sum * tokens / asked.total()
                matched_fields += 1
        if matched_fields:
            scores[c.chunk_id] = total * matched_fields / len(boosts)
    return scores


@pytest.mark.parametrize("query", ["rain barrel", "leaf leaves compost", "wipi clover frost key", "allotment"])
def test_scores_equal_brute_force(index, query):
    chunks = index.chunks.collect()
    expected = brute_force(chunks, query, SearchSettings().boosts(), srch.field_fuzziness)
    found = ranked(index, query, 100)
    assert {f"doc://{c}": pytest.approx(s, abs=1e-9) for c, s in found} == expected
    assert [c for c, _ in found] == [c for c, _ in sorted(found, key=lambda x: (-x[1], x[0].split("#")[0], x[0]))]


def made(spark, *rows):
    """Chunks with given fields; everything else is empty."""
    lists = {"path_labels", "heading_path", "keywords"}
    numbers = {"part", "part_count", "start_line", "end_line"}
    schema = ", ".join(f"{n} {'array<string>' if n in lists else 'int' if n in numbers else 'string'}" for n in CHUNK_COLUMNS)
    full = [[row.get(n, [] if n in lists else 1 if n in numbers else "") for n in CHUNK_COLUMNS] for row in rows]
    return spark.createDataFrame(full, schema)


def test_field_boosts_and_title_snippet(spark):
    fields = [("keywords", ["oauth"]), ("heading_path", ["oauth"]), ("source_title", "oauth"), ("path_labels", ["oauth"]), ("content", "oauth")]
    rows = [dict(chunk_id=f"c{i}", source_id=f"s{i}", source_uri=f"doc://{9 - i}", chunk_uri=f"u{i}", content="unrelated") | {n: v} for i, (n, v) in enumerate(fields)]
    index = build_index(made(spark, *rows, dict(chunk_id="t", source_uri="doc://t", source_title="Title fallback")), buckets=2)
    assert [c for c, _ in ranked(index, "oauth")] == ["c0", "c1", "c2", "c3", "c4"]
    (hit,) = srch.search(index, "fallback").collect()
    assert hit.snippet == "Title fallback"
    assert [r.chunk_id for r in srch.search(index, "*", limit=3).collect()] == ["c4", "c3", "c2"]
    assert srch.search(index, "oauth", SearchSettings(max_results=2)).count() == 2
    assert srch.search(None, "oauth") is None


def test_ties_storage_and_layout_do_not_change_ranking(spark):
    same = [("b", "doc://b"), ("c", "doc://a"), ("a", "doc://a")]
    rows = [dict(chunk_id=i, source_uri=u, chunk_uri=i, content="identical words lantern") for i, u in same]
    more = [dict(chunk_id=f"m{i}", source_uri=f"doc://m{i % 3}", content="identical " * (1 + i % 4) + "other words") for i in range(30)]
    first = build_index(made(spark, *rows, *more), buckets=1)
    base = ranked(first, "identical words")
    assert [c for c, _ in ranked(first, "lantern")] == ["a", "c", "b"]
    second = build_index(made(spark, *more[::-1], *rows).repartition(5), buckets=7, in_memory=True)
    assert ranked(second, "identical words") == base
    assert ranked(open_index(spark, second.location), "identical words") == base
    second.release()
    assert ranked(open_index(spark, second.location), "identical words") == base


def test_large_limit_uses_salted_pruning(spark):
    scored = spark.range(3000).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("chunk_no"), (F.col("id") % 7).cast("double").alias("score"))
    wide, narrow = srch.best(scored, 1200), srch.best(scored, 5)
    expected = sorted((r.query_id, r.chunk_no) for r in narrow.collect())
    assert expected == sorted((r.query_id, r.chunk_no) for r in wide.filter("rank <= 5").collect())
    assert wide.count() == 2400


@pytest.mark.parametrize(("flood", "others", "limit", "size"), [(3, 2, 10, 3), (60, 12, 10, 10), (900, 3, 10, 4), (900, 3, 2, 2), (5, 5, 0, 0)])
def test_pages_look_past_a_flooding_source(spark, flood, others, limit, size):
    sources = [0] * flood + [1 + i // 2 for i in range(2 * others)]
    rows = [(0, n, source, 1.0 / (n + 1)) for n, source in enumerate(sources)]
    scored = spark.createDataFrame(rows, "query_id long, chunk_no long, source_no long, score double")
    page = srch.best(srch.capped(scored, 1), limit).orderBy("rank").collect()
    assert [r.source_no for r in page] == list(range(size)) and [r.rank for r in page] == list(range(1, size + 1))


def test_flooded_index_and_odd_folder(spark, tmp_path):
    rows = [dict(chunk_id=f"f{i:03}", source_id="f", source_uri="doc://f", content="lamp " * 3) for i in range(300)]
    rows += [dict(chunk_id=f"s{i}", source_id=f"s{i}", source_uri=f"doc://s{i}", content="lamp " + "shade " * (1 + i)) for i in range(3)]
    index = build_index(made(spark, *rows), location=str(tmp_path / "reader's index"), buckets=3)
    queries = spark.createDataFrame([(1, "lamp"), (2, "*")], "query_id long, query string")
    for mode, first in ((REFERENCES, ["f000", "s0", "s1", "s2"]), (CONTENT, ["f000", "f001", "s0", "s1", "s2"])):
        pages = search_pages(index, queries, SearchSettings(result_mode=mode)).orderBy("query_id", "position").collect()
        assert [r.chunk_id for r in pages if r.query_id == 1] == [r.chunk_id for r in pages if r.query_id == 2] == first


def test_sums_have_no_ceiling_in_reach(spark):
    rows = spark.range(200_000).select((F.lit(1.0) + F.col("id") / 7).alias("x"))
    total = rows.agg(exact_sum(F.col("x")).alias("s")).first().s
    assert total == pytest.approx(200_000 + 199_999 * 200_000 / 14, rel=1e-12)
    assert rows.repartition(7).agg(exact_sum(F.col("x")).alias("s")).first().s == total


def test_pages(spark, index):
    queries = spark.createDataFrame([(1, "compost"), (2, "zzz")], "query_id long, query string")
    references = {r.query_id: r.page for r in page_text(queries, search_pages(index, queries, SearchSettings()), REFERENCES).collect()}
    assert references[2] == "No results found for 'zzz'"
    assert references[1].startswith(
        "Search results for 'compost':\n\n- **Ground work** · [doc://handbook/soil#compost](doc://handbook/soil#compost)\n"
        "  - handbook/soil.md > Ground work > Compost · lines 5-7 · score "
    )
    assert "<mark>Compost</mark>" in references[1] and references[1].endswith("\n\n")
    content = page_text(queries, search_pages(index, queries, SearchSettings(result_mode=CONTENT)), CONTENT).filter("query_id = 1").first().page
    assert "\n## Compost\n\nTurn the heap with a fork monthly.\n\n" in content


def test_many_terms_without_broadcast(spark, index, monkeypatch):
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(("greenhouse key", "rain barrel", "compost"))], "query_id long, query string")
    expected = sorted(srch.candidates(index, queries, limit=25).collect())
    monkeypatch.setattr("docquarry.operators.sizing.BROADCAST_ROWS", 0)
    monkeypatch.setattr("docquarry.operators.search.BROADCAST_ROWS", 0)
    assert sorted(srch.candidates(index, queries, limit=25).collect()) == expected

import os

import pytest
from pyspark.sql import functions as F

from docquarry.functions.globs import PatternError
from docquarry.operators.catalog import Catalog, CatalogError, UnknownFragment, UnknownResource, parse, read_many, reject_or_skip
from docquarry.operators.diff import listing_diff
from docquarry.operators.digests import content_digest, listing_digest, value
from docquarry.operators.links import link_transformer, rewrite_links
from docquarry.sources.discovery import discover
from docquarry.sources.files import dealt
from docquarry.sources.listing import ListingError, Selection, as_path, as_text, list_files

EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def names(listing):
    return [r.relative_path for r in listing.orderBy("path").collect()]


TREE = {
    "about.md": "# Seed library\n", "beds/north/peas.md": "# Peas\nx\n", "beds/south.MD": "# South\nx\n", "beds/old/1999.md": "o\n", "loans/open[1].md": "l\n",
    "loans/open1.md": "l\n", "vendor/soil.md": "v\n", "beds/vendor/tools.md": "t\n", ".git/packed.md": "g\n",
}


@pytest.mark.parametrize(
    ("include", "exclude", "lenient", "expected"),
    [
        (("beds/*/*.md",), ("beds/{old,vendor}/*",), False, ["beds/north/peas.md"]),
        (("beds/**", "ab?ut.md"), ("**/[0-9]*.md",), True, ["about.md", "beds/north/peas.md", "beds/south.MD"]),
        (("loans/open?1?.md", "vendor/*.md"), (), False, ["loans/open[1].md", "vendor/soil.md"]),
        (("**/*.[mM][dD]",), ("loans/**",), True, ["about.md", "beds/north/peas.md", "beds/old/1999.md", "beds/south.MD"]),
        (("**",), ("beds/**", "loans/**"), False, ["about.md", "vendor/soil.md"]),
    ],
)
def test_selection(spark, tree, include, exclude, lenient, expected):
    listing = list_files(spark, tree(**TREE), Selection(include, exclude, lenient), budget=2)
    assert names(listing) == expected


def test_symlinks_and_special_names(spark, tree):
    root = tree(**{"docs/_hidden[1].md": "# H\n", "docs/.dot.md": "# D\n"})
    os.symlink(f"{root}/docs/.dot.md", f"{root}/docs/link.md")
    os.symlink(f"{root}/docs", f"{root}/linked")
    assert names(list_files(spark, root, Selection(("**/*.md",)))) == ["docs/.dot.md", "docs/_hidden[1].md"]


def test_bad_roots_and_patterns(spark, tree):
    with pytest.raises(ListingError):
        list_files(spark, tree.root + "/gone", Selection(("*.md",)))
    with pytest.raises(PatternError):
        list_files(spark, tree.root, Selection(("../x",)))
    assert list_files(spark, tree.root + "/gone", Selection(legacy=True)).isEmpty()


def test_strict_and_lenient_loading(spark, tree):
    root = tree(**{"a.md": "# A\nx\n", "b.md": "---\nbad: : x\n---\n", "c\nd.md": "# C\nx\n"})
    selection = Selection(("*.md",))
    with pytest.raises(CatalogError, match="b.md"):
        reject_or_skip(discover(spark, root, selection, "doc"), False)
    lenient = Selection(("*.md",), (), True)
    assert [r.uri for r in reject_or_skip(discover(spark, root, lenient, "doc"), True).collect()] == ["doc://a"]
    with pytest.raises(CatalogError, match="no files"):
        discover(spark, root, Selection(("none/*.md",)), "doc")
    assert discover(spark, root, Selection(("none/*.md",), (), True), "doc").isEmpty()
    tree.put("x.txt", "x")
    with pytest.raises(CatalogError, match="not Markdown"):
        discover(spark, root, Selection(("*.txt",), (), True), "doc")


def test_legacy_loading(spark, tree):
    root = tree(**{
        "ok.md": "---\nname: N\ndescription: D\n---\nx\n", "broken.md": "---\na: : b\n---\n", "none.md": "# x\n",
        "nodesc.md": "---\nname: N\n---\n", "t.txt": "x",
    })
    documents = reject_or_skip(discover(spark, root, Selection(legacy=True), "doc"), True)
    assert [(r.uri, r.name, r.description) for r in documents.collect()] == [("doc://ok", "N", "D")]


def test_full_records(spark, tree):
    root = tree(**{"docs/clientGuide.md": "---\r\nname: Example\r\nkeywords: [k]\r\n---\r\n# Title\r\n\r\nBody é.\r\n"})
    documents = discover(spark, root, Selection(("**/*.md",)), "doc")
    catalog = Catalog.from_documents(documents.filter("error is null"))
    (source,) = catalog.sources.collect()
    assert source.name == "Example" and source.description == "Body é." and source.body_start_line == 5
    assert source.content == "# Title\n\nBody é.\n" and source.path_labels == ["docs", "client", "guide"]
    (chunk,) = catalog.chunks.collect()
    assert (chunk.chunk_id, chunk.start_line, chunk.end_line, chunk.content) == ("doc://docs/clientGuide#title", 5, 7, "# Title\n\nBody é.\n")
    assert (chunk.source_title, chunk.source_path, chunk.keywords, chunk.heading_path) == ("Example", "docs/clientGuide.md", ["k"], ["Title"])


def documents_of(spark, **texts):
    rows = [(f"/c/{name}.md", f"{name}.md", text) for name, text in texts.items()]
    return parse(spark.createDataFrame(rows, "file_path string, relative_path string, raw string"), "doc")


def test_reads(spark):
    p = "p" * 2500
    catalog = Catalog.from_documents(documents_of(spark, a=f"# Setup\n\n{p}\n\n{p}\n", b="x\n"))
    assert catalog.read("doc://a").startswith("# Setup")
    assert catalog.read("doc://a#setup~2") == p + "\n"
    assert catalog.read("doc://a#setup") == f"# Setup\n\n{p}\n\n\n{p}\n"
    with pytest.raises(UnknownFragment):
        catalog.read("doc://a#gone")
    with pytest.raises(UnknownResource) as error:
        catalog.read("doc://gone")
    assert not isinstance(error.value, UnknownFragment)


def test_many_reads_move_addresses_before_texts(spark):
    p = "p" * 2500
    texts = {"a": f"# Setup\n\n{p}\n\n{p}\n\n## One\n\nx\n", "b": "z\n"}
    catalog = Catalog.from_documents(documents_of(spark, **texts))
    asked = ["doc://a", "doc://a#setup", "doc://a#setup~2", "doc://a#one", "doc://a#gone", "doc://a#one#gone", "doc://gone", "doc://b", "doc://b", None]
    read = read_many(catalog, spark.createDataFrame([(u,) for u in asked], "uri string"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # parts of a section, and the two sides of what is missing; every join exchanged the texts before
    got = {r.uri: (r.kind, r.content) for r in read.collect()}
    kinds = {u: kind for u, (kind, _) in got.items()}
    assert len(got) == 9 and read.count() == 9
    assert kinds == {
        "doc://a": "document", "doc://a#setup": "section", "doc://a#setup~2": "chunk", "doc://a#one": "chunk", "doc://a#gone": "unknown fragment", "doc://a#one#gone": "unknown fragment",
        "doc://gone": "unknown resource", "doc://b": "document", None: "unknown resource",
    }
    assert got["doc://a#setup"][1] == catalog.read("doc://a#setup") and got["doc://a"][1] == catalog.read("doc://a")
    marked = catalog.with_transformer(lambda df: df.withColumn("content", F.concat("content", "file_path")))
    assert {r.content for r in read_many(marked, spark.createDataFrame([("doc://b",)], "uri string")).collect()} == {"z\n/c/b.md"}


def test_transformers_apply_in_order(spark):
    add = lambda mark: lambda df: df.withColumn("content", F.concat("content", F.lit(mark)))
    catalog = Catalog.from_documents(documents_of(spark, a="# T\nx\n")).with_transformer(add("1")).with_transformer(add("2"))
    assert catalog.read("doc://a") == catalog.read("doc://a#t") == "# T\nx\n12"
    assert [r.content for r in catalog.indexed_chunks().collect()] == [r.content for r in catalog.documents().collect()] == ["# T\nx\n12"]


def test_duplicates(spark):
    rows = [("/c/g.md", "g.md", "x"), ("/c/g.markdown", "g.markdown", "y")]
    documents = parse(spark.createDataFrame(rows, "file_path string, relative_path string, raw string"), "doc")
    with pytest.raises(CatalogError, match="duplicate source URI: doc://g"):
        Catalog.from_documents(documents)
    good = Catalog.from_documents(documents_of(spark, a="x\n"))
    for column, message in (("chunk_id", "chunk ID"), ("chunk_uri", "chunk URI")):
        twice = good.chunks.unionByName(good.chunks.withColumn("chunk_uri" if column == "chunk_id" else "chunk_id", F.lit("other")))
        with pytest.raises(CatalogError, match=message):
            Catalog.build(good.sources, twice)


LINKS = [
    ("See [other](other.md) now.", "See [other](doc://other) now."),
    ("[i](../guides/intro.md)", "[i](doc://guides/intro)"),
    ("[s](./other.md)", "[s](doc://other)"),
    ("[g](other.md#setup)", "[g](doc://other#setup)"),
    ('[g](other.md#in "The Guide")', '[g](doc://other#in "The Guide")'),
    ("[e](https://example.com) [m](mailto:a@b.c) [f](#x) ![a](other.md) [u](none.md)", None),
    ("[a](other.md)[b](../guides/intro.md)", "[a](doc://other)[b](doc://guides/intro)"),
    ("First\n[](other.md)\nlast", "First\n[](doc://other)\nlast"),
    ("plain", None),
    ("", None),
]


def test_link_rewriting(spark):
    rows = [(i, "/c/r/current.md", text) for i, (text, _) in enumerate(LINKS)]
    frame = spark.createDataFrame(rows, "id int, file_path string, content string")
    targets = spark.createDataFrame([("/c/r/other.md", "doc://other"), ("/c/guides/intro.md", "doc://guides/intro")], "file_path string, uri string")
    found = {r.id: r.content for r in rewrite_links(frame, targets, "id").collect()}
    assert found == {i: want if want is not None else text for i, (text, want) in enumerate(LINKS)}
    nothing = rewrite_links(frame, targets.limit(0), "id")
    assert {r.id: r.content for r in nothing.collect()} == {i: text for i, (text, _) in enumerate(LINKS)}


def test_links_in_chunks(spark):
    catalog = Catalog.from_documents(documents_of(spark, a="# A\n[b](b.md)\n", b="# B\nx\n"))
    linked = catalog.with_transformer(link_transformer(catalog.sources))
    assert linked.read("doc://a#a") == "# A\n[b](doc://b)\n"
    assert {r.chunk_id: r.content for r in linked.indexed_chunks().collect()} == {"doc://a#a": "# A\n[b](doc://b)\n", "doc://b#b": "# B\nx\n"}


def test_digests(spark):
    listing = spark.createDataFrame([("a.md", 1, 5), ("b.md", 2, 6)], "relative_path string, size long, mtime_ns long")
    base = value(listing_digest(listing))
    assert base == value(listing_digest(listing.orderBy(F.desc("size")).repartition(3)))
    assert value(listing_digest(listing.limit(0))) == EMPTY_HASH
    for changed in (
        listing.filter("size = 1"), listing.withColumn("size", F.col("size") + 1), listing.withColumn("mtime_ns", F.col("mtime_ns") + 1),
        listing.withColumn("relative_path", F.concat("relative_path", F.lit("x"))),
    ):
        assert value(listing_digest(changed)) != base
    sources = spark.createDataFrame([("u", "f")], "uri string, fingerprint string")
    assert value(content_digest(sources)) != value(content_digest(sources.withColumn("fingerprint", F.lit("g"))))


def test_listing_diff(spark):
    schema = "uri string, name string, description string, mime_type string"
    old = spark.createDataFrame([("doc://k", "k", "d", "m"), ("doc://r", "r", "d", "m"), ("doc://c", "c", "d", "m")], schema)
    new = spark.createDataFrame([("doc://k", "k", "d", "m"), ("doc://c", "c", "e", "m"), ("doc://a", "a", "d", "m"), ("doc://b\n", "b", "d", "m")], schema)
    assert {(r.uri, r.change) for r in listing_diff(old, new).collect()} == {("doc://r", "removed"), ("doc://c", "changed"), ("doc://a", "added")}
    assert listing_diff(old, old).isEmpty()


def test_names_that_are_no_text(spark, tree):
    root = tree(**{"plain.md": "# P\nx\n", "private\U0010ff90.md": "# Q\nx\n"})
    with open(os.fsencode(root) + b"/caf\xe9.md", "wb") as file:
        file.write(b"# Coffee\nx\n")
    os.mkdir(os.fsencode(root) + b"/d\xff")
    with open(os.fsencode(root) + b"/d\xff/in.md", "wb") as file:
        file.write(b"# Inside\nx\n")
    listing = list_files(spark, root, Selection(("**/*.md",)))
    assert all(as_text(as_path(n)) == n for n in names(listing)) and len(names(listing)) == 4
    documents = reject_or_skip(discover(spark, root, Selection(("**/*.md",)), "doc"), False)
    assert sorted(r.name for r in documents.collect()) == ["Coffee", "Inside", "P", "Q"]


def test_reading_is_dealt_by_bytes(spark):
    rows = [(f"/r/{i:05}", f"{i:05}", 1 << 30 if i == 137 else 40_000) for i in range(10_000)]
    listing = spark.createDataFrame(rows, "path string, relative_path string, size long").repartition(5)
    placed, tasks = dealt(listing, 8)
    held = {r.task: (r.n, r.b) for r in placed.groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    assert sum(n for n, _ in held.values()) == 10_000 and max(held) < tasks
    small = [b for n, b in held.values() if n > 140]
    assert max(small) <= 2 * sorted(small)[len(small) // 2] and max(n for n, b in held.values() if b >= 1 << 30) < 4_000
    assert dealt(listing.limit(0), 8)[0].count() == 0

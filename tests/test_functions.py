import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.functions import globs, paths, templates
from docquarry.functions.analysis import count_terms, english_terms, plain_terms
from docquarry.functions.snippets import extract
from docquarry.functions.stemming import stem


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("readiness", "readi"), ("authentication", "authent"), ("authentcation", "authentc"), ("compaction", "compact"),
        ("compation", "compat"), ("checksums", "checksum"), ("cheksums", "cheksum"), ("kubernetes", "kubernet"),
        ("kubernets", "kubernet"), ("deployment", "deploy"), ("deploymnet", "deploymnet"), ("authorization", "author"),
        ("authorisation", "authoris"), ("relational", "relat"), ("hopping", "hop"), ("flies", "fli"), ("sky", "sky"),
        ("agreed", "agre"), ("controlling", "control"),
    ],
)
def test_stemming(word, expected):
    assert stem(word) == expected


def test_words():
    assert english_terms("Ledger's") == ("ledger",)
    assert english_terms("don't") == () and english_terms("example.com,") == ("example.com",)
    assert english_terms("(日本)") == ("日", "本")
    assert plain_terms("Été-d'un") == ("été", "d", "un")


def test_term_counts_of_a_batch():
    found = count_terms(pa.array(["the quick quick fox's", None, "", "fox jumps. fox"]), english_terms).to_pylist()
    assert found[0] == [{"term": "quick", "tf": 2, "total": 3}, {"term": "fox", "tf": 1, "total": 3}]
    assert found[1] == found[2] == []
    assert found[3] == [{"term": "fox", "tf": 2, "total": 3}, {"term": "jump", "tf": 1, "total": 3}]


def test_snippets():
    assert extract("no match here", {"zebra"}) == "no match here"
    assert extract("A zebra runs", {"zebra"}) == "A <mark>zebra</mark> runs"
    long = "x " * 300 + "zebra " + "y " * 300
    shown = extract(long, {"zebra"})
    assert "<mark>zebra</mark>" in shown and shown.startswith("…") and shown.endswith("…") and len(shown) < 230


@pytest.mark.parametrize(
    ("include", "allowed", "denied"),
    [
        ([], [], ["maps"]),
        (["index.txt", "?ndex.txt"], [], ["maps", "index.txt"]),
        (["maps/*/legend.md"], ["maps", "maps/alps", "maps/jura"], ["maps/alps/west", "legend", "map"]),
        (["m?ps/20[12]*/x.md"], ["maps", "mops/2019", "maps/2024"], ["maps/1999", "mps", "maps/2024/x.md"]),
        (["maps/**/legend.md", "log/*.md"], ["maps/a/b/c", "log"], ["log/a", "logs"]),
        (["**/legend.md"], ["anything", "any/thing"], []),
        (["{maps,logs}/*/a.md"], ["maps", "logs/b"], ["map", "maps/b/c"]),
        (["{maps/alps,logs}/a.md"], ["maps/alps", "logs"], []),
        (["maps/**"], ["maps", "maps/a/b"], ["logs"]),
    ],
)
def test_reach(include, allowed, denied):
    reach = globs.Reach(include)
    assert reach.allows(".")
    assert all(map(reach.allows, allowed)) and not any(map(reach.allows, denied))


@pytest.mark.parametrize("pattern", ["/tmp/*.md", "../docs/*.md", "docs/[.md", "C:/x", "{a", "a/../../b"])
def test_bad_patterns(pattern):
    with pytest.raises(globs.PatternError):
        globs.validate([pattern])


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("docs/**/*.md", ["docs/a.md", "docs/x/y/a.md"], ["docs/a.txt", "a.md"]),
        ("*.md", ["a.md"], ["d/a.md"]),
        ("**/*.md", ["a.md", "d/e/a.md"], ["a.mdx"]),
        ("d?c/[!x]*.{md,txt}", ["doc/a.md", "dac/b.txt"], ["doc/xa.md", "d/c/a.md"]),
        ("docs\\*.md", ["docs/a.md"], ["docs"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    rows = spark.createDataFrame([(name,) for name in yes + no], "p string")
    found = {r.p for r in rows.filter(globs.selected(F.col("p"), [pattern], [])).collect()}
    assert found == set(yes)


def test_path_columns(spark):
    rows = spark.createDataFrame(
        [("Docs/clientCredentials/oauth_oauth.md", "/c/r/cur.md", "../deep/./n/doc.md"), ("a.b/c", "/x.md", "../../y")], "p string, f string, t string"
    )
    first, second = rows.select(
        paths.path_labels(F.col("p")).alias("labels"),
        paths.source_uri(F.col("p"), "doc").alias("uri"),
        paths.resolve_path(paths.parent_dir(F.col("f")), F.col("t")).alias("to"),
    ).collect()
    assert first.labels == ["docs", "client", "credentials", "oauth"] and first.to == "/c/deep/n/doc.md"
    assert second.uri == "doc://a.b/c"
    uris = {"doc://a/b": True, "doc://a\nb": False, "doc://a/%zz": False, "doc://a b/c": False, "doc://a/b c": True}
    frame = spark.createDataFrame(list(uris.items()), "u string, want boolean")
    assert all(r.got == r.want for r in frame.select("want", paths.addressable(F.col("u")).alias("got")).collect())


def test_templates(spark):
    nodes = templates.parse("Hi {{.who}}{{if .tone}} ({{.tone}}){{else}}!{{end}} {{- /* note */ -}}  {{.gone}}.")
    rows = spark.createDataFrame([("Ann", "warm"), ("Bob", None)], "who string, tone string")
    text = templates.render(nodes, {"who": F.col("who"), "tone": F.col("tone")})
    assert [r[0] for r in rows.select(text).collect()] == ["Hi Ann (warm).", "Hi Bob!."]
    for bad in ("{{.a", "{{if .a}}", "{{range .x}}{{end}}", "{{end}}"):
        with pytest.raises(templates.TemplateError):
            templates.parse(bad)

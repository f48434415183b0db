import os
import threading

import pytest


from docquarry import settings as st
from docquarry.operators.catalog import UnknownResource
from docquarry.plans.engine import Engine, EngineClosed
from docquarry.session import shared_folder
from docquarry.sources import manifest as man
from docquarry.sources.prompts import PromptError, discover_prompts, get_prompt, list_prompts, render_prompts
from docquarry.streaming.refresh import Revalidator


class Steps:
    """A refresh with scripted answers and a clock of its own."""

    def __init__(self, listing="l1", content="c1", fail=None):
        self.time, self.listing, self.content, self.fail, self.calls = 100.0, listing, content, fail, []
        self.revalidator = Revalidator(
            lambda: self.step("list", self.listing), lambda: self.step("discover", "found"),
            lambda found: self.step("digest", self.content), lambda found: self.step("publish", None),
            "l1", "c1", 2.0, lambda: self.time,
        )

    def step(self, name, answer):
        self.calls.append(name)
        if name == self.fail:
            raise RuntimeError(name)
        return answer


@pytest.mark.parametrize(
    ("listing", "content", "calls", "published"),
    [("l1", "c1", ["list"], False), ("l2", "c1", ["list", "discover", "digest"], False), ("l2", "c2", ["list", "discover", "digest", "publish"], True)],
)
def test_refresh_steps(listing, content, calls, published):
    steps = Steps(listing, content)
    assert steps.revalidator.revalidate() is published and steps.calls == calls
    assert (steps.revalidator.listing, steps.revalidator.content) == (listing, content)
    assert steps.revalidator.revalidate() is False and steps.calls == calls  # within the interval
    steps.time += 2
    assert steps.revalidator.revalidate() is False and steps.calls == [*calls, "list"]


@pytest.mark.parametrize("fail", ["list", "discover", "digest", "publish"])
def test_failed_refresh_keeps_everything(fail):
    steps = Steps("l2", "c2", fail)
    assert steps.revalidator.revalidate() is False
    assert (steps.revalidator.listing, steps.revalidator.content) == ("l1", "c1")
    seen = len(steps.calls)
    assert steps.revalidator.revalidate() is False and len(steps.calls) == seen
    steps.fail, steps.time = None, steps.time + 2
    assert steps.revalidator.revalidate() is True


def test_concurrent_callers_refresh_once():
    steps = Steps("l2", "c2")
    threads = [threading.Thread(target=steps.revalidator.revalidate) for _ in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert steps.calls.count("publish") == 1


def test_engine_end_to_end(spark, tree):
    tree(**{
        "README.md": "# Project\n\nSee [guide](docs/guide.md#install).\n", "docs/guide.md": "# Guide\n\n## Install\n\nRun the installer.\n",
        "docs/build/no.md": "# No\nx\n", "src/notes.md": "# No\nx\n", "docs/bad.md": "---\na: : b\n---\n",
        ".docquarry/prompts/greet.md": "---\nname: greet\ndescription: d\narguments:\n  - name: who\n---\nHello {{.who}}",
    })
    clock = [0.0]
    engine = Engine.open(spark, st.Settings(content_dir=tree.root, cross_ref=True), now=lambda: clock[0])
    assert [r.uri for r in engine.resources().collect()] == ["doc://README", "doc://docs/guide"]
    assert "[doc://docs/guide#install]" in engine.search_page("installer")
    assert engine.read("doc://README") == "# Project\n\nSee [guide](doc://docs/guide#install).\n"
    assert engine.prompt("greet", who="Ann") == {"description": "Rendered prompt: greet", "messages": [{"role": "user", "text": "Hello Ann"}]}
    assert engine.document_count() == 2 and engine.tool("search").name == "search"
    held = engine.holder.current

    tree.put("docs/new.md", "# New\n\nFresh walnut.\n")
    tree.put("docs/bad.md", "# Fixed\n\nNow readable.\n")
    (__import__("pathlib").Path(tree.root) / "README.md").unlink()
    assert not engine.revalidate()
    clock[0] = 3.0
    asked = spark.createDataFrame([(5, "walnut")], "query_id long, query string")
    assert "walnut" in engine.search_page_many(asked).first().page  # a batch brings the index up to date as well
    assert "walnut" in engine.search_page("walnut")
    folders = len(os.listdir(shared_folder(spark).removeprefix("file:")))
    assert "Fresh" in engine.search_page("*") and len(os.listdir(shared_folder(spark).removeprefix("file:"))) == folders
    changes = {r.uri: r.change for r in engine.changes.collect()}
    assert changes == {"doc://README": "removed", "doc://docs/new": "added", "doc://docs/bad": "added"}
    with pytest.raises(UnknownResource):
        engine.read("doc://README")
    assert held.catalog.read("doc://README").startswith("# Project")  # the older generation stays readable
    engine.close()
    engine.close()
    assert engine.search("walnut") is None and engine.search_page("walnut") == "No results found for 'walnut'"
    assert engine.document_count() == 0
    with pytest.raises(EngineClosed):
        engine.read("doc://docs/guide")


PROMPT = "---\nname: {name}\ndescription: d\narguments:\n  - name: topic\n    description: what\n  - name: tone\n    required: false\n  - description: nameless\n---\n{body}"


def test_prompts(spark, tree):
    root = tree(**{
        "a.md": PROMPT.format(name="one", body="About {{.topic}}{{if .tone}} ({{.tone}}){{end}}{{.unknown}}"), "sub/b.md": PROMPT.format(name="one", body="Last {{.topic}}"),
        "bad.md": PROMPT.format(name="bad", body="{{.x"), "meta.md": "---\nname: x\n---\n", "c.MD": PROMPT.format(name="upper", body="x"),
    })
    prompts = discover_prompts(spark, root)
    assert [r.name for r in list_prompts(prompts).collect()] == ["one", "one"]
    first = prompts.orderBy("file_path").first()
    assert [(a.name, a.required) for a in first.arguments] == [("topic", True), ("tone", False)]
    assert get_prompt(prompts, "one", {"topic": "x"})[0]["text"] == "Last x"
    rows = spark.createDataFrame([("spark", "dry"), ("", None)], "topic string, tone string")
    rendered = [(r.error, r.text) for r in render_prompts(first, rows).collect()]
    assert rendered == [(None, "About spark (dry)"), ("missing required argument: topic", None)]
    for name, arguments in (("gone", {}), ("one", {}), ("one", {"topic": ""})):
        with pytest.raises(PromptError):
            get_prompt(prompts, name, arguments)
    assert discover_prompts(spark, root + "/none").isEmpty()


GOOD = "server: {name: N, version: 1.10, instructions: I}\n"


def test_manifest(tree):
    assert man.load_manifest(tree.root, "").defaulted and man.load_manifest(tree.root, "").version == "0.0.0"
    tree.put(".docquarry/config.yaml", GOOD + "index: {include: ['docs/**']}\ntools: [{name: search, description: mine}]\n")
    manifest = man.load_manifest(tree.root)
    assert manifest.version == "1.10" and manifest.tool("search").description == "mine" and manifest.tool("read").name == "read"
    assert manifest.selection.include == ("docs/**",) and not manifest.selection.lenient
    assert man.parse_manifest(GOOD).effective_selection().legacy
    bad = ["server: {}", GOOD + "index: {include: []}", GOOD + "tools: [{name: a}]", GOOD + "tools: [{description: a}]", "a: [", "- x",
           GOOD + "tools: [{name: a, description: b}, {name: a, description: c}]"]
    for text in bad:
        with pytest.raises(man.ManifestError):
            man.parse_manifest(text)
    with pytest.raises(man.ManifestError):
        man.load_manifest(tree.root + "/gone")


def test_folder_without_manifest(tree):
    tree.put(".docquarry/resources/a.md", "x")
    assert man.resources_ignored(tree.root, man.default_manifest("r", ""), 0)
    assert not man.resources_ignored(tree.root, man.default_manifest("r", ""), 1)


def test_settings_precedence(tmp_path):
    dotenv = tmp_path / ".env"
    dotenv.write_text("DOCQUARRY_SEARCH_MAX_RESULTS=3\nDOCQUARRY_URI_SCHEME=file\nDOCQUARRY_CROSS_REF=true\n")
    env = {"DOCQUARRY_URI_SCHEME": "env", "DOCQUARRY_SEARCH_PATH_BOOST": "0"}
    loaded = st.load_settings({"uri_scheme": "flag"}, env, str(dotenv))
    assert (loaded.uri_scheme, loaded.search.max_results, loaded.cross_ref) == ("flag", 3, True)
    assert loaded.search.path_boost == 0.0 and st.load_settings(env={}, dotenv="").search == st.SearchSettings()
    with pytest.raises(st.SettingsError):
        st.load_settings(env={"DOCQUARRY_SEARCH_MAX_RESULTS": "x"}, dotenv="")


@pytest.mark.parametrize(
    "search",
    [{"result_mode": "x"}, {"title_boost": -1.0}, {"title_boost": float("nan")}, {"title_boost": 1e200}, dict.fromkeys(
        ("keywords_boost", "heading_boost", "title_boost", "path_boost", "content_boost"), 0.0)],
)
def test_bad_settings(search):
    with pytest.raises(st.SettingsError):
        st.SearchSettings(**search)
    with pytest.raises(st.SettingsError):
        st.Settings(uri_scheme="1a")
    assert st.summary(st.Settings())["search.max_results"] == 10

"""The optional manifest of a content root, its defaults, and layout checks."""

from __future__ import annotations

import logging
import os
from collections import Counter
from dataclasses import dataclass, field

from docquarry.sources.listing import Selection

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

log = logging.getLogger(__name__)


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    """Names inside a content root."""

    folder: str = ".docquarry"
    config: str = "config.yaml"
    prompts: str = "prompts"
    resources: str = "resources"

    def path(self, root: str, name: str) -> str:
        return os.path.join(root, self.folder, name)


@dataclass(frozen=True)
class Tool:
    name: str
    description: str


DEFAULT_TOOLS = {
    "search": Tool(
        "search",
        "Full-text search over titles, headings, path words, keywords and text of all indexed documents. "
        "Results cite chunks: title, address, heading trail, line range and an extract. Start here, then read what fits.",
    ),
    "read": Tool(
        "read",
        "Read a document by its address, or one chunk or section of it by adding '#' and a fragment, as given by search.",
    ),
}
DEFAULT_INCLUDE = ("README.md", "docs/**/*.md")


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    instructions: str
    tools: tuple[Tool, ...] = ()
    selection: Selection | None = None
    defaulted: bool = field(default=False, compare=False)

    def tool(self, name: str) -> Tool:
        return next((tool for tool in self.tools if tool.name == name), DEFAULT_TOOLS.get(name, Tool("", "")))

    def effective_selection(self) -> Selection:
        """Without an index section the older resources folder is scanned instead."""
        return self.selection or Selection(legacy=True)


def default_manifest(repository: str, version: str) -> Manifest:
    instructions = (
        f"Documentation of the {repository} repository: its README and everything below docs/.\n\n"
        "Search it before answering questions about conventions, architecture, decisions or plans."
    )
    selection = Selection(include=DEFAULT_INCLUDE, lenient=True)
    return Manifest(f"{repository} Documentation", version or "0.0.0", instructions, (), selection, defaulted=True)


def repository_name(root: str) -> str:
    name = os.path.basename(os.path.abspath(root))
    return name if name not in ("", ".", "..", os.sep) else "Repository"


def _section(value, what: str, kind: type):
    if value is None:
        return kind()
    if not isinstance(value, kind):
        raise ManifestError(f"manifest: {what} is no {kind.__name__}")
    return value


def _scalar(section: dict, key: str) -> str:
    value = section.get(key)
    if value is None:
        return ""
    if not isinstance(value, str):
        raise ManifestError(f"manifest: {key} is no plain text")
    return value


def parse_manifest(text: str) -> Manifest:
    if yaml is None:
        raise ManifestError("reading a manifest needs the PyYAML package")
    try:
        # Every scalar stays text, so that a version such as 1.10 keeps its digits.
        loaded = yaml.load(text, Loader=yaml.BaseLoader)
    except yaml.YAMLError as error:
        raise ManifestError(f"manifest is not YAML: {error}") from None
    root = _section(loaded or None, "manifest", dict)
    server = _section(root.get("server") or None, "server", dict)
    tools = [_section(item, "tool", dict) for item in _section(root.get("tools") or None, "tools", list)]
    selection = None
    if "index" in root and root["index"] not in (None, ""):
        index = _section(root["index"], "index", dict)
        include, exclude = (tuple(_section(index.get(key) or None, key, list)) for key in ("include", "exclude"))
        selection = Selection(include, exclude)
    manifest = Manifest(
        _scalar(server, "name"), _scalar(server, "version"), _scalar(server, "instructions"),
        tuple(Tool(_scalar(t, "name"), _scalar(t, "description")) for t in tools), selection,
    )
    if missing := gaps(manifest):
        raise ManifestError("manifest needs " + ", ".join(missing))
    return manifest


def gaps(manifest: Manifest) -> list[str]:
    """Every entry that must hold something and does not, and every tool name used again."""
    texts = {f"server.{key}": getattr(manifest, key) for key in ("name", "version", "instructions")}
    for place, tool in enumerate(manifest.tools):
        texts |= {f"tools[{place}].name": tool.name, f"tools[{place}].description": tool.description}
    if manifest.selection is not None:
        texts["index.include"] = manifest.selection.include
    names = Counter(tool.name for tool in manifest.tools)
    return [key for key, text in texts.items() if not text] + [f"tool {name} (repeated)" for name, n in names.items() if n > 1]


def load_manifest(root: str, version: str = "", layout: Layout = Layout()) -> Manifest:
    """A missing manifest means defaults and lenient loading; a bad one is an error."""
    if not os.path.isdir(root):
        raise ManifestError(f"no such content folder: {root}")
    try:
        with open(layout.path(root, layout.config), encoding="utf-8") as file:
            text = file.read()
    except FileNotFoundError:
        return default_manifest(repository_name(root), version)
    except (OSError, UnicodeDecodeError) as error:
        raise ManifestError(f"manifest is unreadable: {error}") from None
    return parse_manifest(text)


def resources_ignored(root: str, manifest: Manifest, source_count: int, layout: Layout = Layout()) -> bool:
    """Defaults found nothing while an unindexed resources folder exists: worth a warning."""
    return manifest.defaulted and source_count == 0 and os.path.isdir(layout.path(root, layout.resources))

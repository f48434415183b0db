"""Optional YAML header of a Markdown text."""

from __future__ import annotations

import re

try:
    import yaml
except ImportError:  # pragma: no cover - reported when a header is met
    yaml = None

#: A line of three dashes, lines of YAML of which only the first may begin with dashes, and a line of three dashes.
HEADER = re.compile(r"---\n(?P<yaml>(?:---[^\n]+\n)?(?:(?!---)[^\n]*\n)*)---(?:\n|\Z)")


class FrontmatterError(ValueError):
    pass


def _loader():
    class Loader(yaml.SafeLoader):
        """Only true/false are booleans, and a repeated key is an error."""

    Loader.yaml_implicit_resolvers = {
        first: [(tag, rx) for tag, rx in resolvers if tag != "tag:yaml.org,2002:bool" or first in "tTfF"]
        for first, resolvers in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(key, deep=True) for key, _ in node.value]
        if len(set(map(str, keys))) < len(keys):
            raise yaml.YAMLError("repeated mapping key")
        return yaml.SafeLoader.construct_mapping(loader, node, deep=deep)

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return Loader


def load_mapping(text: str) -> dict:
    if yaml is None:
        raise FrontmatterError("reading YAML needs the PyYAML package")
    try:
        value = yaml.load(text, Loader=_loader())
    except (yaml.YAMLError, ValueError, TypeError) as error:
        raise FrontmatterError(f"invalid YAML in frontmatter: {error}") from None
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise FrontmatterError("invalid YAML in frontmatter: not a mapping")
    return value


def split_header(text: str, required: bool) -> tuple[dict, int, int]:
    """Metadata, the character offset of the body and its 1-based line, for newline-normalised text."""
    header = HEADER.match(text)
    if header:
        return load_mapping(header["yaml"]), header.end(), text.count("\n", 0, header.end()) + (1 if header[0].endswith("\n") or header["yaml"] else 2)
    if text.startswith("---\n"):
        raise FrontmatterError("the YAML header has no closing line of three dashes alone")
    if required:
        raise FrontmatterError("a YAML header is required here")
    return {}, 0, 1


def text_value(metadata: dict, key: str) -> str:
    value = metadata.get(key)
    return value.strip() if isinstance(value, str) else ""


def text_list(metadata: dict, key: str) -> list[str]:
    value = metadata.get(key)
    return [item for item in value if isinstance(item, str)] if isinstance(value, list) else []

"""Prompt templates as column expressions: ``{{.name}}`` and ``{{if .name}}…{{else}}…{{end}}``.

A template becomes one string expression over argument columns, so rendering a table of
arguments is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"\{\{(?P<left>-\s)?\s*(?P<body>.*?)\s*(?P<right>(?<=\s)-)?\}\}", re.S)
FIELD = re.compile(r"\.(\w+)\Z")


class TemplateError(ValueError):
    pass


def _tokens(text: str):
    """Literal text and tags in order; a dash inside a tag trims the white space on its side."""
    at, trim = 0, False
    for match in TAG.finditer(text):
        literal = text[at : match.start()]
        literal = literal.lstrip() if trim else literal
        yield "text", literal.rstrip() if match["left"] else literal
        yield "tag", match["body"]
        at, trim = match.end(), bool(match["right"])
    rest = text[at:]
    if "{{" in rest:
        raise TemplateError("unclosed action")
    yield "text", rest.lstrip() if trim else rest


def parse(text: str) -> list:
    """Nested list of ("text", s), ("field", name) and ("if", name, then, otherwise)."""
    root: list = []
    open_blocks: list[tuple[list, list]] = []
    current = root
    for kind, body in _tokens(text):
        if kind == "text":
            if body:
                current.append(("text", body))
            continue
        if body.startswith("/*") and body.endswith("*/"):
            continue
        word, _, argument = body.partition(" ")
        if word == "if":
            name = FIELD.match(argument.strip())
            if not name:
                raise TemplateError(f"unsupported condition: {body}")
            node = ("if", name[1], [], [])
            current.append(node)
            open_blocks.append((current, node))
            current = node[2]
        elif body == "else" and open_blocks and current is open_blocks[-1][1][2]:
            current = open_blocks[-1][1][3]
        elif body == "end" and open_blocks:
            current, _ = open_blocks.pop()
        elif FIELD.match(body):
            current.append(("field", FIELD.match(body)[1]))
        else:
            raise TemplateError(f"unexpected action: {body}")
    if open_blocks:
        raise TemplateError("unexpected end of template: missing end")
    return root


def render(nodes: list, arguments: Mapping[str, Column]) -> Column:
    """Rendered text; an argument that is absent or null is empty."""

    def value(name: str) -> Column:
        return F.coalesce(arguments[name], F.lit("")) if name in arguments else F.lit("")

    pieces = [
        F.lit(node[1])
        if node[0] == "text"
        else value(node[1])
        if node[0] == "field"
        else F.when(value(node[1]) != "", render(node[2], arguments)).otherwise(render(node[3], arguments))
        for node in nodes
    ]
    return F.concat(*pieces) if pieces else F.lit("")

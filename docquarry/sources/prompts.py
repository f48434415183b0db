"""Prompt definitions from a folder, as a small table, and their rendering."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import frontmatter, templates

log = logging.getLogger(__name__)

PROMPTS = "name string, description string, arguments array<struct<name:string,description:string,required:boolean>>, file_path string, template string"


class PromptError(ValueError):
    pass


def _arguments(metadata: dict) -> list[tuple[str, str, bool]]:
    declared = metadata.get("arguments")
    found = []
    for item in declared if isinstance(declared, list) else []:
        if not isinstance(item, dict) or not isinstance(item.get("name"), str) or not item["name"]:
            continue
        description, required = item.get("description"), item.get("required")
        found.append((item["name"], description if isinstance(description, str) else "", required if isinstance(required, bool) else True))
    return found


def load_prompt(path: str) -> tuple:
    with open(path, encoding="utf-8", errors="replace") as file:
        text = file.read().replace("\r\n", "\n")
    metadata, start, _ = frontmatter.split_header(text, required=True)
    name, description = metadata.get("name"), metadata.get("description")
    if not (isinstance(name, str) and name and isinstance(description, str) and description):
        raise PromptError("missing metadata")
    templates.parse(text[start:])
    return name, description, _arguments(metadata), path, text[start:]


def discover_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Operator-written prompt files (``.md`` in that exact case) below a folder; bad files are skipped.

    A handful of files by nature, read on the driver once at start.
    """
    rows = []
    for base, dirs, names in os.walk(folder, onerror=lambda error: log.error("Prompt folder cannot be listed: %s", error)):
        dirs.sort()
        for path in (os.path.join(base, name) for name in names if name.endswith(".md")):
            try:
                rows.append(load_prompt(path))
            except (OSError, ValueError) as error:
                log.warning("Prompt file %s is left out: %s", os.path.basename(path), error)
    return spark.createDataFrame(sorted(rows, key=lambda row: os.fsencode(row[3])), PROMPTS)


def list_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.select("name", "description", "arguments").orderBy("file_path")


def render_prompts(prompt, arguments: DataFrame) -> DataFrame:
    """One prompt over a table of arguments: each row gains ``error`` and the rendered ``text``.

    A required argument must be there and not be empty.
    """
    columns = {name: F.col(name) for name in arguments.columns}
    problem = F.lit(None).cast("string")
    for argument in reversed(prompt.arguments):
        if argument.required:
            given = columns.get(argument.name, F.lit(None))
            missing = F.coalesce(given, F.lit("")) == ""
            problem = F.when(missing, F.lit(f"missing required argument: {argument.name}")).otherwise(problem)
    text = templates.render(templates.parse(prompt.template), columns)
    return arguments.withColumns({"error": problem, "text": text}).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


def get_prompt(prompts: DataFrame, name: str, arguments: dict[str, str]) -> list[dict]:
    """The rendered messages of one call; among prompts of the same name the last one counts."""
    prompt = prompts.filter(F.col("name") == name).orderBy(F.col("file_path").desc()).head()
    if prompt is None:
        raise PromptError(f"unknown prompt: {name}")
    given = {key: value for key, value in arguments.items() if key}
    spark = prompts.sparkSession
    row = spark.range(1).select(*(F.lit(value).alias(key) for key, value in given.items()), F.lit(0).alias("\u0000"))
    rendered = render_prompts(prompt, row).select("error", "text").first()
    if rendered.error:
        raise PromptError(rendered.error)
    return [{"role": "user", "text": rendered.text}]

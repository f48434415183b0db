"""Column expressions over paths and addresses. Everything here runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown)$")


def source_uri(relative_path: Column, scheme: str) -> Column:
    """``scheme://`` plus the relative path without its last extension; nothing is percent-encoded."""
    return F.concat(F.lit(f"{scheme}://"), F.regexp_replace(relative_path, r"\.[^./]*$", ""))


def addressable(uri: Column) -> Column:
    """False for text that is no valid URL: control characters, broken escapes, a malformed host."""
    host = F.regexp_extract(uri, r"^[^:]+://([^/?#]*)", 1)
    return ~(
        uri.rlike(r"[\x00-\x1f\x7f]")
        | uri.rlike(r"%(?![0-9A-Fa-f]{2})")
        | host.rlike(r"[ \\^`{|}%]")
        | host.rlike(r":(?![0-9]*$)")
    )


def path_labels(relative_path: Column) -> Column:
    """Lower-cased words of a path, split at separators and camel case, first occurrence kept."""
    stem = F.regexp_replace(relative_path, r"\.[^./]*$", "")
    parts = F.split(stem, r"[/\-_\s\x{85}\p{Z}]+")
    words = F.flatten(F.transform(parts, lambda p: F.split(p, r"(?<=\p{Ll})(?=\p{Lu})")))
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: w != ""))


def truncate(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def breadcrumb(source_path: Column, heading_path: Column) -> Column:
    lead = F.when(source_path != "", F.array(source_path)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lead, heading_path), " > ")


def base_uri(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def has_fragment(uri: Column) -> Column:
    return F.contains(uri, F.lit("#"))


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def resolve_path(directory: Column, target: Column) -> Column:
    """Join and clean a path the way a file system would: drop ``.`` and empty steps, apply ``..``."""
    absolute = F.startswith(directory, F.lit("/"))
    steps = F.split(F.concat_ws("/", directory, target), "/")

    def walk(done: Column, step: Column) -> Column:
        depth = F.size(done)
        can_pop = (depth > 0) & (F.coalesce(F.get(done, depth - 1), F.lit("")) != "..")
        up = F.when(can_pop, F.slice(done, F.lit(1), depth - 1)).when(absolute, done)
        return (
            F.when(step.isin("", "."), done)
            .when(step == "..", up.otherwise(F.concat(done, F.array(step))))
            .otherwise(F.concat(done, F.array(step)))
        )

    cleaned = F.aggregate(steps, F.array().cast("array<string>"), walk)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(cleaned, "/"))

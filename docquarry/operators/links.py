"""Rewriting relative Markdown links to source addresses, as a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.paths import parent_dir, resolve_path
from docquarry.operators.sizing import settled

# Fixed value: inline links and images with an optional quoted title.
LINK = r"""!?\[([^\]]*)\]\(([^)\s]+)(\s+"[^"]*")?\)"""
HOT_SHARE = 1000


def _links_in(text: Column) -> Column:
    def parts(link: Column) -> Column:
        target = F.regexp_extract(link, LINK, 2)
        path = F.substring_index(target, "#", 1)
        return F.struct(
            link.alias("link"),
            F.regexp_extract(link, LINK, 1).alias("label"),
            target.alias("target"),
            path.alias("path"),
            F.substr(target, F.length(path) + 1).alias("fragment"),
            F.regexp_extract(link, LINK, 3).alias("title"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), parts)


def rewritable(link: Column, target: Column) -> Column:
    """Relative links only: no image, no bare fragment, nothing with a scheme or any other colon."""
    return ~(F.startswith(link, F.lit("!")) | F.startswith(target, F.lit("#")) | F.contains(target, F.lit(":")))


def extract_links(df: DataFrame, key: str, text: str = "content", file_path: str = "file_path") -> DataFrame:
    """Every link with its position and, for relative ones, the path it resolves to."""
    found = df.select(key, file_path, F.posexplode(_links_in(F.col(text))).alias("position", "l")).select(key, file_path, "position", "l.*")
    resolved = resolve_path(parent_dir(F.col(file_path)), F.col("path"))
    return found.withColumn("resolved", F.when(rewritable(F.col("link"), F.col("target")), resolved)).drop(file_path)


def resolve_links(links: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Left join of links to (file_path, uri), as ``target_uri``. Popular targets are joined by broadcast, the others by shuffle.

    A path that holds more than one in ``HOT_SHARE`` of all links is popular, so there are fewer
    than ``HOT_SHARE`` of them whatever the size of the data. Their rows, and rows that resolve
    to nothing, go through the shuffle under keys of their own, so no task collects them.
    """
    links = settled(links, "links")  # read three times below; the texts are searched once
    counted = links.filter(F.col("resolved").isNotNull()).groupBy("resolved").count()
    total = links.filter(F.col("resolved").isNotNull()).count()
    popular = (
        counted.filter(F.col("count") * HOT_SHARE > total)
        .join(targets.select(F.col("file_path").alias("resolved"), F.col("uri").alias("popular_uri")), "resolved")
        .select("resolved", "popular_uri")
    )
    spread = F.concat(F.lit("\u0000"), F.col(key), F.lit("\u0000"), F.col("position").cast("string"))
    marked = links.join(F.broadcast(popular), "resolved", "left").withColumn(
        "join_path", F.when(F.col("resolved").isNull() | F.col("popular_uri").isNotNull(), spread).otherwise(F.col("resolved"))
    )
    others = targets.select(F.col("file_path").alias("join_path"), F.col("uri").alias("other_uri"))
    joined = marked.join(others, "join_path", "left")
    return joined.withColumn("target_uri", F.coalesce("popular_uri", "other_uri")).drop("join_path", "popular_uri", "other_uri")


def rewritten_link() -> Column:
    linked = F.concat(F.lit("["), "label", F.lit("]("), "target_uri", "fragment", "title", F.lit(")"))
    return F.when(F.col("target_uri").isNotNull(), linked).otherwise(F.col("link"))


def rewrite_links(df: DataFrame, targets: DataFrame, key: str, text: str = "content", file_path: str = "file_path") -> DataFrame:
    """The frame with links of ``text`` rewritten; rows without a resolvable link pass unchanged."""
    resolved = resolve_links(extract_links(df, key, text, file_path), targets, key)
    replaced = (
        resolved.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("position", rewritten_link().alias("r")))).alias("links"), F.count("target_uri").alias("hits"))
        .filter("hits > 0")
        .select(key, F.transform("links", lambda p: p["r"]).alias("replacements"))
    )
    between = F.split(F.col(text), LINK, -1)
    woven = F.zip_with(between, F.col("replacements"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    rewritten = F.when(F.col("replacements").isNotNull(), F.array_join(woven, "")).otherwise(F.col(text))
    return df.join(replaced, key, "left").withColumn(text, rewritten).select(*df.columns)


def link_transformer(sources: DataFrame):
    """Catalog transformer for frames with ``content``, ``file_path`` and one of the address columns."""
    targets = sources.select("file_path", "uri")

    def transform(df: DataFrame) -> DataFrame:
        key = next(name for name in ("chunk_id", "section_uri", "uri") if name in df.columns)
        return rewrite_links(df, targets, key)

    return transform

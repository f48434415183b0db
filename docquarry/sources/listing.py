"""Directory listing as Spark jobs: tasks walk subtrees, the driver only sees whether work is left."""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.globs import Reach, union_regex, validate
from docquarry.session import new_location

LISTING = "path string, relative_path string, size long, mtime_ns long"
_ROUND = "kind string, " + LISTING + ", error string"
_ROUND_ARROW = pa.schema(
    [
        ("kind", pa.string()),
        ("path", pa.string()),
        ("relative_path", pa.string()),
        ("size", pa.int64()),
        ("mtime_ns", pa.int64()),
        ("error", pa.string()),
    ]
)

# Directories never descended into, and those skipped only under the lenient policy.
ALWAYS_PRUNED = frozenset({".git"})
LENIENT_PRUNED = frozenset({"node_modules", "vendor", "dist", "build", "target", ".venv"})

ENTRIES_PER_TASK = 50_000
BATCH_ROWS = 4_096


class ListingError(OSError):
    pass


@dataclass(frozen=True)
class Selection:
    """What a walk keeps. ``legacy`` takes every Markdown file and prunes nothing."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    lenient: bool = False
    legacy: bool = False

    def checked(self) -> Selection:
        return Selection(tuple(validate(list(self.include))), tuple(validate(list(self.exclude))), self.lenient, self.legacy)


def canonical(path: str) -> str:
    return os.path.realpath(os.path.abspath(path), strict=True)


# A name may hold bytes that are no text. Each of them stands as one character of this (private) range, and so do the bytes of
# characters that are of the range themselves, so every name has one text and every text one name.
_BYTE = 0x10FF00
_NO_TEXT, _STAND_INS = re.compile("[\udc80-\udcff\U0010ff80-\U0010ffff]"), re.compile("[\U0010ff80-\U0010ffff]+")


def as_text(path: str) -> str:
    """A path of the file system as valid text."""
    return _NO_TEXT.sub(lambda m: "".join(chr(_BYTE + b) for b in os.fsencode(m[0])), path)


def as_path(text: str) -> str:
    """The path that ``as_text`` made into text."""
    return _STAND_INS.sub(lambda m: os.fsdecode(bytes(ord(c) - _BYTE for c in m[0])), text)


def list_directory(path: str, relative: str, selection: Selection, keep, drop, reach: Reach):
    """Rows for one directory: files that are selected and subdirectories still to walk."""
    with os.scandir(as_path(path)) as entries:
        for entry in entries:
            own = as_text(entry.name)
            name, place = f"{relative}/{own}" if relative else own, f"{path.rstrip('/')}/{own}"
            if entry.is_dir(follow_symlinks=False):
                pruned = entry.name in ALWAYS_PRUNED or (selection.lenient and entry.name in LENIENT_PRUNED)
                if selection.legacy or (not pruned and reach.allows(name)):
                    yield ("dir", place, name, 0, 0, None)
                continue
            wanted = name.lower().endswith((".md", ".markdown")) if selection.legacy else keep(name) and not drop(name)
            if wanted and not entry.is_symlink():
                info = entry.stat(follow_symlinks=False)
                if stat.S_ISREG(info.st_mode):
                    yield ("file", place, name, info.st_size, info.st_mtime_ns, None)


def _walker(selection: Selection, budget: int):
    def matcher(patterns):
        return re.compile(union_regex(list(patterns)), re.S).fullmatch

    def walk(batches):
        keep, drop = matcher(selection.include), matcher(selection.exclude)
        reach = Reach(list(selection.include))

        def rows():
            seen = 0
            for batch in batches:
                queue = deque(zip(*(batch.column(name).to_pylist() for name in ("path", "relative_path"))))
                while queue:
                    path, relative = queue.popleft()
                    if seen > budget:
                        yield ("dir", path, relative, 0, 0, None)  # left for the next round
                        continue
                    try:
                        for row in list_directory(path, relative, selection, keep, drop, reach):
                            seen += 1
                            if row[0] == "dir":
                                queue.append(row[1:3])
                            else:
                                yield row
                    except OSError as error:
                        yield ("error", path, relative, 0, 0, str(error))

        pending = []
        for row in rows():
            pending.append(row)
            if len(pending) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*pending), _ROUND_ARROW)], schema=_ROUND_ARROW)
                pending = []
        if pending:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*pending), _ROUND_ARROW)], schema=_ROUND_ARROW)

    return walk


def list_files(spark: SparkSession, root: str, selection: Selection, budget: int = ENTRIES_PER_TASK) -> DataFrame:
    """Selected regular files below a root that every executor can read.

    Each task walks breadth-first until its budget is spent and hands unvisited directories
    back; they are spread over all tasks in the next round, so no task holds a whole large tree.
    Symbolic links are not followed. Any directory that cannot be read fails the listing.
    """
    selection = selection if selection.legacy else selection.checked()
    try:
        root = canonical(root)
    except FileNotFoundError:
        if selection.legacy:
            return spark.createDataFrame([], LISTING)
        raise ListingError(f"resolve content root: {root} does not exist") from None
    location = new_location(spark, "listing")
    frontier = spark.createDataFrame([(as_text(root), "")], "path string, relative_path string").coalesce(1)
    number = 0
    while True:
        folder = f"{location}/round={number}"
        frontier.mapInArrow(_walker(selection, budget), _ROUND).write.parquet(folder)
        entries = spark.read.schema(_ROUND).parquet(folder)
        left, failed = entries.agg(
            F.count_if(F.col("kind") == "dir"), F.min(F.when(F.col("kind") == "error", F.struct("path", "error")))
        ).first()
        if failed:
            raise ListingError(f"{failed['path']}: {failed['error']}")
        if not left:
            break
        spread = max(1, min(left, 4 * spark.sparkContext.defaultParallelism))
        frontier = entries.filter("kind = 'dir'").select("path", "relative_path").repartition(spread)
        number += 1
    files = spark.read.schema(_ROUND + ", round int").parquet(location)
    return files.filter("kind = 'file'").select("path", "relative_path", "size", "mtime_ns")

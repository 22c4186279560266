"""A directory tree as tables: listing, ignore files, exclusions, hidden paths, contents.

Listing goes level by level: one Spark job lists all directories of a level, so a wide tree is
listed by as many tasks as its directories need and nothing but the root passes the driver.
Which paths survive is decided relationally on the listed names, before any content is read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions.paths import (
    ALWAYS_SKIPPED_DIRECTORIES,
    MCP_NAMES,
    analysers,
    file_name,
    skipped_directory,
)
from treesift.functions.text import utf8
from treesift.session import written

IGNORE_NAMES = (".gitignore", ".ignore")
# Ranks below this step order the lines of one ignore file; the steps order the files of a directory.
MOST_LINES = 1 << 32
DIRECTORIES_PER_TASK = 200
FILES_PER_TASK = 20_000
BYTES_PER_TASK = 64 << 20
ENTRY = "path string, is_dir boolean, length bigint"
PATTERN = "dir string, rank bigint, pattern string, regex string, negated boolean, dir_only boolean"


@dataclass(frozen=True)
class WalkOptions:
    """What a scan leaves out. ``custom_ignore`` names a project-specific ignore file."""

    excludes: tuple[str, ...] = ()
    include_hidden: bool = False
    respect_ignore_files: bool = True
    follow_symlinks: bool = False
    max_depth: int | None = None
    custom_ignore: str | None = None
    ignore_names: tuple[str, ...] = field(default=IGNORE_NAMES)

    def ignore_files(self) -> tuple[str, ...]:
        return (*self.ignore_names, *([self.custom_ignore] if self.custom_ignore else []))


class PathNotFoundError(FileNotFoundError):
    """The scan root does not exist."""


class InvalidPatternError(ValueError):
    """An exclusion pattern that is not a valid glob."""


def glob_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """``(regex, negated, dir_only)`` of one ignore-file line, or None for blank and comment.

    The regex applies to the path relative to the file's directory. A pattern with a slash before
    its end is anchored there; any other matches the last component at every depth.
    """
    text = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    dir_only = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.lstrip("/")
    out, at = ["" if anchored else "(?:.*/)?"], 0
    while at < len(text):
        if text.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif text.startswith("**", at):
            out.append(".*")
            at += 2
        elif text[at] == "*":
            out.append("[^/]*")
            at += 1
        elif text[at] == "?":
            out.append("[^/]")
            at += 1
        elif text[at] == "[":
            end = text.find("]", at + 2)
            if end < 0:
                raise InvalidPatternError(pattern)
            body = text[at + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append("[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            at = end + 1
        elif text[at] == "{":
            end = text.find("}", at)
            if end < 0:
                raise InvalidPatternError(pattern)
            out.append("(?:" + "|".join(map(re.escape, text[at + 1 : end].split(","))) + ")")
            at = end + 1
        else:
            at += text[at] == "\\" and at + 1 < len(text)
            out.append(re.escape(text[at]))
            at += 1
    return "^" + "".join(out) + "$", negated, dir_only


def exclude_patterns(spark: SparkSession, options: WalkOptions) -> DataFrame:
    """Command-line exclusions as patterns of the root. A bad pattern is an error."""
    rows = []
    for rank, pattern in enumerate(options.excludes):
        compiled = glob_regex(pattern)
        if compiled is not None:
            rows.append(("", rank, pattern, *compiled))
    return spark.createDataFrame(rows, PATTERN)


def ignore_patterns(ignore_files: DataFrame) -> DataFrame:
    """Patterns of ignore files (columns ``path`` and ``text``), later lines ranked higher.

    In one directory ``.gitignore`` gives way to ``.ignore``, and both to a custom ignore file.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                directory, _, name = path.rpartition("/")
                first = {".gitignore": 0, ".ignore": 1}.get(name, 2) * MOST_LINES
                for rank, line in enumerate((text or "").splitlines(), first):
                    try:
                        compiled = glob_regex(line)
                    except InvalidPatternError:
                        continue
                    if compiled is not None:
                        rows.append((directory, rank, line, *compiled))
            yield pd.DataFrame(
                rows, columns=["dir", "rank", "pattern", "regex", "negated", "dir_only"]
            )

    return ignore_files.select("path", "text").mapInPandas(read, PATTERN)


def is_hidden(path: Column) -> Column:
    """Hidden by a dot component, unless one of the places that are always looked at."""
    dotted = path.rlike(r"(^|/)\.")
    root_names = [name for name in MCP_NAMES if name.startswith(".")]
    kept = path.rlike(r"^\.env(\..*)?$") & ~path.contains("/")
    kept = kept | path.isin(*root_names)
    kept = kept | path.startswith(".claude/") | path.startswith(".github/workflows/")
    return dotted & ~kept


def prefixes(path: Column) -> Column:
    """The path and every directory above it, shortest first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def _last_match(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """The deciding pattern of each name: the last one of the deepest directory that matches.

    Names are distinct, so a directory shared by a million files is judged once. The pattern side
    is grouped per directory; whether it is broadcast is left to its measured size.
    """
    by_dir = patterns.groupBy("dir").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pattern", "regex", "negated", "dir_only"))).alias(
            "lines"
        )
    )
    above = F.concat(F.array(F.lit("")), prefixes(F.col("path")))
    located = names.select(
        "path", "is_dir", F.explode(F.slice(above, F.lit(1), F.size(above) - 1)).alias("dir")
    )
    joined = located.join(by_dir, "dir")
    relative = F.when(F.col("dir") == "", F.col("path")).otherwise(
        F.expr("substring(path, length(dir) + 2)")
    )
    hits = joined.withColumn("relative", relative).select(
        "path",
        "is_dir",
        F.length("dir").alias("depth"),
        F.try_element_at(
            F.filter(
                "lines",
                lambda p: F.regexp_like(F.col("relative"), p["regex"])
                & (~p["dir_only"] | F.col("is_dir")),
            ),
            F.lit(-1),
        ).alias("line"),
    )
    return (
        hits.where("line IS NOT NULL")
        .groupBy("path", "is_dir")
        .agg(F.max_by("line", "depth").alias("line"))
        .select("path", "is_dir", "line.pattern", "line.negated")
    )


def matched(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Names (files and directories) the patterns take out.

    A file below a directory that is taken out cannot be brought back by a negation.
    """
    exploded = files.select(
        F.posexplode(prefixes(F.col("path"))).alias("n", "name"), F.size(F.split("path", "/")).alias("of")
    )
    names = exploded.select(
        F.col("name").alias("path"), (F.col("n") < F.col("of") - 1).alias("is_dir")
    ).distinct()
    return _last_match(names, patterns).where("NOT negated")


def topmost(names: DataFrame) -> DataFrame:
    """Drop every name that lies below another name of the table: an equi-join on prefixes."""
    below = (
        names.select("path", F.explode(prefixes(F.col("path"))).alias("above"))
        .where("above <> path")
        .join(names.select(F.col("path").alias("above")), "above", "left_semi")
        .select("path")
        .distinct()
    )
    return names.join(below, "path", "left_anti")


def without(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files that are not, and do not lie below, any of the names."""
    gone = (
        files.select("path", F.explode(prefixes(F.col("path"))).alias("name"))
        .join(names.select(F.col("path").alias("name")), "name", "left_semi")
        .select("path")
        .distinct()
    )
    return files.join(gone, "path", "left_anti")


def select_files(
    files: DataFrame, ignores: DataFrame | None, options: WalkOptions
) -> tuple[DataFrame, DataFrame]:
    """``(kept files, skips)`` of a listing with a ``path`` column."""
    spark = files.sparkSession
    path = F.col("path")
    kept = files.where(~skipped_directory(path))
    if options.max_depth is not None:
        kept = kept.where(F.size(F.split(path, "/")) <= options.max_depth)
    custom = options.custom_ignore
    notes = spark.createDataFrame([], "reason string, path string, detail string, line string")
    if custom and options.respect_ignore_files:
        honoured = kept.where(file_name(path) == custom)
        notes = notes.unionByName(
            honoured.select(
                F.lit("ignore_file").alias("reason"),
                "path",
                F.lit("").alias("detail"),
                F.concat(
                    path, F.lit(" — honoured: paths matching its patterns were not scanned")
                ).alias("line"),
            )
        )
    if not options.include_hidden:
        kept = kept.where(~is_hidden(path))
    if ignores is not None and options.respect_ignore_files:
        # Three branches read what is left; without a table each would walk the joins again.
        kept = written(without(kept, matched(kept, ignores)), "kept")
    if options.excludes:
        hits = written(matched(kept, exclude_patterns(spark, options)), "excluded")
        excluded = topmost(hits)
        shown = F.when(F.col("is_dir"), F.concat(path, F.lit("/"))).otherwise(path)
        notes = notes.unionByName(
            excluded.select(
                F.lit("excluded").alias("reason"),
                shown.alias("path"),
                F.col("pattern").alias("detail"),
                F.format_string('%s — excluded by pattern "%s"', shown, "pattern").alias("line"),
            )
        )
        kept = without(kept, hits)
    return kept, notes


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))


def _list_level(root: str, follow_symlinks: bool):
    """A function for ``mapInPandas``: the entries of each directory of a batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = _filesystem(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            rows = []
            for directory in batch["path"]:
                where = f"{base}/{directory}" if directory else base
                for info in system.get_file_info(fs.FileSelector(where)):
                    if local and not follow_symlinks and os.path.islink(info.path):
                        continue
                    relative = info.path[len(base) :].lstrip("/")
                    is_dir = info.type == fs.FileType.Directory
                    if is_dir and info.base_name in ALWAYS_SKIPPED_DIRECTORIES:
                        continue
                    rows.append((relative, is_dir, None if is_dir else info.size))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "length"])

    return read


def list_tree(spark: SparkSession, root: str, options: WalkOptions) -> DataFrame:
    """All files below ``root`` with their sizes; one job per level of the tree."""
    from pyarrow import fs

    system, base = _filesystem(root)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise PathNotFoundError(root)
    if info.type != fs.FileType.Directory:
        raise NotADirectoryError(root)
    level = spark.createDataFrame([("",)], "path string")
    found = None
    depth = 0
    while options.max_depth is None or depth < options.max_depth:
        listed = written(
            level.mapInPandas(_list_level(root, options.follow_symlinks), ENTRY), "level"
        )
        files = listed.where("NOT is_dir").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = listed.where("is_dir").select("path")
        depth += 1
        directories = level.count()
        if not directories:
            break
        # The number is given: adaptive execution would merge by the bytes of the path strings.
        level = level.repartition(max(1, -(-directories // DIRECTORIES_PER_TASK)), "path")
    return found if found is not None else spark.createDataFrame([], "path string, length bigint")


def load(files: DataFrame, root: str) -> DataFrame:
    """Contents of the listed files. Files that cannot be read have a NULL content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _filesystem(root)

        def content(path: str) -> bytes | None:
            try:
                with system.open_input_stream(f"{base}/{path}") as stream:
                    return stream.read()
            except OSError:
                return None

        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame({"path": [path], "content": [content(path)]})

    return files.select("path").mapInPandas(read, "path string, content binary")


def read_tasks(claimed: DataFrame) -> int:
    """Tasks for reading listed files: by their bytes, and by their number."""
    size = claimed.agg(F.count("path").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return max(1, -(-size["bytes"] // BYTES_PER_TASK), -(-size["n"] // FILES_PER_TASK))


def read_tree(
    spark: SparkSession, root: str, options: WalkOptions | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(files with content, skips)`` of a directory; only claimed files are opened.

    Reading is spread by a hash of the path, so that neighbouring huge files part ways, over as many
    tasks as the listed bytes and the number of files need.
    """
    options = options or WalkOptions()
    listed = written(list_tree(spark, root, options), "listing")
    ignores = None
    unreadable = spark.createDataFrame([], "reason string, path string, detail string, line string")
    if options.respect_ignore_files:
        names = listed.where(file_name(F.col("path")).isin(*options.ignore_files()))
        texts = written(load(names, root).select("path", utf8(F.col("content")).alias("text")), "ignores")
        ignores = written(ignore_patterns(texts.where("text IS NOT NULL")), "patterns")
        unreadable = texts.where("text IS NULL").select(
            F.lit("unreadable").alias("reason"), "path", F.lit("").alias("detail"), F.col("path").alias("line")
        )
    kept, skips = select_files(listed, ignores, options)
    claimed = kept.where(F.size(analysers(F.col("path"))) > 0)
    return load(claimed.repartition(read_tasks(claimed), "path"), root), skips.unionByName(unreadable)

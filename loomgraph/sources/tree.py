"""Working trees: scan, filters, ignore rules."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.scratch import written

# Fixed values.
PRUNED = (".git", "node_modules", ".loomgraph", "dist", "build", "out", "vendor", "coverage")
MAX_BYTES = 1_572_864
BINARY = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "avif", "pdf", "zip", "tar", "gz", "bz2", "7z", "rar", "mp3", "mp4", "mov", "avi", "webm", "wav",
    "flac", "ogg", "woff", "woff2", "ttf", "otf", "eot", "exe", "dll", "so", "dylib", "bin", "wasm", "class", "jar", "o", "a", "node", "sqlite", "db", "lock",
)


#: Directories that a task of a listing goes down through before it hands the rest on.
DESCENT = 500
#: Rows and bytes that a task gives back at a time, and files that a task reads.
ROWS, BYTES, FILES_A_TASK = 10_000, 8_000_000, 200


def _class(part: str) -> str:
    """A character class of a glob as one of a regular expression."""
    inner = part[1:-1]
    no = inner[:1] in ("!", "^")
    body = re.sub(r"([\[&^~|])", r"\\\1", inner[1:] if no else inner)
    return "(?!/)[" + ("^" if no else "") + body + "]"


def ignore_rules(lines: str) -> list[tuple[str, bool]]:
    """(regex, ignored) of gitignore lines over relative paths, those of directories with a slash at their end; the last that matches counts."""
    out = []
    for line in lines.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line.removeprefix("!").removeprefix("\\")
        only_dir = line.endswith("/")
        line = line.rstrip("/")
        rooted = "/" in line
        body = ""
        for part in re.split(r"(/\*\*/|\*\*/|/\*\*|\*|\?|\[[!^]?\]?[^\]]*\])", line.removeprefix("/")):
            body += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.+", "*": "[^/]*", "?": "[^/]"}.get(part) or (_class(part) if part.startswith("[") and part.endswith("]") else re.escape(part))
        out.append((("^" if rooted else "^(?:.*/)?") + body + ("/$" if only_dir else "/?$"), not keep))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the rules ignore a file, or a directory that it is in: what is in an ignored directory stays ignored."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))

    def matched(p: Column) -> Column:
        out = F.lit(False)
        for pattern, yes in rules:
            out = F.when(p.rlike(pattern), yes).otherwise(out)
        return out

    return F.exists(F.concat(above, F.array(path)), matched)


def kept(files: DataFrame, rules: list[tuple[str, bool]] = ()) -> DataFrame:
    """files (path, size, ...) with role code, doc or module: no pruned folders, ignored, binary, minified or large files."""
    pruned = F.col("path").rlike("(^|/)(" + "|".join(re.escape(p) for p in PRUNED) + ")/")
    ext = text.extension("path")
    small = (F.col("size") <= MAX_BYTES) & ~ext.isin(*BINARY) & ~F.col("path").rlike(r"\.min\.(js|css)$")
    role = F.when(ext.isin("md", "mdx"), "doc").when(text.language("path").isNotNull(), "code").when(F.col("path") == "go.mod", "module")
    return files.where(small & ~pruned & ~ignored(F.col("path"), list(rules))).withColumn("role", role).where("role is not null")


def _base(root: str) -> str:
    """root as a path with its scheme, or without one if it is local."""
    local = root.removeprefix("file://").removeprefix("file:")
    return root.rstrip("/") if "://" in local else os.path.abspath(local)


def _opened(base: str):
    """The file system of a root and the root's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base.rstrip("/"))


def _descended(base: str, rules: list[tuple[str, bool]], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Directories (path) to the files below them, and to directories not listed yet (no size)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSelector, FileType

        system, top = _opened(base)
        compiled = [(re.compile(pattern), yes) for pattern, yes in rules]
        shaped = lambda rows: pd.DataFrame(rows, columns=["path", "size", "mtime"]).astype({"size": "Int64", "mtime": "Int64"})
        for frame in frames:
            todo, rows, listed = list(frame["path"]), [], 0
            while todo and listed < most:
                folder = todo.pop()
                listed += 1
                try:
                    found = system.get_file_info(FileSelector(f"{top}/{folder}" if folder else top or "/"))
                except FileNotFoundError:
                    if not folder:
                        raise
                    continue  # gone meanwhile
                for info in found:
                    path = f"{folder}/{info.base_name}" if folder else info.base_name
                    if system.type_name == "local" and os.path.islink(info.path):
                        continue  # links are not followed, so no circle is walked
                    if info.type == FileType.File:
                        rows.append((path, info.size, info.mtime_ns // 1_000_000))
                    elif info.type == FileType.Directory and info.base_name not in PRUNED:
                        verdicts = [yes for pattern, yes in compiled if pattern.search(path + "/")]
                        if not verdicts or not verdicts[-1]:
                            todo.append(path)
                if len(rows) >= ROWS:
                    yield shaped(rows)
                    rows = []
            yield shaped(rows + [(path, None, None) for path in todo])

    return run


def listing(spark: SparkSession, root: str, rules: list[tuple[str, bool]] = ()) -> DataFrame:
    """(path, at, size, mtime, role, language) of the files under root that count. No file is read: at is where it lies.

    Directories are listed by tasks, which go down on their own for a while and hand on what is left to the next
    round. Pruned and ignored directories are never entered, and links aren't followed. A root that isn't there is an error.
    """
    base, shape = _base(root), "path string, size long, mtime long"
    folders, files, width = spark.createDataFrame([("",)], "path string"), None, 1
    while width:
        found = written(folders.repartition(width).mapInPandas(_descended(base, list(rules), DESCENT), shape), "listed")
        files = found if files is None else files.unionByName(found)
        folders = found.where("size is null").select("path")
        left = folders.count()
        width = min(left, 4 * spark.sparkContext.defaultParallelism)
    rows = files.where("size is not null").withColumn("at", F.concat(F.lit(base.rstrip("/") + "/"), "path"))
    return kept(rows, rules).withColumn("language", text.language("path")).select("path", "at", "size", "mtime", "role", "language")


FILES = "path string, size long, mtime long, hash string, role string, language string, content string"


def _read(base: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Files (path) to (path, hash, content), some megabytes at a time; files gone meanwhile are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _opened(base)
        rows, held = [], 0
        for frame in frames:
            for path in frame["path"]:
                try:
                    with system.open_input_stream(f"{top}/{path}") as f:
                        raw = f.read()
                except FileNotFoundError:
                    continue
                rows.append((path, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace")))
                held += len(raw)
                if held >= BYTES:
                    yield pd.DataFrame(rows, columns=["path", "hash", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "hash", "content"])

    return run


def contents(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """listed files with hash and content. Only these are read, by tasks of some hundred files; no path passes the driver."""
    listed = written(listed, "asked")
    tasks = max(1, -(-listed.count() // FILES_A_TASK))
    read = listed.select("path").repartition(tasks).mapInPandas(_read(_base(root)), "path string, hash string, content string")
    return listed.drop("at").join(written(read, "read"), "path").select("path", "size", "mtime", "hash", "role", "language", "content")


def scan(spark: SparkSession, root: str, rules: list[tuple[str, bool]] = ()) -> DataFrame:
    """(path, size, mtime, hash, role, language, content) of the files under root; what doesn't count isn't read."""
    return contents(spark, root, listing(spark, root, rules))


def ignore_file(root: str) -> list[tuple[str, bool]]:
    """The rules of the tree's own ignore file; none without one."""
    try:
        with open(f"{root}/.gitignore", encoding="utf-8") as f:
            return ignore_rules(f.read())
    except OSError:
        return []

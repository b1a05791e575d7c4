"""Directory trees and single files as sources.

A tree is walked level by level, all folders of a level at once, each folder with the ignore rules that hold in it.
Names that start with a dot are left out unless a rule keeps them, `.git` always; a name that starts with `_` is like
any other. Rules come from `.ignore`, then `.gitignore`, then `.git/info/exclude`, of the tree's folders and of the
folders above it; a deeper file's rules go before those above it, and in one file the last that fits decides. A
folder that is left out is not entered. Links are refused. The rules of one user's own git settings don't apply.

Files are read by the tasks themselves: Spark's own listing drops names that start with `_`."""

from __future__ import annotations

import functools
import json
import os
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.errors import EngineError
from quarrylight.schemas import MAX_SOURCE_BYTES

LISTED = "path string, modified timestamp, length long"
_WALKED = "path string, is_dir boolean, modified timestamp, length long, rules string"
#: Bytes of files that a task reads before it hands them on.
READ_BYTES = 16 << 20
_RULE_FILES = (("ignore", ".ignore"), ("gitignore", ".gitignore"), ("exclude", ".git/info/exclude"))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _plain(path: str) -> str:
    """Local paths go without a scheme."""
    return re.sub(r"^file:/*/", "/", path).rstrip("/") or "/"


def _fact(path: str) -> pafs.FileInfo:
    if "://" not in path and os.path.islink(path):
        raise EngineError("INDEX_LINK_REFUSED", path)
    fs, inner = _opened(path)
    return fs.get_file_info(inner)


# ignore rules


def rule(line: str) -> tuple[bool, bool, str] | None:
    """One line of an ignore file: does it keep, is it for folders only, and a pattern of paths below its folder."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[keeps:]
    only_dir = line.endswith("/")
    line = line[: len(line) - only_dir]
    anchored, line = "/" in line, line.removeprefix("/")
    if not line:
        return None
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        c, first = line[i], i == 0 or line[i - 1] == "/"
        if first and line.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif first and line[i:] == "**":
            out, i = out + ".+", i + 2
        elif c == "*":
            while line[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            i += c == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return keeps, only_dir, out


def folder_rules(folder: str) -> list[list]:
    """[kind, folder, keeps, for folders only, pattern] of the ignore files in a folder."""
    out = []
    for kind, name in _RULE_FILES:
        fs, inner = _opened(f"{folder.rstrip('/')}/{name}")
        if fs.get_file_info(inner).type == pafs.FileType.File:
            with fs.open_input_stream(inner) as f:
                text = f.read().decode("utf-8", "replace")
            out += [[kind, folder.rstrip("/"), *r] for line in text.removeprefix("﻿").split("\n") if (r := rule(line))]
    return out


@functools.lru_cache(4096)
def _compiled(pattern: str):
    return re.compile(pattern, re.S)


def decided(path: str, is_dir: bool, rules: list[list]) -> bool | None:
    """True if the rules keep a path, False if they leave it out, None if none fits."""
    for wanted, _ in _RULE_FILES:
        for kind, folder, keeps, only_dir, pattern in reversed(rules):
            if kind == wanted and (is_dir or not only_dir) and _compiled(pattern).fullmatch(path[len(folder) + 1 :]):
                return keeps
    return None


def _admitted(path: str, is_dir: bool, rules: list[list]) -> bool:
    name, said = path.rsplit("/", 1)[1], decided(path, is_dir, rules)
    return name != ".git" and (said or said is None and not name.startswith("."))


# walking and reading


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _expanded(excluded: tuple[str, ...]):
    """Folders with their rules -> what is admitted in them; a folder's rules go on with its own."""

    def run(batches):
        for batch in batches:
            for folder, said in zip(batch.column("path").to_pylist(), batch.column("rules").to_pylist()):
                rules, rows = json.loads(said), []
                fs, inner = _opened(folder)
                for e in fs.get_file_info(pafs.FileSelector(inner)):
                    path = f"{folder.rstrip('/')}/{e.base_name}"
                    is_dir = e.type == pafs.FileType.Directory
                    if not _admitted(path, is_dir, rules) or any(path == x or path.startswith(x + "/") for x in excluded):
                        continue
                    if "://" not in path and os.path.islink(path):
                        raise EngineError("INDEX_LINK_REFUSED", path)
                    if not is_dir and e.type != pafs.FileType.File:
                        raise EngineError("INDEX_SCAN_FAILED", path)
                    rows.append((path, is_dir, e.mtime, e.size, json.dumps(rules + folder_rules(path)) if is_dir else None))
                yield _table(rows, _WALKED)

    return run


def scan(spark: SparkSession, path: str, kind: str, scratch: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, modified, length of the admitted files; a file is admitted whatever the rules say. The levels of the walk
    are tables below the folder `scratch`, which the caller deletes."""
    top = _plain(path)
    fact = _fact(top)
    if fact.type == pafs.FileType.NotFound:
        raise EngineError("INDEX_SCAN_FAILED", path)
    if (fact.type == pafs.FileType.Directory) != (kind == "tree"):
        raise EngineError("INDEX_SCOPE_KIND_CHANGED", path)
    if kind != "tree":
        return spark.createDataFrame([(top, fact.mtime, fact.size)], LISTED)
    rules, above = [], top
    folders = [top]
    while "/" in above.rstrip("/") and not above.endswith("://"):
        above = above.rsplit("/", 1)[0]
        folders.append(above or "/")
    for folder in reversed(folders):  # the folders above the tree, then the tree's own
        if not folder.endswith(":/"):
            rules += folder_rules(folder)
    level, out, k = spark.createDataFrame([(top, json.dumps(rules))], "path string, rules string"), None, 0
    while True:
        target = f"{scratch}/level={k}"
        level.mapInArrow(_expanded(tuple(x.rstrip("/") for x in exclude)), _WALKED).write.parquet(target)
        found = spark.read.schema(_WALKED).parquet(target)
        files = found.filter("not is_dir").select("path", "modified", "length")
        out = files if out is None else out.union(files)
        level, k = found.filter("is_dir").select("path", "rules"), k + 1
        if level.isEmpty():
            return out
        level = level.repartition(spark.sparkContext.defaultParallelism)


def _contents(batches):
    """The bytes of listed files. A file whose state is another before or after its reading is an error."""
    for batch in batches:
        rows, held = [], 0
        for path, modified, length in zip(*(batch.column(c).to_pylist() for c in ("path", "modified", "length"))):
            fs, inner = _opened(path)
            if length <= MAX_SOURCE_BYTES:
                with fs.open_input_stream(inner) as f:
                    data = f.read()
            else:
                data = None
            after = _fact(path)
            if after.size != length or after.mtime.timestamp() != modified.timestamp() or data is not None and len(data) != length:
                raise EngineError("INDEX_SCAN_CHANGED", path)
            rows.append((path, modified, length, data))
            held += length
            if held > READ_BYTES:
                yield _table(rows, LISTED + ", content binary")
                rows, held = [], 0
        yield _table(rows, LISTED + ", content binary")


def contents(listed: DataFrame) -> DataFrame:
    """path, modified, length, content of listed files; null content for files over the limit."""
    spread = listed.repartition(listed.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(_contents, LISTED + ", content binary")


def existing(paths: DataFrame) -> DataFrame:
    """Those of the paths that are files now, whatever the rules say of them."""

    def run(batches):
        for batch in batches:
            there = [_fact(p).type == pafs.FileType.File for p in batch.column("path").to_pylist()]
            yield batch.filter(pa.array(there, pa.bool_()))

    return paths.select("path").mapInArrow(run, "path string")


def union(scans: list[DataFrame]) -> DataFrame:
    """All selections together, one row a path."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["path"])


def stable(before: DataFrame, after: DataFrame) -> None:
    """Two scans must list the same files in the same state."""
    again = after.select("path", F.col("modified").alias("then"), F.col("length").alias("size"))
    both = before.select("path", "modified", "length").join(again, "path", "full_outer")
    if not both.filter(~F.col("modified").eqNullSafe(F.col("then")) | ~F.col("length").eqNullSafe(F.col("size"))).isEmpty():
        raise EngineError("INDEX_SCAN_CHANGED")


def too_large(files: DataFrame) -> DataFrame:
    return files.filter(F.col("length") > MAX_SOURCE_BYTES)

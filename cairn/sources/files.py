"""Folders as tables: a listing with the facts that only the file system knows, and contents by Spark."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.privacy import DENY_FOLDERS, MAX_DEPTH, MAX_FILE

LISTING = "path string, size long, modified double, depth int, is_symlink boolean, inside boolean"


def ignore_patterns(folder: str, name: str = ".indexignore") -> list[str]:
    """Patterns of a folder's ignore file: trimmed lines, without blank ones and comments."""
    try:
        lines = Path(folder, name).read_text().splitlines()
    except FileNotFoundError:
        return []
    return [s for x in lines if (s := x.strip()) and not s.startswith("#")]


def checked_folder(folder: str) -> str:
    """The canonical path of a folder that may be indexed: it exists, is a folder and not the home folder."""
    path = os.path.realpath(os.path.expanduser(folder))
    if not os.path.isdir(path):
        raise NotADirectoryError(folder)
    if path == os.path.realpath(os.path.expanduser("~")):
        raise PermissionError("the home folder itself is never indexed")
    return path


def listing(spark: SparkSession, folder: str, folders_allowed: list[str] | None = None, deny: list[str] | tuple[str, ...] = DENY_FOLDERS) -> DataFrame:
    """The files below a local folder.  Denied and too deep folders are not entered; links are listed as
    such and not followed.  A walk is the driver's work; `stored_listing` is for stores with more files than a
    driver should list."""
    root = checked_folder(folder)
    allowed = [os.path.realpath(os.path.expanduser(a)) for a in (folders_allowed or [folder])]
    rows = []
    for at, dirs, names in os.walk(root):
        level = 0 if at == root else os.path.relpath(at, root).count("/") + 1
        dirs[:] = sorted(d for d in dirs if d not in deny and level <= MAX_DEPTH)
        for n in sorted(names):
            path = os.path.join(at, n)
            info, real = os.lstat(path), os.path.realpath(path)
            inside = any(real == a or real.startswith(a.rstrip("/") + "/") for a in allowed)
            rows.append((path, info.st_size, info.st_mtime, level, os.path.islink(path), inside))
    return spark.createDataFrame(rows, LISTING)


def stored_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The files below a folder of any file system, as `listing` has them: Spark lists it in parallel tasks and reads no
    content.  Stores have no links, and what lies below the folder is inside."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^file:/*", "/")
    below = F.substr(path, F.instr(path, F.lit(folder.rstrip("/").removeprefix("file://"))) + F.lit(len(folder.rstrip("/").removeprefix("file://")) + 1))
    level = F.size(F.split(below, "/")) - 1
    return raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("modified"), level.alias("depth"), F.lit(False).alias("is_symlink"), F.lit(True).alias("inside"))


def contents(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """path, size, hash, content of the files below a folder, or of listed files and no others; the size limit
    reaches the scan, and content is read twice only if both it and its hash are asked for apart."""
    if not where:
        return spark.createDataFrame([], "path string, size long, hash string, content binary")
    listed = [w.replace("\\", "\\\\").translate({ord(c): f"\\{c}" for c in "*?[]{}"}) for w in where] if isinstance(where, list) else where  # no globs
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", isinstance(where, str)).load(listed).where(F.col("length") <= MAX_FILE)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), "content")

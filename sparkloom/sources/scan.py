"""Scanning a source tree into rows.

The tree is listed on the driver without entering ignored directories; contents are read by the executors, so no file
content passes the driver. Spark's own file sources leave out names that begin with . or _, which a source tree needs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions.text import content_hash

LISTED = "ord long, path string, relative_path string"
READ = "ord long, path string, relative_path string, size_bytes long, mtime double, content binary, error string"


def listing(root: str) -> Iterator[tuple[str, str]]:
    """(path, relative path) of each file, names sorted, the files of a directory before its sub-directories, ignored directories left out."""
    stack, seen = [""], set()
    while stack:
        here = stack.pop()
        real = os.path.realpath(os.path.join(root, here))
        if real in seen:  # a link to a directory above
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name)
        except OSError:
            continue
        below = []
        for e in entries:
            relative = f"{here}/{e.name}" if here else e.name
            if e.is_dir():
                if e.name not in paths.IGNORED_DIRS:
                    below.append(relative)
            else:
                yield e.path, relative
        stack += below


def read_files(spark: SparkSession, root: str, batch: int = 64) -> DataFrame:
    """(ord, path, relative_path, size_bytes, mtime, content, error): every file of a tree; an unreadable one has an error and no content."""
    files = [(i, p, r) for i, (p, r) in enumerate(listing(root))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part, rows = b.iloc[lo : lo + batch], []
                for p in part["path"]:
                    try:
                        with open(p, "rb") as f:
                            content, stat = f.read(), os.fstat(f.fileno())
                        rows.append((stat.st_size, stat.st_mtime, content, None))
                    except OSError as e:
                        rows.append((None, None, None, str(e)))
                yield pd.concat([part.reset_index(drop=True), pd.DataFrame(rows, columns=["size_bytes", "mtime", "content", "error"])], axis=1)

    tree = spark.createDataFrame(files, LISTED) if files else spark.createDataFrame([], LISTED)
    return tree.repartition(max(1, min(len(files) // batch + 1, 10_000))).mapInPandas(read, READ)


def ignore_rules(root: str, extra: list[str] | None = None) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(directory, rules) of the extra patterns and of every ignore file of a tree."""
    out = [("", paths.compile_gitignore("\n".join(extra)))] if extra else []
    if set(os.path.abspath(root).split(os.sep)) & set(paths.IGNORED_DIRS):
        return out
    for p, r in listing(root):
        if os.path.basename(p) == ".gitignore":
            with open(p, encoding="utf-8", errors="replace") as f:
                out.append((os.path.dirname(r), paths.compile_gitignore(f.read())))
    return out


def is_ignored(path, rules):
    """Whether any ignore file above a path ignores it; one that allows it again does not undo another."""
    out = F.lit(False)
    for base, own in rules:
        inner = F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 20)) if base else path
        out = out | F.coalesce(paths.last_match(inner, own), F.lit(False))
    return out


def dispositions(read: DataFrame, rules: list) -> DataFrame:
    """The files with language, content_hash and disposition: error, secret, ignored, binary or kept, in this precedence."""
    p = F.col("relative_path")
    disposition = F.when(F.col("error").isNotNull(), "error").when(paths.is_secret(p), "secret").when(is_ignored(p, rules), "ignored").when(paths.is_binary(p, F.col("content")), "binary").otherwise("kept")
    return read.withColumn("disposition", disposition).withColumn("language", paths.language(p, F.col("content"))).withColumn("content_hash", content_hash(F.col("content")))


def scan(spark: SparkSession, root: str, extra_ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(files, counts by disposition, errors) of a tree. A path that is missing or no directory gives no files and an error."""
    if not os.path.isdir(root):
        problem = f"{'not a directory' if os.path.exists(root) else 'no such path'}: {root}"
        empty = dispositions(spark.createDataFrame([], READ), [])
        return empty, empty.groupBy("disposition").count(), [problem]
    all_ = dispositions(read_files(spark, root), ignore_rules(root, extra_ignore))
    return all_.where("disposition = 'kept'").drop("disposition"), all_.groupBy("disposition").agg(F.count("*").alias("count")), []

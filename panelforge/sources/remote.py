"""Files opened by tasks: random access to local and remote paths, without reading them whole."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within it."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


def listing(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """(path, length) of the files at or under a path with one of the suffixes; contents aren't read.

    Names and lengths alone pass the driver, as in any listing of Spark's, which leaves out empty files.
    """
    where, at = file_system(path.rstrip("/"))
    top = where.get_file_info(at)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = at if isinstance(where, fs.LocalFileSystem) else path.rstrip("/")
    rows = [(prefix + f.path[len(at) :], f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes or "")]
    return spark.createDataFrame(sorted(rows), "path string, length long")


def spread(files: DataFrame, n: int) -> DataFrame:
    """Rows dealt over n tasks, for work that takes long on each row."""
    return files.repartition(max(1, n), F.xxhash64(*files.columns))

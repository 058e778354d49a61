"""The folder that the driver and the executors share, and files on any file system that pyarrow can open."""

from __future__ import annotations

import glob
import os
import tempfile

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only if none is set and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="aerolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def files_below(path: str, suffixes: tuple[str, ...], recursive: bool = True) -> list[tuple[str, int]]:
    """(URI or path, bytes) of the files with a suffix in a folder (or of the file, or of a local pattern), in order.
    Names that begin with '_' or '.' are passed over, as Spark does."""
    system, at = opened(path)
    head = path[: len(path) - len(at)] if "://" in path and path.endswith(at) and not path.startswith("file:") else ""
    if any(c in at for c in "*?[") and isinstance(system, fs.LocalFileSystem):
        found = system.get_file_info(glob.glob(at, recursive=True))
    else:
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=recursive))
    kept = [i for i in found if i.type == fs.FileType.File and i.path.endswith(suffixes) and not i.base_name.startswith(("_", "."))]
    return sorted((head + i.path, i.size) for i in kept)

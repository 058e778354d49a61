"""Results kept in the shared folder: a call with the same arguments and unchanged input files reads what was written.

A result lies at <root>/<name>/<key>/run-<id>; the key is a hash of the name, the arguments and each input file's path, size
and time. A run counts once Spark has committed it as a whole, so that a failed or unfinished one is never read; of several
the latest counts. Writers use folders of their own and can't disturb each other or readers.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .shared import opened, shared_dir


def _plain(x):
    """Arguments as JSON: sets in order, times as text; what has no such form is an error, as its text may change."""
    if isinstance(x, Mapping):
        return {"map": sorted((json.dumps(_plain(k)), _plain(v)) for k, v in x.items())}
    if isinstance(x, (set, frozenset)):
        return {"set": sorted(json.dumps(_plain(v)) for v in x)}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, (dt.datetime, dt.date, dt.timedelta)):
        return {type(x).__name__: str(x)}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise TypeError(f"an argument of type {type(x).__name__} can't be part of a key")


def versions(paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, nanoseconds) of every file below the paths, in order."""
    out = []
    for path in paths:
        system, at = opened(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
        out += [(i.path, i.size, i.mtime_ns or 0) for i in files]
    return sorted(out)


def result_key(name: str, args: Mapping, inputs: Sequence[str] = ()) -> str:
    return hashlib.sha256(json.dumps([name, _plain(args), versions(inputs)], sort_keys=True).encode()).hexdigest()


class ResultCache:
    """Results of one session's functions below a folder (that of spark.checkpoint.dir, if none is given)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/aerolith/results").rstrip("/")

    def _folder(self, name: str, key: str) -> str:
        return f"{self.root}/{name}/{key}"

    def runs(self, name: str, key: str) -> list[str]:
        """Committed runs, the latest first."""
        folder = self._folder(name, key)
        system, at = opened(folder)
        done = [i for i in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if i.base_name == "_SUCCESS"]
        return [f"{folder}/{i.path.rsplit('/', 2)[1]}" for i in sorted(done, key=lambda i: (i.mtime_ns or 0, i.path), reverse=True)]

    def get(self, name: str, make: Callable[..., DataFrame], args: Mapping | None = None, inputs: Sequence[str] = (), reload: bool = False) -> DataFrame:
        """make(**args), from the cache if it holds that call. inputs: the files or folders that `make` reads; with
        reload the result is made again and counts from then on."""
        args = dict(args or {})
        key = result_key(name, args, inputs)
        found = [] if reload else self.runs(name, key)
        if not found:
            path = f"{self._folder(name, key)}/run-{uuid.uuid4().hex}"
            made = make(**args)
            made.write.parquet(path)
            return self.spark.read.schema(made.schema).parquet(path)
        return self.spark.read.parquet(found[0])

    def forget(self, name: str, keep: Sequence[str] = ()) -> int:
        """Delete the results of a name but those of the given keys; how many keys went. For when no job reads them."""
        system, at = opened(f"{self.root}/{name}")
        old = [i.path for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name not in keep]
        for path in old:
            system.delete_dir(path)
        return len(old)

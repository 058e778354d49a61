"""Shared helpers: durable intermediate tables and vectorised word hashing of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if none is set and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="aerolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/aerolith/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run, in a database of its own in the shared folder; leaving the block drops them and their files."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"aerolith_{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_dir(self.spark)}/aerolith/{self.name}'")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")

    def save(self, df: DataFrame, tag: str, bucket_by: str | None = None, buckets: int = 1) -> DataFrame:
        """df as a table, read back; with bucket_by joins on that column need no shuffle of it."""
        name = f"{self.name}.{tag.replace('-', '_')}_{uuid.uuid4().hex[:8]}"
        w = df.write.format("parquet")
        (w.bucketBy(buckets, bucket_by) if bucket_by else w).saveAsTable(name)
        return self.spark.table(name)


def kept_columns(keep: list[str]) -> list[Column]:
    """The kept columns as kept_0, kept_1, ...: names that no column of a result has."""
    return [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]


def kept_names(keep: list[str]) -> list[str]:
    return [f"kept_{i}" for i in range(len(keep))]


def restored(df: DataFrame, keep: list[str], added: list[str]) -> DataFrame:
    """kept_0, ... under their own names and the result columns; one whose name a kept column has gets underscores."""
    taken, out = {c.lower() for c in keep}, [F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]
    for c in added:
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use yet (names compare without case, as in Spark)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


# ---------------------------------------------------------------- Arrow text

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept up to a few MB, else made for the one call)."""
    have = _POWERS.get("f")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if size > 4 * SLICE_BYTES:
            return out[0], out[1]
        _POWERS["f"], _POWERS["i"] = out
    return _POWERS["f"], _POWERS["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mix (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into the bytes) in runs of about `most` bytes; a null is empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def word_spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index of the first word of each row with one more at the end); words never cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[0] = inside[0]
    edge[n] = inside[-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = np.unique(cuts[inside[np.minimum(cuts, n - 1)] & inside[cuts - 1]])  # a word on both sides: one ends, one begins
    marks = np.flatnonzero(edge)
    if len(cuts):
        marks = np.sort(np.concatenate([marks, cuts, cuts]))
    starts, ends = marks[0::2], marks[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: the hash of data[s:e] is (out[e] - out[s]) * BASE**-s."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (as long as there are k words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix64(h)


# ---------------------------------------------------------------- groups of texts, and columns packed into binaries

#: bytes of text of a group of rows
GROUP_BYTES = 8 << 20
#: what groups and buckets send each other: rows of packed columns
PART = "bucket bigint, grp bigint, n int, blob binary"


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0


def group_count(total: int) -> int:
    return min(20_000, max(1, -(-total // GROUP_BYTES)))


def packed_texts(df: DataFrame, keep: list[str], text_col: str, extra: dict[str, Column], fields: str, measure: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """The kept columns (kept_0, ...), the extra ones, row_no, grp, n_bytes, what `measure` says of the texts, and the
    packed text; a group holds about GROUP_BYTES of neighbouring rows' texts, a null text is empty."""
    n = len(keep) + len(extra) + 1
    src = df.select(*kept_columns(keep), *[c.alias(k) for k, c in extra.items()], F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("whole"))
    schema = T.StructType([*src.schema.fields[:n], *T._parse_datatype_string(f"grp bigint, n_bytes bigint, {fields}, packed binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, done, part = zstandard.ZstdCompressor(level=3), 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column(n)):
                size = np.diff(offs)
                grp = part + (done + np.cumsum(size)) // GROUP_BYTES
                done += int(offs[-1])
                packed = pa.array([comp.compress(data[i:j].data) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())
                some = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*some.columns[:n], pa.array(grp), pa.array(size), *measure(data, offs), packed], schema.names)

    return src.mapInArrow(run, schema)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte, compressed together; whole numbers of 64 bits as differences."""
    raw = []
    for c in columns:
        c = np.ascontiguousarray(np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 else c)
        raw.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes() if c.ndim == 1 else c.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(blob: bytes, n: int, kinds: tuple) -> list[np.ndarray]:
    """kinds: a type, or a number for rows of so many bytes."""
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), [], 0
    for kind in kinds:
        width = kind if isinstance(kind, int) else np.dtype(kind).itemsize
        c = raw[at : at + n * width]
        at += n * width
        if isinstance(kind, int):
            out.append(c.reshape(n, width))
        else:
            c = np.ascontiguousarray(c.reshape(width, n).T).reshape(-1).view(kind)
            out.append(np.cumsum(c) if kind is np.int64 else c)
    return out


def unpack_all(table: pa.Table, kinds: tuple) -> list[np.ndarray]:
    held = [unpack(blob, n, kinds) for n, blob in zip(table["n"].to_pylist(), table["blob"].to_pylist(), strict=True)]
    return [np.concatenate(x) for x in zip(*held, strict=True)]


def part_rows(bucket: list, grp: list, n: list, blob: list) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "grp": pa.array(grp, pa.int64()), "n": pa.array(n, pa.int32()), "blob": pa.array(blob, pa.binary())})


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of equal entries."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(sorted_keys)).astype(np.int64)[: len(first)]


def deal(bucket: np.ndarray, grp: int, columns: list[np.ndarray], out: tuple[list, ...]) -> None:
    """Adds one row for each bucket to out (for part_rows), with the columns' entries in the given order."""
    order = np.argsort(bucket, kind="stable")
    for i, j in zip(*runs_of(bucket[order]), strict=True):
        at = order[i:j]
        for o, x in zip(out, (int(bucket[at[0]]), grp, j - i, pack(*[c[at] for c in columns])), strict=True):
            o.append(x)


def by_bucket(parts: DataFrame, buckets: int):
    """Grouped by bucket, a few buckets a task, one at a time in memory."""
    return parts.repartition(min(buckets, max(64, -(-buckets // 4))), "bucket").groupBy("bucket")

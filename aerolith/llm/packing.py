"""Sequences of a fixed number of tokens, packed along a space-filling curve so that neighbours are alike.

A document's token ids are hashed into a vector of BUCKETS counts (their roots, scaled to length 1), which a fixed
random matrix projects to DIMS numbers; their place on a Hilbert curve of BITS bits a dimension is the document's key.
Documents are sorted by ranges of (key, id), and each range is one stream of ids that is cut into sequences. What is left
at a range's end is cut at powers of two, which need no padding, so that ranges are packed on their own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, shared_dir, text_slices
from .token_files import worker_encoder

BUCKETS, DIMS, BITS = 1024, 4, 12
#: rows of one table of counts
ROWS = 512
#: ids that a batch of sequences holds before it is handed on
BATCH_IDS = 1 << 20

TOKENS = "doc bigint, curve bigint, n bigint, ids binary"
SEQUENCES = "sequence_id bigint, length int, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint>>"


def projection() -> np.ndarray:
    return np.random.default_rng(5).normal(size=(BUCKETS, DIMS))


def buckets_of(vocabulary: int) -> np.ndarray:
    return (mix64(np.arange(vocabulary, dtype=np.uint64) + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64)


def document_points(bucket: np.ndarray, n: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """(document, DIMS) for runs of n hashed ids each: roots of the counts, scaled to length 1, projected."""
    out = np.zeros((len(n), DIMS))
    ends = np.cumsum(n)
    for lo in range(0, len(n), ROWS):
        hi = min(lo + ROWS, len(n))
        some = bucket[ends[lo] - n[lo] : ends[hi - 1]]
        row = np.repeat(np.arange(hi - lo), n[lo:hi])
        counts = np.sqrt(np.bincount(row * BUCKETS + some, minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS))
        out[lo:hi] = (counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-300)) @ matrix
    return out


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each cell (row of whole numbers below 2^bits) on the Hilbert curve.

    A gray code is read off the bits from the highest down, and each level turns or mirrors the axes below it.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, below = np.int64(1) << level, (np.int64(1) << level) - 1
        for d in range(dims):
            high = (x[:, d] & bit) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(high, below, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, dims - 1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> level) & 1)
    return key


def curve_keys(points: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected points; a coordinate, whose spread is about 1, is cut off at 4 spreads."""
    cells = np.clip(np.floor((points + 4) * (1 << BITS) / 8), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64))


def _tokens(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, curve, n, ids): the ids of each whole text with the end id, as compressed bytes of the encoder's type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, comp = worker_encoder(tokenizer_path), zstandard.ZstdCompressor(level=1)
        hashed, matrix, end = buckets_of(1 << 16 if enc.dtype.itemsize == 2 else enc.tokenizer.get_vocab_size()), projection(), np.array([end_id], enc.dtype)
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column(1), 2 << 20):
                ids = [np.concatenate([x, end]) for x in enc.encode(data, offs)]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                keys = curve_keys(document_points(hashed[np.concatenate(ids)], n, matrix))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(keys), pa.array(n), pa.array([comp.compress(x.data) for x in ids], pa.binary())], ["doc", "curve", "n", "ids"])

    src = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, TOKENS)


class Stream:
    """Sequences cut from one stream of documents; `take` hands out what is full."""

    def __init__(self, length: int, part: int):
        self.length, self.next = length, part << 40
        self.ids: list[np.ndarray] = []
        self.pieces: list[tuple] = []  # (doc, start, length, doc_tokens) of the open sequence
        self.filled = 0
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            k = min(n - at, self.length - self.filled)
            self.ids.append(ids[at : at + k])
            self.pieces.append((doc, at, k, n))
            self.filled, at = self.filled + k, at + k
            if self.filled == self.length:
                self._close()

    def _close(self) -> None:
        self.out.append((self.next, np.concatenate(self.ids), self.pieces))
        self.next, self.ids, self.pieces, self.filled = self.next + 1, [], [], 0

    def end(self) -> None:
        """The rest as sequences whose lengths are powers of two, the longest first."""
        if not self.filled:
            return
        rest, flat = self.pieces, np.concatenate(self.ids)
        whole, at = self.length, 0
        self.ids, self.pieces, self.filled = [], [], 0
        sizes = [1 << i for i in range(len(flat).bit_length() - 1, -1, -1) if len(flat) >> i & 1]
        for size in sizes:
            self.length = size
            while self.filled < size and rest:
                doc, start, k, n = rest.pop(0)
                used = min(k, size - self.filled)
                if used < k:
                    rest.insert(0, (doc, start + used, k - used, n))
                self.ids.append(flat[at : at + used])
                self.pieces.append((doc, start, used, n))
                self.filled, at = self.filled + used, at + used
            self._close()
        self.length = whole

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        ids = pa.array([x.tobytes() for _, x, _ in out], pa.binary())
        flat = [p for *_, pieces in out for p in pieces]
        names = ["doc_id", "start", "length", "doc_tokens"]
        fields = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], pa.int64()) for i in range(4)], names)
        pieces = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) for *_, p in out)]).astype(np.int32)), fields)
        return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in out], pa.int64()), pa.array([len(x) for _, x, _ in out], pa.int32()), ids, pieces], ["sequence_id", "length", "ids", "pieces"])


def pack_documents(df: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Write sequences of `length` ids (a power of two, or padding is needed at the ends) as Parquet; returns the path.

    A row has sequence_id (ascending along the curve within a file, unique, with gaps between files), length, ids (little-
    endian bytes, of 2 or 4 a token by the size of the vocabulary; see sequence_ids), and the pieces of documents in it, which follow each other without gaps. A null text is a document of the end id alone.
    Null and repeated ids stay documents of their own. An empty table gives no sequences. Other columns are not read.
    The ids are written once before they are sorted, so that texts are encoded once; that table is dropped at the end.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/aerolith/sequences-{uuid.uuid4().hex}"
    dtype = worker_encoder(tokenizer_path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, dec = Stream(length, TaskContext.get().partitionId()), 0, zstandard.ZstdDecompressor()
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                some = np.frombuffer(dec.decompress(ids.as_buffer()), dtype)
                stream.add(doc, some)
                held += len(some)
                if held >= BATCH_IDS and stream.out:
                    yield stream.take()
                    held = 0
        stream.end()
        if stream.out:
            yield stream.take()

    with Scratch(spark) as scratch:
        tokens = scratch.save(_tokens(df, tokenizer_path, end_id, id_col, text_col), "tokens")
        order = ["curve", "doc", F.crc32("ids")]  # equal rows may stand in any order
        tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "ids").mapInArrow(run, SEQUENCES).write.option("compression", "zstd").parquet(path)
    return path


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """sequence_id, length, ids (bytes) and pieces of the packed sequences."""
    return spark.read.schema(SEQUENCES).parquet(path)


def ids_of(column: pa.Array, length: np.ndarray) -> np.ndarray:
    """The ids of a batch of sequences, one after the other; their width follows from the bytes."""
    total = int(length.sum())
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if total else np.zeros(0, np.uint8)
    return raw.view("<u2" if len(raw) == 2 * total else "<u4")


def sequence_ids(sequences: DataFrame) -> DataFrame:
    """The sequences with their ids as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(1).to_numpy()
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ids_of(b.column(2), length).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), arrays, b.column(3)], b.schema.names)

    return sequences.mapInArrow(run, SEQUENCES.replace("ids binary", "ids array<int>"))


def padded(ids: str = "ids", to: int = 1024, pad_id: int = 0):
    """The ids of a sequence (an array), padded to a length unless they are a power of two."""
    c, n = F.col(ids), F.size(ids)
    return F.when(F.bit_count(n) <= 1, c).otherwise(F.concat(c, F.array_repeat(F.lit(pad_id), F.lit(to) - n)))


def piece_digests(sequences: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece, from the sequences' ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, at = b.column(3), b.column(1).to_numpy().astype(np.int64)
            flat = ids_of(b.column(2), at).astype("<u4")
            p = pieces.flatten()
            many = np.diff(pieces.offsets.to_numpy())
            size = p.field("length").to_numpy()
            seq = np.repeat(np.arange(len(many)), many)
            before = np.cumsum(size) - size
            first = np.cumsum(at) - at
            crc = np.array([zlib.crc32(flat[i : i + k].data) for i, k in zip(before.tolist(), size.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([p.field("doc_id"), p.field("start"), p.field("length"), pa.array(crc), p.field("doc_tokens"), b.column(0).take(pa.array(seq)), pa.array(before - first[seq])], names)

    return sequences.select("sequence_id", "length", "ids", "pieces").mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

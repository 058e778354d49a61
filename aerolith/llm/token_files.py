"""Token-id files: every document's ids compressed on their own with a shared zstandard dictionary.

A file is a Parquet table of shards. A shard holds the frames of neighbouring documents in one binary, the offset of
each frame, the documents' ids (the least and the largest in columns of their own) and token counts, and the hash of the
dictionary, so that one short document can be read without the rest. Shards stand in ascending document order: (part, shard).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prefix_hash, shared_dir, span_hash, text_slices

#: bounds of the dictionary's training sample (documents, characters of each, bytes of ids) and of the dictionary
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES, DICT_BYTES = 500, 16_000, 4 << 20, 64 << 10
#: a shard is closed once its frames have so many bytes
SHARD_BYTES = 4 << 20
#: distinct pieces of text whose ids a worker remembers
REMEMBERED = 200_000
#: pieces of one call of the tokenizer
JOIN = 2000
LEVEL = 3

SHARD = "part int, shard int, dict_sha256 string, first_doc bigint, last_doc bigint, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, frames binary"

# White space beyond ' ' and '\n' that a byte-level pre-tokenizer may join with its neighbours: fixed values (UTF-8).
ODD = np.zeros(256, bool)
ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
MARK[39] = False


def joined_space(data: np.ndarray) -> np.ndarray:
    """Marks bytes at which the text can't be cut before single spaces and line ends."""
    bad = ODD[data]
    if len(data) < 2:
        return bad
    a, b = data[:-1], data[1:]
    space = (data == 32) | (data == 10)
    bad[1:] |= space[1:] & space[:-1]
    bad[1:] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    bad[1:] |= (a == 0xE1) & (b == 0x9A)
    if len(data) > 2:
        c = data[2:]
        bad[2:] |= (a[:-1] == 0xE2) & (((b[:-1] == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b[:-1] == 0x81) & (c == 0x9F)))
        bad[2:] |= (a[:-1] == 0xE3) & (b[:-1] == 0x80) & (c == 0x80)
    return bad


def word_ends(data: np.ndarray) -> np.ndarray:
    """Marks ASCII punctuation (but the apostrophe) right after a Latin letter: a pre-tokenizer always cuts there."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    letter = LETTER[data[:-1]]
    letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    out[1:] = letter & MARK[data[1:]]
    return out


class Encoder:
    """Ids of whole texts by the tokenizers library. Texts with only single spaces and line ends are cut before
    each of these and after words, where a byte-level pre-tokenizer cuts as well; each distinct piece is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: strings that the library takes out of a text before it looks at words
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces that don't hold a line end are joined by line ends, which always stand alone, and told apart again."""
        out: list[bytes] = [b""] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if b"\n" not in p]
        for lo in range(0, len(joined), JOIN):
            run = joined[lo : lo + JOIN]
            ids = np.frombuffer(self._encode([b"\n".join([*(pieces[i] for i in run), b""]).decode()])[0], self.dtype)
            ends = np.flatnonzero(ids == self.line_end)
            at = 0
            for i, e in zip(run, ends.tolist(), strict=True):
                out[i] = ids[at:e].tobytes()
                at = e + 1
        rest = [i for i, p in enumerate(pieces) if b"\n" in p]
        for i, x in zip(rest, self._encode([pieces[i].decode() for i in rest]), strict=True):
            out[i] = x
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
        rows = len(offs) - 1
        bad = np.concatenate([[0], np.cumsum(joined_space(data))])
        # joined white space across two rows doesn't count: look at each row's own bytes
        plain = np.zeros(rows, bool)
        for r in np.flatnonzero(np.diff(offs) > 0):
            lo, hi = offs[r], offs[r + 1]
            plain[r] = bad[hi] == bad[lo] or not joined_space(data[lo:hi]).any()
        raw = data.tobytes()
        for token in self.whole:  # a text that holds one is encoded as it is
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(offs, at, side="right") - 1] = False
                at = raw.find(token, at + 1)
        cut = np.zeros(len(data), bool)
        cut[offs[:-1][np.diff(offs) > 0]] = True
        cut |= (data == 32) | (data == 10)
        cut[1:] |= data[:-1] == 10
        cut |= word_ends(data)
        starts = np.flatnonzero(cut)
        starts = starts[plain[np.searchsorted(offs, starts, side="right") - 1]]
        row = np.searchsorted(offs, starts, side="right") - 1
        ends = np.minimum(np.concatenate([starts[1:], [len(data)]]), offs[row + 1]) if len(starts) else starts
        keys, first, inv = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        names = keys.tolist()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        pieces = [known.get(k) or older.get(k) for k in names]
        new = [i for i, x in enumerate(pieces) if x is None]
        if new:
            lo, hi = starts[first].tolist(), ends[first].tolist()
            for i, x in zip(new, self._encode_pieces([raw[lo[i] : hi[i]] for i in new]), strict=True):
                pieces[i] = x
        known.update(zip(names, pieces, strict=True))
        flat = np.frombuffer(b"".join(pieces), self.dtype)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        place = np.concatenate([[0], np.cumsum(size)])
        n = size[inv]
        out_at = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(out_at[-1]) + np.repeat(place[inv] - out_at[:-1], n)] if len(n) else flat[:0]
        bounds = out_at[np.searchsorted(row, np.arange(rows + 1))]
        for r in range(rows):
            if plain[r]:
                yield ids[bounds[r] : bounds[r + 1]]
            else:
                text = data[offs[r] : offs[r + 1]].tobytes().decode()
                yield np.frombuffer(self._encode([text])[0], self.dtype) if text else ids[:0]


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """A Python worker keeps one encoder, so that later tasks find the pieces that earlier ones met."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass(frozen=True)
class Codec:
    """The end id, the width of stored ids, and the dictionary (may be empty)."""

    dictionary: bytes
    width: str
    end_id: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()

    def _dict(self):
        return zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None

    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self._dict())

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self._dict())


def train_codec(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> Codec:
    """A dictionary from the SAMPLE_DOCS documents of smallest key hash (at most SAMPLE_BYTES of their ids)."""
    enc = Encoder(tokenizer_path)
    key = F.xxhash64(F.col(f"`{id_col}`"))
    lowest = [r["h"] for r in df.select(key.alias("h")).orderBy("h").limit(SAMPLE_DOCS).collect()]
    part = df.filter(key <= (lowest[-1] if lowest else 0)).select(key.alias("h"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    samples, total = [], 0
    for r in part.select("h", F.substring("t", 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE_DOCS).collect():
        b = np.frombuffer(r["t"].encode(), np.uint8)
        x = next(enc.encode(b, np.array([0, len(b)]))).tobytes()
        if total + len(x) > SAMPLE_BYTES:
            break
        if x:
            samples.append(x)
            total += len(x)
    try:
        made = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little text to train on
        made = b""
    return Codec(made, enc.dtype.str, end_id)


def write_tokens(df: DataFrame, path: str, codec: Codec, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append the end id, and write shards in ascending order of id_col (nulls first)."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("t"))
    order = ["doc", F.xxhash64("t")]  # one id's rows may spread over partitions
    src = src.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, comp, part, shard = worker_encoder(tokenizer_path), codec.compressor(), TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[int] = []
        offsets, frames = [0], []
        schema = ["part", "shard", "dict_sha256", "first_doc", "last_doc", "doc_ids", "n_tokens", "offsets", "frames"]
        end = np.array([codec.end_id], codec.width)

        def flush() -> pa.RecordBatch:
            named = [d for d in docs if d is not None]  # in ascending order
            ends = named[:1] + named[-1:] or [None, None]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([codec.sha256]), *(pa.array([x], pa.int64()) for x in ends), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary())],
                schema,
            )

        for b in batches:
            names = b.column(0).to_pylist()
            for lo, hi, data, offs in text_slices(b.column(1), 2 << 20):
                for name, ids in zip(names[lo:hi], enc.encode(data, offs), strict=True):
                    frame = comp.compress(np.concatenate([ids, end]).tobytes())
                    docs.append(name)
                    counts.append(len(ids) + 1)
                    frames.append(frame)
                    offsets.append(offsets[-1] + len(frame))
                    if offsets[-1] >= SHARD_BYTES:
                        yield flush()
                        docs, counts, offsets, frames, shard = [], [], [0], [], shard + 1
        if docs:
            yield flush()

    src.mapInArrow(encode, SHARD).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `base`, the ids of all documents before each: sums of parts, then of the shards in a part."""
    shards = spark.read.schema(SHARD).parquet(path)
    sums = shards.select("part", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sorted((r["part"], r["n"]) for r in sums.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    bases, total = [], 0
    for p, n in parts:
        bases.append((p, total))
        total += n
    before = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(spark.createDataFrame(bases, "part int, first long")), "part")
    return shards.join(base.select("part", "shard", (F.col("first") + F.col("before")).alias("base")), ["part", "shard"])


def read_tokens(spark: SparkSession, path: str, codec: Codec, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless they aren't wanted) ids (array) of every document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = codec.decompressor()
        for b in batches:
            for s in b.to_pylist():
                if s["dict_sha256"] != codec.sha256:
                    raise ValueError("the shard was written with another dictionary")
                raw = [dec.decompress(s["frames"][i:j]) for i, j in zip(s["offsets"], s["offsets"][1:], strict=False)]
                wide = [np.frombuffer(x, codec.width).astype("<u4") for x in raw]
                n = np.array([len(x) for x in wide], np.int64)
                crc = np.array([zlib.crc32(x.data) for x in wide], np.int64)
                start = s["base"] + np.concatenate([[0], np.cumsum(n)[:-1]])
                out = [pa.array(s["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array(crc)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(wide).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return read_shards(spark, path).select("dict_sha256", "doc_ids", "offsets", "frames", "base").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def read_document(spark: SparkSession, path: str, codec: Codec, doc_id: int) -> list[int] | None:
    """The ids of one document: only its shard is read, only its frame decompressed."""
    at = F.array_position("doc_ids", F.lit(doc_id)).cast("int")
    held = (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)  # pushed down: other shards' frames aren't read
    row = spark.read.schema(SHARD).parquet(path).filter(held & F.array_contains("doc_ids", F.lit(doc_id)))
    place = row.select("frames", F.element_at("offsets", at).cast("int").alias("lo"), F.element_at("offsets", at + 1).cast("int").alias("hi"))
    found = place.select(F.substring("frames", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("frame")).limit(1).collect()
    return np.frombuffer(codec.decompressor().decompress(bytes(found[0]["frame"])), codec.width).tolist() if found else None


def token_files(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> tuple[str, Codec]:
    """Write df's texts as token files in the shared folder (or at path); returns the path and the codec.

    A null text counts as empty and has the end id alone. Repeated ids stay separate documents, ordered by their
    texts' hashes. An empty table gives files without shards. Other columns are not read.
    """
    codec = train_codec(df, id_col, text_col, tokenizer_path, end_id)
    path = path or f"{shared_dir(df.sparkSession)}/aerolith/tokens-{uuid.uuid4().hex}"
    write_tokens(df, path, codec, tokenizer_path, id_col, text_col)
    return path, codec

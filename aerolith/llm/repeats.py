"""Removal of repeated byte strings: every byte covered by a LENGTH-byte string that also starts earlier.

Difference-cover construction. Of every PERIOD positions of a text those in COVER are sampled. For any two positions there
is a shift below PERIOD that leads from both to samples, so if the strings at them are equal, two samples at one shift
begin the same STEM = LENGTH - PERIOD + 1 bytes. Samples whose stem occurs once are dropped. The others are dealt into
buckets by their stems, and one bucket is sorted at a time: samples of one stem are ranked by the bytes behind it and by
those before it, and two strings around them are equal exactly if the ranks agree as far as the string reaches on
either side. The bytes of a bucket are all that a task holds; how many buckets there are follows from the data.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PART, SLICE_BYTES, Scratch, by_bucket, deal, group_count, kept_names, materialize, mix64, pack, packed_texts, part_rows, prefix_hash, restored, runs_of, span_hash, text_bytes, unpack, unpack_all

LENGTH = 100
#: differences of these numbers give every remainder modulo PERIOD
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
SIDE = PERIOD - 1
#: stems of a bucket that counts them, samples of a bucket that is sorted
COUNTED, SORTED = 2_000_000, 250_000
#: stems that occur more often are not sorted together: each string around them is dealt by itself
HOT = 200_000
SALTS = 16
NONE = np.iinfo(np.int64).min
SPANS = "array<struct<start:bigint,end:bigint>>"
RESULT = f"n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {SPANS}"


def sample_places(offs: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in its bytes) of the samples with a whole stem, in ascending order; offs: where the texts begin."""
    size = np.maximum(np.diff(offs) - stem + 1, 0)
    periods = -(-size // PERIOD)
    text = np.repeat(np.arange(len(size)), periods)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)) * PERIOD
    place = (first[:, None] + np.array(COVER)).ravel()
    text = np.repeat(text, len(COVER))
    whole = place < size[text]
    return text[whole], place[whole]


class Group:
    """The texts of a group that are long enough and no later copies, in the order of their rows, and their samples."""

    def __init__(self, table: pa.Table, copied: np.ndarray, length: int):
        self.stem = length - PERIOD + 1
        row, size = table["row_no"].to_numpy(), table["n_bytes"].to_numpy()
        use = np.flatnonzero((size >= length) & ~np.isin(row, copied))
        use = use[np.argsort(row[use])]
        self.row, self.order, self.size, self.use, self.packed = row[use], table["order_id"].to_numpy()[use], size[use], use, table["packed"]

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, bytes, where its texts begin) of about SLICE_BYTES of texts each."""
        dec, lo = zstandard.ZstdDecompressor(), 0
        end = np.cumsum(self.size)
        while lo < len(self.use):
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
            data = np.frombuffer(b"".join(dec.decompress(self.packed[int(i)].as_py()) for i in self.use[lo:hi]), np.uint8)
            yield lo, data, np.concatenate([[0], np.cumsum(self.size[lo:hi])])
            lo = hi

    def keys(self, buckets: int) -> np.ndarray:
        """Bucket (upper half) and name in it (lower half) of each sample's stem."""
        out = [np.zeros(0, np.uint64)]
        for _, data, offs in self.slices():
            text, place = sample_places(offs, self.stem)
            at = offs[text] + place
            h = span_hash(prefix_hash(data), at, at + self.stem)
            low = np.uint64(0xFFFFFFFF)
            out.append(((((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (h & low))
        return np.concatenate(out)


def _hashes(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    return [pa.array([hashlib.sha256(data[i:j].data).hexdigest() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string())]


def _later_copies(texts: DataFrame, length: int) -> DataFrame:
    """(grp, row_no) of rows whose whole text an earlier row has; a text that many rows have is met in SALTS parts."""
    some = texts.filter(F.col("n_bytes") >= length).select("sha256", "grp", "order_id", "row_no")
    first = some.groupBy("sha256").agg(F.min(F.struct("order_id", "row_no")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select("sha256", F.col("first.row_no").alias("first_row"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return some.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int")).join(first, ["sha256", "salt"]).filter("row_no <> first_row").select("grp", "row_no")


def _copied(right: pa.Table) -> np.ndarray:
    """Row numbers of the copies among a group's notes (those have no blob)."""
    return right.filter(pa.compute.is_null(right["blob"]))["bucket"].to_numpy()


def _stems(left: DataFrame, notes: DataFrame, length: int, buckets: int) -> DataFrame:
    """Each group's distinct stems by bucket: sorted names and how often they occur there."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if a.num_rows:
            u, c = np.unique(Group(a, _copied(b), length).keys(buckets), return_counts=True)
            for i, j in zip(*runs_of(u >> np.uint64(32)), strict=True):
                names = np.diff((u[i:j] & np.uint64(0xFFFFFFFF)).astype(np.int64), prepend=0).astype(np.uint32)
                for o, x in zip(out, (int(u[i] >> np.uint64(32)), a["grp"][0].as_py(), j - i, pack(names, np.minimum(c[i:j], HOT + 1).astype(np.uint32))), strict=True):
                    o.append(x)
        return part_rows(*out)

    return left.groupBy("grp").cogroup(notes.groupBy("grp")).applyInArrow(run, PART)


def _repeated(stems: DataFrame, hot: int, buckets: int) -> DataFrame:
    """For each group and bucket, in the order of the names: 0 for a stem that occurs once, 1 for others, 2 for hot ones."""

    def run(t: pa.Table) -> pa.Table:
        names, counts = [], []
        for n, blob in zip(t["n"].to_pylist(), t["blob"].to_pylist(), strict=True):
            d, c = unpack(blob, n, (np.uint32, np.uint32))
            names.append(np.cumsum(d, dtype=np.int64))
            counts.append(c)
        _, inv = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate(counts))[inv]
        state = (total > 1).astype(np.uint8) + (total > hot)
        ends = np.cumsum([len(x) for x in names])
        own = [(state[e - len(x) : e], c) for x, c, e in zip(names, counts, ends, strict=True)]
        return part_rows(t["bucket"].to_pylist(), t["grp"].to_pylist(), [int(c[s > 0].sum()) for s, c in own], [zstandard.ZstdCompressor(level=1).compress(s.tobytes()) for s, _ in own])

    return by_bucket(stems, buckets).applyInArrow(run, PART)


def words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit words, so that comparing words compares bytes."""
    n, width = rows.shape
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = rows
    return out.view(">u8").astype(np.uint64)


def row_hash(rows: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(rows), seed, np.uint64)
    for w in words(rows).T:
        h = mix64(h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(h)


def valid_shifts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit s: the string that starts s bytes before the sample lies in the text (left, right: bytes there, SIDE at most)."""
    lo, hi = SIDE - right.astype(np.int64), left.astype(np.int64)
    bits = np.where(hi >= lo, (np.int64(1) << (hi - lo + 1).clip(0)) - 1, 0) << lo.clip(0)
    return bits.astype(np.uint32)


SAMPLE = (np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8, 2 * SIDE)  # stem, order, row, place, bytes left and right, those bytes
STRING = (np.uint64, np.int64, np.int64, np.int64, np.uint8)  # string, order, row, place of the sample, shift
MARK = (np.int64, np.int64, np.uint32)  # row, place of a sample, shifts whose strings start earlier too


def _samples(left: DataFrame, notes: DataFrame, length: int, counting: int, sorting: int) -> DataFrame:
    """Samples of repeated stems with the bytes on both sides, by bucket: sample buckets from 0, string buckets of hot
    stems from `sorting` on. Of equal surroundings in a group the first is kept, the others are marked at once (-1)."""
    stem = length - PERIOD + 1

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if not a.num_rows:
            return part_rows(*out)
        grp, group = a["grp"][0].as_py(), Group(a, _copied(b), length)
        u, inv = np.unique(group.keys(counting), return_inverse=True)
        state = np.zeros(len(u), np.uint8)
        seen = b.filter(pa.compute.is_valid(b["blob"]))
        for bucket, blob in zip(seen["bucket"].to_pylist(), seen["blob"].to_pylist(), strict=True):
            i, j = np.searchsorted(u, np.array([bucket, bucket + 1], np.uint64) << np.uint64(32))
            state[i:j] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        state = state[inv]
        del u, inv

        def emit(bucket: np.ndarray, columns: list[np.ndarray]) -> None:
            deal(bucket, grp, columns, out)

        found: list[list[np.ndarray]] = []
        done = 0
        for first, data, offs in group.slices():
            text, place = sample_places(offs, stem)
            st = state[done : done + len(text)]
            done += len(text)
            hit = np.flatnonzero(st)
            text, place = text[hit], place[hit]
            before, behind = np.minimum(place, SIDE), np.minimum(np.diff(offs)[text] - place - stem, SIDE)
            wide = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
            rows = np.lib.stride_tricks.sliding_window_view(wide, 2 * SIDE + stem)[offs[text] + place].copy()
            rows[:, :SIDE][np.arange(SIDE) < SIDE - before[:, None]] = 0
            rows[:, SIDE + stem :][np.arange(SIDE) >= behind[:, None]] = 0
            found.append([group.order[first + text], group.row[first + text], place, before.astype(np.uint8), behind.astype(np.uint8), st[hit], rows])
        if not found:
            return part_rows(*out)
        order_id, row, place, before, behind, st, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        one, two = row_hash(rows, 1) ^ (before.astype(np.uint64) << np.uint64(8)) ^ behind, row_hash(rows, 2)
        age = np.lexsort((place, row, order_id))
        order = age[np.argsort(one[age], kind="stable")]
        same = np.zeros(len(order), bool)
        same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        copies = np.sort(order[same])
        if len(copies):
            emit(np.full(len(copies), -1), [row[copies], place[copies], valid_shifts(before[copies], behind[copies])])
        lead = np.sort(order[~same])
        plain, hot = lead[st[lead] == 1], lead[st[lead] == 2]
        h = row_hash(rows[plain, SIDE : SIDE + stem], 3)
        where = ((mix64(h) >> np.uint64(32)) * np.uint64(sorting)) >> np.uint64(32)
        emit(where.astype(np.int64), [h, order_id[plain], row[plain], place[plain], before[plain], behind[plain], np.concatenate([rows[plain, :SIDE], rows[plain, SIDE + stem :]], axis=1)])
        for s in range(PERIOD if len(hot) else 0):
            x = hot[(valid_shifts(before[hot], behind[hot]) >> np.uint32(s)) & np.uint32(1) == 1]
            # one string is kept by the earliest sample of the group
            seq = x[np.lexsort((place[x] - s, row[x], order_id[x]))]
            h = row_hash(rows[seq, SIDE - s : SIDE - s + length], 4 + s)
            _, earliest = np.unique(h, return_index=True)
            rest = np.setdiff1d(np.arange(len(seq)), earliest)
            if len(rest):
                emit(np.full(len(rest), -1), [row[seq[rest]], place[seq[rest]], np.full(len(rest), 1 << s, np.uint32)])
            seq, h = seq[np.sort(earliest)], h[np.sort(earliest)]
            where = sorting + (((mix64(h) >> np.uint64(32)) * np.uint64(sorting)) >> np.uint64(32)).astype(np.int64)
            emit(where, [h, order_id[seq], row[seq], place[seq], np.full(len(seq), s, np.uint8)])
        return part_rows(*out)

    return left.groupBy("grp").cogroup(notes.groupBy("grp")).applyInArrow(run, PART)


def side_ranks(stem: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the samples sorted by stem and bytes, and how many bytes each shares with the one before (-1: another stem)."""
    w = words(side)
    order = np.lexsort((*w.T[::-1], stem))
    s = side[order]
    differs = s[1:] != s[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), SIDE) if len(order) > 1 else np.zeros(0, np.int64)
    common = np.where(stem[order[1:]] == stem[order[:-1]], common, -1)
    return order, np.concatenate([[-1], common])[: len(order)]


def ranks(order: np.ndarray, common: np.ndarray, reach: int) -> np.ndarray:
    """A number for each sample that is equal for those of one stem with the same `reach` bytes on that side."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < reach)
    return out


def earlier_strings(stem: np.ndarray, before: np.ndarray, behind: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each sample (the earliest first) the shifts whose strings an earlier sample of the stem has too."""
    back, ahead = side_ranks(stem, np.ascontiguousarray(sides[:, SIDE - 1 :: -1])), side_ranks(stem, sides[:, SIDE:])
    valid = valid_shifts(before, behind)
    out = np.zeros(len(stem), np.uint32)
    whole = (ranks(*back, SIDE) << 36) | (ranks(*ahead, SIDE) << 10) | (before.astype(np.int64) << 5) | behind  # a bucket has far less than 2**26 samples
    _, first = np.unique(whole, return_index=True)
    copy = np.ones(len(stem), bool)
    copy[first] = False
    out[copy] = valid[copy]
    lead = np.sort(first)
    for s in range(PERIOD):
        x = lead[(valid[lead] >> np.uint32(s)) & np.uint32(1) == 1]
        key = (ranks(*back, s)[x] << 32) | ranks(*ahead, SIDE - s)[x]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(x), bool)
        again[first] = False
        out[x[again]] |= np.uint32(1 << s)
    return out


def _marks(parts: DataFrame, sorting: int) -> DataFrame:
    """One bucket at a time: the marks of its samples or strings, for each group."""

    def run(t: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        strings = t["bucket"][0].as_py() >= sorting
        h, order_id, row, place, *rest = unpack_all(t, STRING if strings else SAMPLE)
        grp = np.repeat(t["grp"].to_numpy(), t["n"].to_numpy())
        age = np.lexsort((place - rest[0].astype(np.int64) if strings else place, row, order_id))
        if strings:
            _, first = np.unique(h[age], return_index=True)
            bits = np.uint32(1) << rest[0].astype(np.uint32)
            bits[age[first]] = 0
        else:
            _, kind, size = np.unique(h, return_inverse=True, return_counts=True)
            age = age[size[kind[age]] > 1]
            bits = np.zeros(len(h), np.uint32)
            if len(age):
                bits[age] = earlier_strings(kind[age], rest[0][age], rest[1][age], rest[2][age])
        hit = np.flatnonzero(bits)
        hit = hit[np.lexsort((place[hit], row[hit], grp[hit]))]
        for i, j in zip(*runs_of(grp[hit]), strict=True):
            at = hit[i:j]
            for o, x in zip(out, (-1, int(grp[at[0]]), j - i, pack(row[at], place[at], bits[at])), strict=True):
                o.append(x)
        return part_rows(*out)

    return by_bucket(parts, 2 * sorting).applyInArrow(run, PART)


def removed_runs(places: np.ndarray, bits: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes under the marked strings."""
    change = np.zeros(size + 1, np.int64)
    start = np.unique(np.concatenate([(places - s)[(bits >> np.uint32(s)) & np.uint32(1) == 1] for s in range(PERIOD)]))
    change[start] += 1
    change[start + length] -= 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cut(texts: DataFrame, notes: DataFrame, keep: list[str], length: int) -> DataFrame:
    n_keep, fields = len(keep), T._parse_datatype_string(RESULT).fields
    schema = T.StructType([*texts.schema.fields[:n_keep], *fields])
    span_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        copied = set(_copied(b).tolist())
        marks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        seen = b.filter(pa.compute.is_valid(b["blob"]))
        for n, blob in zip(seen["n"].to_pylist(), seen["blob"].to_pylist(), strict=True):
            row, place, bits = unpack(blob, n, MARK)
            order = np.argsort(row, kind="stable")
            for i, j in zip(*runs_of(row[order]), strict=True):
                at = order[i:j]
                marks.setdefault(int(row[at[0]]), []).append((place[at], bits[at]))
        removed, kept, spans = [], [], []
        dec, nothing = zstandard.ZstdDecompressor(), hashlib.sha256().hexdigest()
        for i, (row, size, sha) in enumerate(zip(a["row_no"].to_pylist(), a["n_bytes"].to_pylist(), a["sha256"].to_pylist(), strict=True)):
            if row in copied:
                found, sha = [(0, size)], nothing
            elif row in marks:
                found = removed_runs(*(np.concatenate(x) for x in zip(*marks[row], strict=True)), size, length)
                text, at, rest = dec.decompress(a["packed"][i].as_py()), 0, hashlib.sha256()
                for lo, hi in [*found, (size, size)]:
                    rest.update(text[at:lo])
                    at = hi
                sha = rest.hexdigest()
            else:
                found = []
            spans.append([{"start": lo, "end": hi} for lo, hi in found])
            removed.append(sum(hi - lo for lo, hi in found))
            kept.append(sha)
        columns = [a["n_bytes"], pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span_t)]
        return pa.table([*a.columns[:n_keep], *columns], names=schema.names)

    return texts.groupBy("grp").cogroup(notes.groupBy("grp")).applyInArrow(run, schema)


def remove_repeats(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The kept columns with n_bytes, n_removed, n_spans, kept_sha256 and spans (the maximal removed runs, in bytes).

    Texts count as UTF-8 bytes, null ones as empty. Earlier means a smaller id (null ids first, repeated ids in the order
    of their rows), or the same text and an earlier start. Strings never reach over a text's end. Whole copies lose all
    their bytes if they have `length` of them. An empty table gives no rows. A result column whose name a kept one has
    gets underscores. length is PERIOD at least.
    """
    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} at least")
    total = text_bytes(df, text_col)
    with Scratch(df.sparkSession) as scratch:
        order = {"order_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NONE))}
        texts = scratch.save(packed_texts(df, keep, text_col, order, "sha256 string", _hashes), "texts", "grp", group_count(total))
        copies = scratch.save(_later_copies(texts, length), "copies").select(F.col("row_no").alias("bucket"), "grp", F.lit(1).alias("n"), F.lit(None).cast("binary").alias("blob"))
        left = texts.select("grp", "row_no", "order_id", "n_bytes", "packed")
        counting = max(1, math.ceil(total * len(COVER) / PERIOD / COUNTED))
        seen = scratch.save(_repeated(_stems(left, copies, length, counting), hot, counting), "repeated")
        n_repeated = seen.agg(F.sum("n")).first()[0] or 0
        sorting = max(1, math.ceil(n_repeated / SORTED))
        parts = scratch.save(_samples(left, seen.filter("n > 0").unionByName(copies), length, counting, sorting), "samples")
        marks = scratch.save(_marks(parts.filter("bucket >= 0"), sorting), "marks").unionByName(parts.filter("bucket < 0"))
        done = materialize(_cut(texts, marks.unionByName(copies), kept_names(keep), length), "repeats")
    return restored(done, keep, [x.split()[0] for x in RESULT.split(", ")])

"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimate, exact verification.

A node is a distinct set of shingles; documents with equal sets share it. A node's hashes fall into 512 buckets; a
register keeps the leading zeros and the first mantissa bits of the smallest hash in its bucket. Bands of registers
give candidate pairs. Within a band's bucket nodes are first compared with one representative; then only nodes that
are still in different components are compared with each other, so that a large group of copies stays linear and no
link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACED, Scratch, gram_hash, kept_columns, kept_names, materialize, mix64, prefix_hash, restored, span_hash, text_slices, word_spans
from .graph import connected_components

BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
#: bits of a register: leading zeros and mantissa
ZEROS, MANTISSA = 4, 4
EMPTY = 0xFF
#: chance, at most, that a pair at the threshold shares no band
MISS = 1e-7
#: the estimate may fall short of the threshold by so many standard errors
ERRORS = 6.0
#: band buckets up to this size are compared by a join, larger ones in blocks of about 2 BLOCK nodes
SMALL, BLOCK = 8, 1500
#: rounds with further representatives, as long as more pairs than this a node are left
ROUNDS, PAIRS_A_NODE = 4, 500

_ODD = mix64(np.arange(1, BUCKETS + 1, dtype=np.uint64)) | np.uint64(1)
SIGNATURE = "set_key binary, n_shingles bigint, registers binary, bands array<bigint>, packed binary"


def band_plan(threshold: float) -> tuple[int, int]:
    """(registers a band, bands): the widest bands that miss a pair at the threshold with a chance of MISS at most."""
    for rows in range(BUCKETS, 1, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
        if rows * bands <= BUCKETS:
            return rows, bands
    return 1, BUCKETS


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in row order, index of each row's first with one more); fewer than k words make one shingle."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, SPACED)
    w = span_hash(prefix_hash(low), starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    h = gram_hash(w, k)
    whole = row[: len(h)] == row[k - 1 :][: len(h)]
    h, at = h[whole], row[: len(h)][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h = np.concatenate([h, [mix64(gram_hash(w[first[r] : first[r + 1]], n[r]) ^ np.uint64(n[r]))[0] for r in short]])
        at = np.concatenate([at, short])
    key = h ^ mix64(at.astype(np.uint64) + np.uint64(1))
    _, firsts = np.unique(key, return_index=True)
    h, at = h[firsts], at[firsts]
    order = np.argsort(at, kind="stable")
    return h[order], np.searchsorted(at[order], np.arange(len(n) + 1))


def smallest(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The smallest hash of each of the BUCKETS buckets of each set, without the bucket's bits; the largest number if empty."""
    rows = len(start) - 1
    row = np.repeat(np.arange(rows), np.diff(start))
    low = np.full(rows * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    bits = np.uint64(64 - BUCKET_BITS)
    np.minimum.at(low, row * BUCKETS + (h >> bits).astype(np.int64), h & ((np.uint64(1) << bits) - np.uint64(1)))
    return low.reshape(rows, BUCKETS)


def compressed(low: np.ndarray, mantissa: int, most_zeros: int) -> np.ndarray:
    """Leading zeros (up to most_zeros) and the bits after the first one, as one number."""
    f = np.maximum(low, np.uint64(1)).astype(np.float64).view(np.uint64)
    zeros = np.minimum(np.uint64(1023 + 63 - BUCKET_BITS) - (f >> np.uint64(52)), np.uint64(most_zeros))
    return (zeros << np.uint64(mantissa)) | ((f >> np.uint64(52 - mantissa)) & np.uint64((1 << mantissa) - 1))


def registers(low: np.ndarray) -> np.ndarray:
    """One byte a bucket; the code of an empty bucket is taken by no other."""
    reg = np.minimum(compressed(low, MANTISSA, (1 << ZEROS) - 1), np.uint64(EMPTY - 1))
    return np.where(low == np.iinfo(np.uint64).max, EMPTY, reg).astype(np.uint8)


def band_hashes(low: np.ndarray, h: np.ndarray, start: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Hash of each band of registers. For an empty bucket a register of the set's smallest hash under an order of its own stands in."""
    used = rows * bands
    empty = low[:, :used] == np.iinfo(np.uint64).max
    v = registers(low[:, :used]).astype(np.uint64)
    for r in np.flatnonzero(empty.any(axis=1) & (np.diff(start) > 0)):
        e = np.flatnonzero(empty[r])
        v[r, e] = registers((h[start[r] : start[r + 1], None] * _ODD[None, e]).min(axis=0) >> np.uint64(BUCKET_BITS))
    v = mix64(v).reshape(len(low), bands, rows)
    out = np.zeros((len(low), bands), np.uint64)
    for i in range(rows):
        out = out * np.uint64(0xD6E8FEB86659FD93) + v[:, :, i]
    return mix64(out + np.arange(bands, dtype=np.uint64))


def set_keys(h: np.ndarray, start: np.ndarray) -> list[bytes | None]:
    """16 bytes that name a set; None for an empty one."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h))])
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    both = np.stack([a[start[1:]] - a[start[:-1]], b[start[1:]] - b[start[:-1]]], axis=1).astype(">u8").tobytes()
    return [both[16 * i : 16 * i + 16] if start[i + 1] > start[i] else None for i in range(len(start) - 1)]


def signatures(df: DataFrame, kept: list[Column], ident: Column, text: Column, k: int, threshold: float) -> DataFrame:
    """The kept columns, a row number, the id, and of each text's set a key, the size, registers, bands, and the packed text."""
    rows, bands = band_plan(threshold)
    n_keep = len(kept) + 2
    src = df.select(*kept, F.monotonically_increasing_id().alias("row"), ident.alias("id"), text.alias("text_to_shingle"))
    schema = T.StructType([*src.schema.fields[:n_keep], *T._parse_datatype_string(SIGNATURE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column(n_keep)):
                h, start = shingle_sets(data, offs, k)
                low = smallest(h, start)
                band = band_hashes(low, h, start, rows, bands).view(np.int64)
                n = np.diff(start)
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                packed = pa.array([comp.compress(data[offs[i] : offs[i + 1]].tobytes()) if n[i] else None for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in b.columns[:n_keep]], pa.array(set_keys(h, start), pa.binary()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in registers(low)], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(band[n > 0].ravel())), packed],
                    schema.names,
                )

    return src.mapInArrow(run, schema)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the buckets that either of a pair fills."""
    union = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    share = na / nb
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * share / (1 + share) ** 2
    return np.maximum(same - chance * (1 - same / np.maximum(union, 1)), 0) / np.maximum(union, 1), union


def hopeful(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sizes and estimate allow the threshold."""
    est, union = estimate(a, b, na, nb)
    fits = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    return fits & (est >= threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1)))


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that size and estimate allow."""
    regs = nodes.select("node", "n_shingles", "registers")
    left = regs.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = regs.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                ok = hopeful(ra, rb, x.column("na").to_numpy(), x.column("nb").to_numpy(), threshold)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a bigint, b bigint")


def _unpacked(col: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dec = zstandard.ZstdDecompressor()
    for p in col.to_pylist():
        data = np.frombuffer(dec.decompress(p), np.uint8)
        yield shingle_sets(data, np.array([0, len(data)]), k)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    hundred = round(100 * threshold)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(texts.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for x in batches:
            ok = []
            for a, b, pb in zip(_unpacked(x.column("pa"), k), x.column("b").to_pylist(), x.column("pb"), strict=True):
                if last is None or last[0] != b:  # rows come sorted by b
                    last = b, next(_unpacked(pa.array([pb.as_py()]), k))[0]
                n = len(np.intersect1d(a[0], last[1], assume_unique=True))
                ok.append(100 * n >= hundred * (len(a[0]) + len(last[1]) - n))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "pa", "pb").mapInArrow(check, "a bigint, b bigint")


def _small_pairs(members: DataFrame, sizes: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components in buckets of at most SMALL nodes that size and estimate allow."""
    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    small = members.join(sizes.filter(F.col("m") <= SMALL).select("band"), "band").join(nodes.select("node", "n_shingles"), "node")
    left = small.select("band", F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("root").alias("ca"))
    right = small.select("band", F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("root").alias("cb"))
    pairs = left.join(right, "band").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b").distinct()
    return _estimated(pairs, nodes, threshold)


BLOCK_KEY = ["band", "i", "j"]
BLOCK_NODE = "band bigint, i int, j int, node bigint, root bigint, own int"


def _other_side(p: pd.DataFrame, x: int, root: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Marks the nodes of a block that are to be compared with node x: other components, and the other half of the block."""
    side = np.ones(len(p), bool) if p["i"].iat[0] == p["j"].iat[0] else own != own[x]
    return side & (root != root[x])


def _block_nodes(members: DataFrame, sizes: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes of larger buckets, dealt into blocks, that have a node of another component there which the estimate allows."""
    large = members.join(sizes.filter(F.col("m") > SMALL).select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "band")
    large = large.join(nodes.select("node", "n_shingles", "registers"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n_shingles", "root", "registers", "own")

    def hopeful_nodes(p: pd.DataFrame) -> pd.DataFrame:
        reg = np.frombuffer(b"".join(p["registers"]), np.uint8).reshape(-1, BUCKETS)
        n, root, own = (p[c].to_numpy() for c in ("n_shingles", "root", "own"))
        common = pd.Series(root).mode().iat[0]
        good = np.zeros(len(p), bool)
        for x in np.flatnonzero(root != common):  # every cross pair has an end outside the commonest component
            y = np.flatnonzero(_other_side(p, x, root, own) & (np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]) - 1e-9))
            y = y[hopeful(reg[x][None, :], reg[y], np.full(len(y), n[x]), n[y], threshold)]
            if len(y):
                good[x] = True
                good[y] = True
        return p.loc[good, [*BLOCK_KEY, "node", "root", "own"]]

    return dealt.groupBy(*BLOCK_KEY).applyInPandas(hopeful_nodes, BLOCK_NODE)


def _block_links(blocks: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links between components in each block, confirmed on full sets; just as many as connect what is linked there."""
    hundred = round(100 * threshold)

    def links(p: pd.DataFrame) -> pd.DataFrame:
        sets = [h for h, _ in _unpacked(pa.array(p["packed"]), k)]
        size = np.array([len(h) for h in sets])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        _, word = np.unique(np.concatenate(sets), return_inverse=True)
        root, own, node = (p[c].to_numpy() for c in ("root", "own", "node"))
        up = {int(r): int(r) for r in root}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        common = pd.Series(root).mode().iat[0]
        mark = np.zeros(int(word.max()) + 1, np.int32)
        out = []
        for x in np.flatnonzero(root != common):
            mine = word[start[x] : start[x] + size[x]]
            mark[mine] = 1
            both = np.add.reduceat(mark[word], start)
            mark[mine] = 0
            for y in np.flatnonzero(_other_side(p, x, root, own) & (100 * both >= hundred * (size[x] + size - both))):
                a, b = top(int(root[x])), top(int(root[y]))
                if a != b:
                    up[a] = b
                    out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return blocks.join(texts, "node").groupBy(*BLOCK_KEY).applyInPandas(links, "a bigint, b bigint")


def near_duplicates(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: float = 0.85) -> DataFrame:
    """The kept columns with n_shingles, component_id (smallest id of the linked documents) and kept (id equals it).

    Texts of fewer than k words are one shingle. Null and empty texts, and those without words, have no shingles and
    are linked with nothing. Rows of equal sets are linked, repeated ids and rows too; a null id is never a component's
    id unless all its ids are null, and then it is null and the rows are kept. A result column whose name a kept one has
    gets underscores. An empty table gives no rows.
    """
    with Scratch(df.sparkSession) as scratch:
        return restored(materialize(_near_duplicates(df, keep, id_col, text_col, k, threshold, scratch.save), "near-duplicates"), keep, ["n_shingles", "component_id", "kept"])


def _near_duplicates(df: DataFrame, keep: list[str], id_col: str, text_col: str, k: int, threshold: float, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    ident = F.col(f"`{id_col}`").cast("long")
    every = save(signatures(df, kept_columns(keep), ident, F.col(f"`{text_col}`").cast("string"), k, threshold), "signatures")
    nodes = every.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("id").alias("id"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n_shingles", "registers", "bands")])
    nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sig = every.select(*kept_names(keep), "id", "set_key", "n_shingles")

    def packed(need: DataFrame) -> DataFrame:
        """Of each needed node the text of one of its rows."""
        rows = nodes.select("node", "row").join(need, "node", "left_semi")
        return every.select("row", "packed").join(rows, "row").select("node", "packed")

    band = nodes.select("node", F.explode("bands").alias("band"))
    low = band.groupBy("band").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    members = save(band.join(low, "band"), "band-members")
    pairs = members.filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = save(_estimated(pairs, nodes, threshold), "pairs")
    ends = lambda p: p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node"))).distinct()
    texts = save(packed(ends(pairs)), "texts")
    links = save(_verified(pairs, texts, k, threshold), "links")
    members = members.drop("rep")
    n_nodes = nodes.count()
    comps = save(connected_components(links, save), "components")
    for turn in range(ROUNDS + 1):
        now = members.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
        per = now.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("inner"))
        sizes = save(per.withColumn("cross", (F.col("m") * F.col("m") - F.col("inner")) / 2).filter("cross > 0"), "band-sizes")
        left = sizes.agg(F.sum("cross")).first()[0] or 0
        if not left:
            break
        now = now.join(sizes.select("band"), "band", "left_semi")
        last = turn == ROUNDS or left <= PAIRS_A_NODE * n_nodes
        dealt = None
        if last:
            pairs = _small_pairs(now, sizes, nodes, threshold)
            dealt = save(_block_nodes(now, sizes, nodes, threshold), "block-nodes")
        else:  # another representative of each bucket, for nodes of other components
            rep = now.groupBy("band").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("root").alias("rb")), F.xxhash64("node", F.lit(turn))).alias("r"))
            pairs = now.join(rep, "band").filter(F.col("root") != F.col("r.rb")).select(F.col("node").alias("a"), F.col("r.b").alias("b")).distinct()
            pairs = _estimated(pairs, nodes, threshold)
        pairs = save(pairs, "pairs")
        need = ends(pairs) if dealt is None else ends(pairs).unionByName(dealt.select("node")).distinct()
        new = save(need.join(texts.select("node"), "node", "left_anti"), "new-nodes")
        if not new.isEmpty():
            texts = texts.unionByName(save(packed(new), "texts"))
        more = _verified(pairs, texts, k, threshold)
        more = save(more if dealt is None else more.unionByName(_block_links(dealt, texts, k, threshold)), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = save(connected_components(links, save), "components")
        if last:
            break

    low_id = nodes.select("node", "id").join(comps, "node").groupBy("root").agg(F.min("id").alias("component_id"))
    rooted = comps.join(low_id, "root").select("node", "component_id")
    by_set = nodes.select("node", "set_key", F.col("id").alias("lowest")).join(rooted, "node", "left").select("set_key", F.coalesce("component_id", "lowest").alias("component_id"))
    out = sig.join(by_set, "set_key", "left").withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(*kept_names(keep), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Hard negatives by one-dimensional distance keys: exact searches in annuli around pivots.

A whole-number vector x gets one more component so that all have the same length: the largest inner product with an
anchor is then the smallest distance, d^2 = M + |q|^2 - 2 q.x (M: the largest |x|^2). Every row belongs to its nearest
pivot, and rows are stored sorted by (pivot, distance to it), in blocks. A row within r of an anchor has a key within r of
the anchor's own distance to that pivot, so that a search scans key intervals, and widens them until what is left out lies
further away than what it has found. The pivots are fitted on a bounded sample; results don't depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: vectors that the pivots are fitted on (those of smallest hash), pivots, rounds of fitting
SAMPLE, PIVOTS, FITS = 4096, 16, 5
#: rows of a block, and anchors of a group that meet it
BLOCK, ANCHORS = 4096, 2048
#: groups that a pivot's (small) block bounds are dealt to
SALTS = 32
#: float64 sums are exact below this; beyond, 64-bit integers are used
EXACT = 1 << 53
#: squared lengths from this size on don't count: a hundred times a score has to fit 64 bits
LARGEST = 1 << 55
#: what rounding may do to a distance, as a share of it
SLACK = 1e-9

BLOCKS = "block bigint, pivot int, lo double, hi double, ids binary, labels binary, keys binary, x binary"
HITS = "akey bigint, slot int, id bigint, score bigint"


def whole(v: Column, scale: int) -> Column:
    return F.transform(v, lambda c: F.floor(c.cast("double") * scale))


def valid_rows(df: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, x, asked) of rows with an id, a label and a vector of finite components that 64 bits can hold when squared."""
    v, ident = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`").cast("long")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float(1 << 31)) / scale))
    rows = df.filter(ident.isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    out = rows.select(ident.alias("id"), label.cast("long").alias("label"), whole(v, scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return out.filter(norm < float(LARGEST))


def fit_pivots(x: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Means of groups of the sampled vectors: each begins at the vector furthest from those before, then some rounds of
    nearest means."""
    x = x.astype(np.float64)
    at, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < pivots and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    centres = x[at]
    for _ in range(FITS):
        own = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        centres = np.stack([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
    return centres


def augmented(x: np.ndarray, most: int) -> np.ndarray:
    """x as doubles with the component that makes its squared length `most`."""
    y = x.astype(np.float64)
    return np.column_stack([y, np.sqrt(np.maximum(most - (y**2).sum(axis=1), 0.0))])


def pivot_distances(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((y - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def inner_products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """a b' in whole numbers: float64 products where these are exact."""
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distance_of(score: np.ndarray | int, most: int, norm: np.ndarray | int) -> np.ndarray:
    """The distance at which rows have this inner product with an anchor of squared length norm."""
    return np.sqrt(np.maximum(most + np.asarray(norm, np.float64) - 2.0 * np.asarray(score, np.float64), 0.0))


def packed_block(p: pd.DataFrame, number: int, last: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
    """A block of the rows that aren't repeats; equal rows follow each other. `last`: the row before these."""
    x, ids, labels = np.stack(p["x"]).astype(np.int64), p["id"].to_numpy(np.int64), p["label"].to_numpy(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    if last is not None and last[:2] == (ids[0], labels[0]) and (last[2] == x[0]).all():
        new[0] = False
    last = (ids[-1], labels[-1], x[-1])
    if not new.any():
        return None, last
    keys = p["key"].to_numpy()[new]
    kept = x[new]
    small = np.int16 if np.abs(kept).max() < 1 << 15 else np.int64
    return pd.DataFrame({"block": [number], "pivot": p["pivot"].to_numpy()[:1], "lo": keys[:1], "hi": keys[-1:], "ids": [ids[new].tobytes()], "labels": [labels[new].tobytes()], "keys": [keys.tobytes()], "x": [kept.astype(small).tobytes()]}), last


class Index:
    """Rows of one length in blocks sorted by (pivot, distance)."""

    def __init__(self, rows: DataFrame, scratch: Scratch, dim: int, most: int, pivots: int):
        self.dim, self.most, self.scratch = dim, most, scratch
        lowest = rows.select("x").withColumn("h", F.xxhash64("x")).orderBy("h", "x").limit(SAMPLE)
        sample = np.array([r["x"] for r in lowest.select("x").collect()], np.int64).reshape(-1, dim)  # bounded by SAMPLE
        self.centres = fit_pivots(augmented(sample, most), pivots)
        centres = self.centres

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    d = pivot_distances(augmented(np.stack(p["x"]).astype(np.int64), most), centres)
                    own = d.argmin(axis=1)
                    yield p.assign(pivot=own.astype(np.int32), key=d[np.arange(len(d)), own])

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            number, last = TaskContext.get().partitionId() << 32, None
            held = None
            for p in batches:
                held = p if held is None or not len(held) else pd.concat([held, p], ignore_index=True)
                while held is not None and len(held):
                    run = int(np.argmax(held["pivot"].to_numpy() != held["pivot"].iat[0])) or len(held)
                    if run < BLOCK and run == len(held):
                        break  # the pivot may go on in the next batch
                    some, held = held[: min(run, BLOCK)], held[min(run, BLOCK) :].reset_index(drop=True)
                    one, last = packed_block(some, number, last)
                    if one is not None:
                        number += 1
                        yield one
            while held is not None and len(held):
                some, held = held[:BLOCK], held[BLOCK:].reset_index(drop=True)
                one, last = packed_block(some, number, last)
                if one is not None:
                    number += 1
                    yield one

        order = ["pivot", "key", "id", "label", "x"]
        dealt = rows.mapInPandas(keyed, "id bigint, label bigint, x array<bigint>, pivot int, key double")
        dealt = scratch.save(dealt, "keys")  # ranges are sampled: the keys are computed once
        self.blocks = scratch.save(dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(packed, BLOCKS), "blocks")

    def scan(self, asks: DataFrame, top: int) -> DataFrame:
        """The best rows (akey, slot, id, score) of asks in what they haven't scanned, `top` for each slot and block.

        asks: akey, id, label, x, group (of anchors that are searched together), r_old, r_new, same (whether rows of the
        same label are sought), and low and high (arrays by slot: bounds of the score, both included).
        """
        centres, most, dim = self.centres, self.most, self.dim

        def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    d = pivot_distances(augmented_anchor(np.stack(p["x"]).astype(np.int64)), centres)
                    k = d.shape[1]
                    wide = p["r_new"].to_numpy() * (1 + SLACK) + 4 * SLACK * math.sqrt(most)
                    low = (d - wide[:, None]).ravel()
                    high = (d + wide[:, None]).ravel()
                    yield pd.DataFrame({"akey": np.repeat(p["akey"].to_numpy(), k), "group": np.repeat(p["group"].to_numpy(), k), "pivot": np.tile(np.arange(k, dtype=np.int32), len(p)), "from_key": low, "to_key": high, "salt": np.repeat(p["akey"].to_numpy() % SALTS, k)})

        ranges = asks.select("akey", "group", "x", "r_new").mapInPandas(wanted, "akey bigint, group bigint, pivot int, from_key double, to_key double, salt bigint")
        bounds = self.blocks.select("block", "pivot", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        pairs = ranges.join(bounds, ["pivot", "salt"]).filter("hi >= from_key AND lo <= to_key").select("akey", "group", "block")
        pairs = self.scratch.save(pairs, "pairs")
        sides = pairs.join(asks, ["akey", "group"])
        met = pairs.select("block", F.col("group").alias("met")).distinct()
        shelf = self.blocks.join(met, "block").withColumnRenamed("block", "of")

        def best(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"akey": [], "slot": [], "id": [], "score": []}).astype({"akey": np.int64, "slot": np.int32, "id": np.int64, "score": np.int64})
            return scan_block(b.iloc[0], a, centres, most, dim, top)

        return shelf.groupBy("of", "met").cogroup(sides.groupBy("block", "group")).applyInPandas(best, HITS)


def augmented_anchor(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x.astype(np.float64), np.zeros(len(x))])


def scan_block(b: pd.Series, a: pd.DataFrame, centres: np.ndarray, most: int, dim: int, top: int) -> pd.DataFrame:
    """The best `top` rows of a block for each slot of the anchors, within the key intervals that are new to them."""
    ids, labels, keys = (np.frombuffer(b[c], t) for c, t in (("ids", np.int64), ("labels", np.int64), ("keys", np.float64)))
    x = np.frombuffer(b["x"], np.int16 if len(b["x"]) == 2 * dim * len(ids) else np.int64).reshape(-1, dim).astype(np.int64)
    q = np.stack(a["x"]).astype(np.int64)
    at = np.sqrt(((augmented_anchor(q) - centres[b["pivot"]]) ** 2).sum(axis=1))
    slack = SLACK * (at + math.sqrt(most))
    old, new = a["r_old"].to_numpy(), a["r_new"].to_numpy() + slack
    i, j = np.searchsorted(keys, at - new), np.searchsorted(keys, at + new, side="right")
    # the keys within the old radius were scanned before (by the same rounding, so that none is seen twice or never)
    before = old + slack
    oi, oj = np.searchsorted(keys, at - before), np.searchsorted(keys, at + before, side="right")
    oj = np.where(old < 0, oi, oj)
    out = []
    for lo in range(0, len(a), 256):
        part = a.iloc[lo : lo + 256]
        scores = inner_products(q[lo : lo + 256], x, most)
        for r, (akey, own, label, same, low, high) in enumerate(zip(part["akey"], part["id"], part["label"], part["same"], part["low"], part["high"], strict=True)):
            k = lo + r
            spans = [np.arange(i[k], j[k])] if oj[k] <= oi[k] else [np.arange(i[k], max(i[k], oi[k])), np.arange(min(j[k], oj[k]), j[k])]
            rows = np.concatenate(spans)
            rows = rows[((labels[rows] == label) == bool(same)) & (ids[rows] != own)]
            s = scores[r, rows]
            for slot, (least, largest) in enumerate(zip(low, high, strict=True)):
                fit = np.flatnonzero((s >= least) & (s <= largest))
                if len(fit) > top:
                    edge = np.partition(s[fit], len(fit) - top)[len(fit) - top]
                    fit = fit[s[fit] >= edge]
                fit = fit[np.lexsort((ids[rows[fit]], -s[fit]))][:top]
                if len(fit):
                    out.append((np.full(len(fit), akey), np.full(len(fit), slot, np.int32), ids[rows[fit]], s[fit]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return pd.DataFrame(dict(zip(["akey", "slot", "id", "score"], cols, strict=True)))


def _top(hits: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("akey", "slot", "id", "score")


def expanding_search(index: Index, asks: DataFrame, top: int) -> DataFrame:
    """(akey, slot, id, score): the first `top` rows of each slot (by score, then id), all if there are fewer.

    asks: akey, id, label, x, group, same, norm, radius (to begin with), low, high (arrays by slot). A slot is certified
    once its last found row is nearer than the radius, or its lower bound is; an anchor with an open slot goes on with the
    distance of what it has found, or twice the radius. At 2 * sqrt(M), which no distance exceeds, everything is scanned.
    """
    most, scratch = index.most, index.scratch
    longest = 2 * math.sqrt(most) * (1 + 1e-6) + 1
    open_asks = asks.withColumn("r_old", F.lit(-1.0)).withColumn("r_new", F.least(F.col("radius"), F.lit(longest)))
    found = None
    while True:
        open_asks = scratch.save(open_asks.select("akey", "id", "label", "x", "group", "same", "norm", "low", "high", "r_old", "r_new"), "asks")
        if open_asks.isEmpty():
            return found if found is not None else index.scratch.spark.createDataFrame([], HITS)
        hits = index.scan(open_asks, top)
        found = scratch.save(_top(hits if found is None else found.unionByName(hits), top), "found")
        last = found.groupBy("akey", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        slots = open_asks.filter(F.col("r_new") < longest).select("akey", "norm", "r_new", F.posexplode("low").alias("slot", "floor"))
        state = slots.join(last, ["akey", "slot"], "left")
        full = F.col("n") == top
        # a full slot needs the distance of its last row, another one that of its lower bound
        need = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(most)) + F.col("norm") - 2.0 * F.when(full, F.col("least")).otherwise(F.col("floor")).cast("double")))
        need = need * (1 + 2 * SLACK) + 2 * SLACK * math.sqrt(most)
        wide = F.when(full, need).otherwise(F.least(need, 2 * F.col("r_new")))
        ahead = state.filter(need > F.col("r_new")).groupBy("akey").agg(F.max(wide).alias("next"))
        open_asks = open_asks.join(ahead, "akey").withColumn("r_old", F.col("r_new")).withColumn("r_new", F.least(F.col("next"), F.lit(longest)))


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, first: float = 0.5) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component c becomes floor(scale * c); scores are inner products of these whole numbers, larger first, ties by
    smaller ids. An anchor's positives are its first rows of the same label; each gets the first rows of another label
    whose score lies between share[0] and share[1] per cent of the positive's (both included): exact, by `Index`.
    is_anchor is a condition on df, label an expression. Rows with a null id, label or vector, an empty vector, null or
    non-finite components, components from 2^31 / scale on, or squared lengths from 2^55 on take no part. Rows that repeat
    id, label and vector count once; an anchor's own id is never a partner; anchors whose id repeats with other vectors are
    searched apart. Vectors of different lengths aren't compared. An empty table gives no rows. `first` is the radius that
    searches begin with, as a share of the longest vector. Tables of a run are dropped at its end but the result.
    """
    from .common import materialize

    spark = df.sparkSession
    out = None
    with Scratch(spark) as scratch:
        rows = valid_rows(df, is_anchor, label, id_col, vector_col, scale)
        norm = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, c: a + c * c)
        sizes = [(r["d"], r["m"]) for r in rows.groupBy(F.size("x").alias("d")).agg(F.max(norm).alias("m")).collect()]
        for dim, most in sorted(sizes):
            some = rows.filter(F.size("x") == dim)
            index = Index(some.drop("asked"), scratch, dim, most, pivots)
            found = _mine(index, some.filter("asked").drop("asked"), positives, negatives, share, first * math.sqrt(max(most, 1)))
            out = found if out is None else out.unionByName(found)
        if out is None:
            return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
        return materialize(out, "hard-negatives")


def _mine(index: Index, rows: DataFrame, positives: int, negatives: int, share: tuple[int, int], radius: float) -> DataFrame:
    scratch, centres, most = index.scratch, index.centres, index.most

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x = np.stack(p["x"]).astype(np.int64)
                yield p.assign(own=pivot_distances(augmented_anchor(x), centres).argmin(axis=1).astype(np.int64), norm=(x * x).sum(axis=1).astype(np.float64))

    anchors = rows.dropDuplicates(["id", "label", "x"]).select(F.xxhash64("id", "label", "x").alias("akey"), "id", "label", "x").mapInPandas(placed, "akey bigint, id bigint, label bigint, x array<bigint>, own bigint, norm double")
    anchors = scratch.save(anchors, "anchors")
    # anchors of one pivot are searched together, as they need the same blocks, so many at a time
    most_of_one = anchors.groupBy("own").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most_of_one // ANCHORS))
    anchors = anchors.withColumn("group", F.col("own") * parts + F.pmod(F.xxhash64("akey"), F.lit(parts)))
    free = lambda v: F.array(F.lit(v).cast("bigint"))
    first = anchors.withColumns({"same": F.lit(True), "radius": F.lit(radius), "low": free(-LARGEST), "high": free(LARGEST)})
    near = expanding_search(index, first, positives)
    w = Window.partitionBy("akey").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("slot", F.row_number().over(w) - 1)
    # rounded up and down in whole numbers
    low, high = F.expr(f"-((-score * {share[0]}) div 100) + if((-score * {share[0]}) % 100 < 0, 1, 0)"), F.expr(f"(score * {share[1]}) div 100 - if((score * {share[1]}) % 100 < 0, 1, 0)")
    windows = scratch.save(ranked.select("akey", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")).filter("low <= high"), "windows")
    # slots without a window (negative scores) get one that nothing meets
    gathered = windows.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"), F.min("positive_score").alias("weakest"))
    begin = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(most)) + F.col("norm") - 1.6 * F.col("weakest")))
    second = anchors.join(gathered, "akey").withColumns({"same": F.lit(False), "radius": begin, "low": F.col("w.low"), "high": F.col("w.high")})
    found = expanding_search(index, second, negatives)
    order = Window.partitionBy("akey").orderBy("slot")
    numbered = windows.withColumn("slot", (F.row_number().over(order) - 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("akey", "slot").orderBy(F.desc("score"), "id"))
    named = found.withColumn("rank", rank).join(numbered, ["akey", "slot"]).join(anchors.select("akey", F.col("id").alias("anchor_id")), "akey")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

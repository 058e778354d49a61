"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are scaled and given one more component so that the largest inner product is the smallest distance. Each table
hashes a vector to floor((a.x + b) / W) for several random a. A query visits its own bucket and those around it that are
likeliest by their estimated success (squared distances to the cell walls). Equal vectors form one class and are searched
once. A bucket meets all queries that visit it at once, in products of matrices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, runs_of

TABLES, FUNCTIONS, WIDTH, PROBES = 4, 8, 2.0, 420
#: index entries of a block, and blocks at least
BLOCK, LEAST_BLOCKS = 65536, 64
#: blocks take so many queries at a time
QUERY_RUN = 65536
#: entries and scores of a product at most
ROWS, TILE = 2048, 1 << 20
#: hits that a block gathers before all but each query's nearest are dropped, and hits that are merged at a time
HELD, MERGED = 1 << 20, 1 << 20
#: queries whose probes are named at a time
PROBED = 512
HITS = "qk bigint, qlo bigint, k array<bigint>, lo array<bigint>, score array<double>"


@dataclass(frozen=True)
class Hashing:
    dim: int
    scale: float
    tables: int = TABLES
    functions: int = FUNCTIONS
    width: float = WIDTH
    seed: int = 11

    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, self.dim])
        return rng.normal(size=(self.dim + 1, self.tables * self.functions)), rng.uniform(0, self.width, self.tables * self.functions)

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(row, table, function): the place in units of the width."""
        norm = np.linalg.norm(x, axis=1)
        y = x / (norm[:, None] if query else self.scale)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (norm / self.scale) ** 2))
        a, b = self.planes()
        return ((np.column_stack([y, rest]) @ a + b) / self.width).reshape(len(x), self.tables, self.functions)


def bucket_keys(cells: np.ndarray, table: int) -> np.ndarray:
    """64-bit names of a table's cells (last axis: functions)."""
    h = np.full(cells.shape[:-1], table + 1, np.uint64)
    for i in range(cells.shape[-1]):
        h = mix64(h ^ cells[..., i].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def probe_keys(places: np.ndarray, table: int, probes: int) -> np.ndarray:
    """(row, probe): names of each place's cell and its neighbours (one step along some functions), the likeliest ones."""
    names, cost = np.full((len(places), 1), table + 1, np.uint64), np.zeros((len(places), 1))
    for place in places.T:
        cell = np.floor(place)
        f, cell = (place - cell)[:, None], cell.astype(np.int64)[:, None]
        names = np.concatenate([mix64(names ^ (cell + step).view(np.uint64)) for step in (0, -1, 1)], axis=1)
        cost = np.concatenate([cost, cost + f**2, cost + (1 - f) ** 2], axis=1)
        if names.shape[1] > probes:
            # costs add up, so the likeliest cells begin with the likeliest beginnings
            best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            names, cost = np.take_along_axis(names, best, axis=1), np.take_along_axis(cost, best, axis=1)
    return names.view(np.int64)


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(row, component) of lists of one length without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The values as lists that begin at `first`."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), pa.array(values))


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    """True where all columns repeat what stands before."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def nearest_entries(x: np.ndarray, turn: np.ndarray, q: np.ndarray, meetings: list[tuple[int, int, np.ndarray]], want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the `want` nearest entries to each query, by query, nearest first, ties to the smaller turn.

    A meeting is (first entry, end, queries); entries of one turn are the same, lie in different meetings and count once.
    A product turns down what lies below the worst score a query still holds, less all that rounding can change; the rest
    is scored component by component.
    """
    slack = 16 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    floor = np.full(len(q), -np.inf)
    best, fresh, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, what = (np.concatenate([f[c] for f in fresh] or [np.zeros(0, np.int64)]) for c in (0, 1))
        score = [(x[what[i : i + ROWS]] * q[who[i : i + ROWS]]).sum(axis=1) for i in range(0, len(who), ROWS)]
        who, what, score = (np.concatenate([a, *b]) for a, b in zip(best, ([who], [what], score), strict=True))
        order = np.lexsort((turn[what], -score, who))
        order = order[~same_as_before(who[order], turn[what[order]])]
        who, what, score = who[order], what[order], score[order]
        first, end = runs_of(who)
        at = np.arange(len(who)) - np.repeat(first, end - first)
        last = at == want - 1
        floor[who[last]] = score[last] - slack[who[last]]
        return who[at < want], what[at < want], score[at < want]

    for i, j, queries in sorted(meetings, key=lambda m: m[0] - m[1]):
        step = max(1, TILE // min(ROWS, j - i))
        for s in range(0, len(queries), step):
            some = queries[s : s + step]
            asked = q[some]
            for a in range(i, j, ROWS):
                rough = asked @ x[a : min(a + ROWS, j)].T
                cold = np.flatnonzero(np.isneginf(floor[some]))
                if len(cold) and rough.shape[1] > want:
                    floor[some[cold]] = np.partition(rough[cold], -want, axis=1)[:, -want] - slack[some[cold]]
                w, e = np.divmod(np.flatnonzero(rough >= floor[some][:, None]), rough.shape[1])
                fresh.append((some[w], e + a))
                waiting += len(w)
                if waiting > HELD:
                    best, fresh, waiting = settle(), [], 0
    return settle()


def near_in_block(index: pa.Table, queries: pa.Table, want: int) -> pa.Table:
    """For each query its `want` nearest entries of the block (k, lo, v, bucket) among the buckets it names (each once)."""
    kinds = {"qk": pa.int64(), "qlo": pa.int64(), "k": pa.list_(pa.int64()), "lo": pa.list_(pa.int64()), "score": pa.list_(pa.float64())}
    if not index.num_rows or not queries.num_rows:
        return pa.schema(kinds).empty_table()
    bucket, k, lo = (index[c].to_numpy() for c in ("bucket", "k", "lo"))
    order = np.lexsort((k, lo, bucket))
    order = order[~same_as_before(bucket[order], k[order], lo[order])]
    x, bucket, k, lo = vectors(index["v"])[order], bucket[order], k[order], lo[order]
    first, end = runs_of(bucket)
    held = bucket[first]
    by = np.lexsort((k, lo))
    turn = np.zeros(len(by), np.int64)
    turn[by] = np.cumsum(~same_as_before(k[by], lo[by]))
    names = queries["buckets"].combine_chunks()
    named, whose = names.flatten().to_numpy(), np.repeat(np.arange(len(names)), np.diff(names.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(held, named), len(held) - 1)
    there = held[at] == named
    at, whose = at[there], whose[there]
    by = np.argsort(at, kind="stable")
    at, whose = at[by], whose[by]
    meetings = [(int(first[at[s]]), int(end[at[s]]), whose[s:t]) for s, t in zip(*runs_of(at), strict=True)]
    who, what, score = nearest_entries(x, turn, vectors(queries["v"]), meetings, want)
    begin = runs_of(who)[0]
    asked = [queries[c].to_numpy()[who[begin]] for c in ("k", "lo")]
    return pa.Table.from_arrays([*map(pa.array, asked), lists(k[what], begin), lists(lo[what], begin), lists(score, begin)], schema=pa.schema(kinds))


def nearest_of_blocks(hits: pa.Table, want: int) -> pa.Table:
    """(qk, qlo, k, lo, score): each query's `want` nearest entries of all blocks, each once."""
    row = np.repeat(np.arange(hits.num_rows), np.diff(hits["k"].combine_chunks().offsets.to_numpy()))
    qk, qlo = (hits[c].to_numpy()[row] for c in ("qk", "qlo"))
    k, lo, score = (hits[c].combine_chunks().flatten().to_numpy() for c in ("k", "lo", "score"))
    order = np.lexsort((k, lo, -score, qlo, qk))
    order = order[~same_as_before(*(c[order] for c in (qk, qlo, k, lo)))]
    first = np.flatnonzero(~same_as_before(qk[order], qlo[order]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    keep = order[rank < want]
    return pa.table({"qk": qk[keep], "qlo": qlo[keep], "k": k[keep], "lo": lo[keep], "score": score[keep]})


def valid_vector(v: Column) -> Column:
    """Not null, with finite components only, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def vector_classes(df: DataFrame, id_col: str, vector_col: str, keep_ids: int) -> DataFrame:
    """(k, lo, v, ids) for each distinct vector: a hash, its smallest id, the keep_ids smallest ids."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") + 0.0).alias("v"))
    rows = rows.filter(F.col("id").isNotNull()).filter(valid_vector(F.col("v")))
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep_ids)
    # copies meet first in parts, so that one common vector's ids are never gathered in one place
    part = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part")).agg(least(F.collect_list("id")).alias("ids"))
    return part.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.xxhash64("v").alias("k"), F.element_at("ids", 1).alias("lo"), "v", "ids")


def nearest(df: DataFrame, is_query: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query row: its nearest other rows by inner product, ties to smaller ids.

    is_query is a condition on id_col. Rows with a null id, or a vector that is null, empty, zero or holds null or
    non-finite components, take no part. Rows that repeat id and vector count once. Vectors of different lengths aren't
    compared. Every valid row is indexed; a query for which the buckets hold too few rows is searched exactly. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    classes = materialize(vector_classes(df, id_col, vector_col, top + 1), "vectors")
    dims = [(r["d"], r["n"], r["ids"], r["s"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("s")).collect()]
    ident = F.col(f"`{id_col}`").cast("long")
    asked = df.filter(is_query & ident.isNotNull()).select(ident.alias("query_id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") + 0.0).alias("v")).filter(valid_vector(F.col("v")))
    asked = asked.select("query_id", F.xxhash64("v").alias("k"), F.size("v").alias("dim")).distinct()
    query_classes = materialize(classes.join(asked.select("k").distinct(), "k", "left_semi"), "query-vectors")
    found = None
    for dim, n, _, scale in sorted(dims):
        hashing = Hashing(dim, float(scale), tables, functions, width)
        one = _search(classes.filter(F.size("v") == dim), query_classes.filter(F.size("v") == dim), hashing, n, probes, top)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = materialize(found, "neighbours")
    # (score, id) of the nearest ids of each query class, one more than asked for: a query's own id is left out
    own = F.transform("all", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id")))
    per = asked.join(found.withColumnRenamed("qk", "k"), "k").withColumn("near", F.slice(F.filter(own, lambda x: x["id"] != F.col("query_id")), 1, top))
    return per.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _meet(shelf: DataFrame, asked: DataFrame, index: DataFrame, groups: int, queries: int, top: int) -> DataFrame:
    """(qk, all): the top + 1 nearest (score, id) of each query class, from blocks of entries and the queries sent there."""
    want, keys = top + 1, ["block", "part", "run"]

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        return near_in_block(a, b, want)

    def merge(hits: pa.Table) -> pa.Table:
        return nearest_of_blocks(hits, want)

    hits = shelf.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(near, HITS)
    merges = max(LEAST_BLOCKS, math.ceil(groups * queries * want / MERGED))
    few = hits.groupBy(F.pmod("qk", F.lit(merges)).alias("merge")).applyInArrow(merge, "qk bigint, qlo bigint, k bigint, lo bigint, score double")
    copies = index.filter(F.size("ids") > 1).select("k", "lo", "ids")
    ids = few.join(copies, ["k", "lo"], "left").select("qk", "score", F.explode(F.coalesce("ids", F.array("lo"))).alias("id"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), F.col("id"), F.col("score"))))
    return ids.groupBy("qk").agg(F.slice(order, 1, want).alias("all"))


def _runs(shelf: DataFrame, asked: DataFrame, queries: int) -> tuple[DataFrame, DataFrame]:
    """Both with a column run: queries are dealt to runs, entries go to each."""
    runs = max(1, math.ceil(queries / QUERY_RUN))
    each = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    return shelf.withColumn("run", each), asked.withColumn("run", F.pmod(F.xxhash64("k"), F.lit(runs)).cast("int"))


def _search(index: DataFrame, queries: DataFrame, hashing: Hashing, n: int, probes: int, top: int) -> DataFrame:
    tables, m = hashing.tables, queries.count()
    blocks = max(LEAST_BLOCKS, math.ceil(tables * n / BLOCK))

    def block_of(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) % np.uint64(blocks)).astype(np.int64)

    def keys_of(p: pa.RecordBatch) -> list[np.ndarray]:
        cells = np.floor(hashing.places(vectors(p["v"]), False))
        return [bucket_keys(cells[:, t], t) for t in range(tables)]

    def count(batches):
        for p in batches:
            if p.num_rows:
                block, rows = np.unique(block_of(np.concatenate(keys_of(p))), return_counts=True)
                yield pa.RecordBatch.from_pydict({"block": block, "rows": rows})

    def place(batches):
        for p in batches:
            if p.num_rows:
                for keys in keys_of(p):
                    yield pa.RecordBatch.from_arrays([*p.columns, pa.array(keys), pa.array(block_of(keys))], [*p.schema.names, "bucket", "block"])

    def probe(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PROBED):
                p = whole.slice(at, PROBED)
                spots = hashing.places(vectors(p["v"]), True)
                # buckets of two tables can have one name: a query names it once
                keys = np.sort(np.concatenate([probe_keys(spots[:, t], t, probes) for t in range(tables)], axis=1), axis=1)
                row = np.repeat(np.arange(len(keys)), keys.shape[1])
                once = ~same_as_before(row, keys.reshape(-1))
                keys, row = keys.reshape(-1)[once], row[once]
                visit = row * blocks + block_of(keys)
                order = np.argsort(visit, kind="stable")
                first, _ = runs_of(visit[order])
                row, block = np.divmod(visit[order][first], blocks)
                yield pa.RecordBatch.from_arrays([*p.take(pa.array(row)).columns, pa.array(block), lists(keys[order], first)], [*p.schema.names, "block", "buckets"])

    entries = index.select("k", "lo", "v")
    shelf = entries.mapInArrow(place, "k bigint, lo bigint, v array<double>, bucket bigint, block bigint")
    asked = queries.select("k", "lo", "v").mapInArrow(probe, "k bigint, lo bigint, v array<double>, block bigint, buckets array<bigint>")
    # a hot bucket fills its block far beyond the share: its entries are dealt to parts, and its queries go to each part
    full = entries.mapInArrow(count, "block bigint, rows bigint").groupBy("block").agg(F.sum("rows").alias("rows"))
    full = materialize(full.filter(F.col("rows") > 2 * BLOCK).select("block", F.ceil(F.col("rows") / BLOCK).alias("parts")), "full-blocks")
    shelf = shelf.join(full, "block", "left").withColumn("part", F.pmod(F.xxhash64("k"), F.coalesce("parts", F.lit(1)))).drop("parts")
    asked = asked.join(full, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    got = materialize(_meet(*_runs(shelf, asked, m), index, blocks, m, top), "neighbours")
    total = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    short = queries.join(got.filter(F.size("all") >= min(top + 1, total)).select(F.col("qk").alias("k")), "k", "left_anti")
    short = materialize(short, "short-queries")
    if short.isEmpty():
        return got
    return got.join(short.select(F.col("k").alias("qk")), "qk", "left_anti").unionByName(exact_nearest(index, short, top))


def exact_nearest(index: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Compares the queries with all vectors, runs of queries with blocks of vectors; the same result as _search gives."""
    n, m = index.count(), queries.count()
    blocks, whole = max(LEAST_BLOCKS, math.ceil(n / BLOCK)), F.lit(0).cast("bigint")
    shelf = index.select("k", "lo", "v", whole.alias("bucket"), F.pmod("k", F.lit(blocks)).alias("block"), whole.alias("part"))
    asked = queries.select("k", "lo", "v", F.array(whole).alias("buckets"), whole.alias("part"))
    asked = asked.withColumn("block", F.explode(F.sequence(whole, F.lit(blocks - 1).cast("bigint"))))
    return _meet(*_runs(shelf, asked, m), index, blocks, m, top)

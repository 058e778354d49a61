"""Chunk stores: arrays kept as rows of (address, compressed bytes), read at points.

An array is cut into square chunks of its last two axes; a chunk's address is that of its array and hour with the chunk's
place. The address of a point follows from arithmetic alone, so that only the few chunks that points lie in are read; each
is decoded once, whatever the number of points in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

STORE = "address string, codec string, dtype string, leads int, size int, data binary"
#: addresses that are named in a filter of the store (their bounds are pushed down); more are joined alone
NAMED = 1000
#: bytes of a row group of the store, so that statistics of addresses rule out most of a file
GROUP_BYTES = 4 << 20
CODECS = ("zstd", "zlib", "raw")


@dataclass(frozen=True)
class ChunkGrid:
    """Centres x0 + i * dx and y0 + i * dy of a grid (in the projection's plane, or degrees), in chunks of size * size."""

    x0: float
    dx: float
    nx: int
    y0: float
    dy: float
    ny: int
    size: int = 150
    projection: geo.Lambert | None = None

    def index(self, lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
        """(row, column) of the nearest centre, the later one of two; places outside belong to the nearest edge."""
        if self.projection is None:
            x, y = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
        else:
            x, y = self.projection.forward(lat, lon)
        near = lambda v, v0, step, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - v0) / step + 0.5))).cast("int")
        # greatest and least pass over nulls: a place without a number has no cell
        guarded = lambda v, i: F.when(v.isNotNull() & ~F.isnan(v), i)
        return guarded(y, near(y, self.y0, self.dy, self.ny)), guarded(x, near(x, self.x0, self.dx, self.nx))

    def chunk(self, row: Column, column: Column) -> Column:
        """'row.column' of the chunk that holds a cell."""
        part = lambda i: F.floor(i / self.size).cast("string")
        return F.concat(part(row), F.lit("."), part(column))

    def cell(self, row: Column, column: Column) -> Column:
        """The place of a cell in its chunk."""
        return ((row % self.size) * self.size + column % self.size).cast("int")


def encoded(values: np.ndarray, codec: str) -> bytes:
    raw = values.tobytes()
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=3).compress(raw)
    return zlib.compress(raw) if codec == "zlib" else raw


def decoded(data: bytes, codec: str, dtype: str, leads: int, size: int) -> np.ndarray:
    """(leads, size * size) numbers of a chunk."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}; known: {CODECS}")
    raw = zstandard.ZstdDecompressor().decompress(data) if codec == "zstd" else zlib.decompress(data) if codec == "zlib" else data
    out = np.frombuffer(raw, dtype)
    if len(out) != leads * size * size:
        raise ValueError(f"a chunk holds {len(out)} numbers instead of {leads} * {size} * {size}")
    return out.reshape(leads, size * size)


def to_chunks(cells: DataFrame, grid: ChunkGrid, address: Column, value: str = "value", row: str = "iy", column: str = "ix", lead: str | None = None, leads: int = 1, dtype: str = "<f4", codec: str = "zstd") -> DataFrame:
    """The store's rows from a table of cells. address: an expression that uses `_chunk` for the chunk's place.

    Absent cells, cells at a chunk's rim beyond the grid, and nulls are NaN; of cells that repeat the largest counts.
    A task puts together one chunk at a time, of leads * size * size numbers.
    """
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}; known: {CODECS}")
    placed = cells.withColumn("_chunk", grid.chunk(F.col(row), F.col(column)))
    step = F.col(lead) if lead else F.lit(0)
    some = placed.select(address.alias("address"), (step * grid.size**2 + grid.cell(F.col(row), F.col(column))).cast("int").alias("cell"), F.col(value).cast("double").alias("value"))

    def build(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("value", na_position="first")
        out = np.full(leads * grid.size**2, np.nan, dtype)
        out[p["cell"].to_numpy()] = p["value"].to_numpy(float)
        return pd.DataFrame({"address": p["address"].iloc[:1], "codec": codec, "dtype": dtype, "leads": leads, "size": grid.size, "data": [encoded(out, codec)]})

    return some.filter("address IS NOT NULL").groupBy("address").applyInPandas(build, STORE)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The store as Parquet in ranges of addresses."""
    chunks.repartitionByRange("address").sortWithinPartitions("address").write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def read_points(store: DataFrame, points: DataFrame, grid: ChunkGrid, address: Column, lat: str = "lat", lon: str = "lon", into: str = "values") -> DataFrame:
    """points with an array of the nearest cell's values (one a lead time; null where a chunk or a number is missing).

    address: an expression over the points' columns and `_chunk`. All points stay, also those without a place. Each cell
    is asked for once, however many points lie in it. Finding the addresses is a job that runs when this is called: up to
    NAMED of them are named in a filter.
    """
    row, column = grid.index(lat, lon)
    placed = points.withColumn("_row", row).withColumn("_column", column).withColumn("_chunk", grid.chunk(F.col("_row"), F.col("_column")))
    placed = placed.withColumn("_address", address).withColumn("_cell", grid.cell(F.col("_row"), F.col("_column")))
    # at most size * size cells a chunk: the arrays are bounded
    cells = placed.filter("_address IS NOT NULL AND _cell IS NOT NULL").select(F.col("_address").alias("address"), F.col("_cell").alias("cell")).distinct()
    wanted = cells.groupBy("address").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    named = [r["address"] for r in wanted.select("address").limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        store = store.filter(F.col("address").isin(named)) if named else store.filter("false")
        if named:
            store = store.filter(F.col("address").between(min(named), max(named)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = np.array(r["cells"], np.int64)
                got = decoded(r["data"], r["codec"], r["dtype"], r["leads"], r["size"])[:, at].T.astype(np.float64)
                values = pa.array(got.ravel(), from_pandas=True)
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * r["leads"])
                yield pa.RecordBatch.from_arrays([pa.array([r["address"]] * len(at)), pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(offsets, values)], ["_address", "_cell", "_values"])

    met = store.join(wanted, "address").select("address", "codec", "dtype", "leads", "size", "data", "cells")
    found = met.mapInArrow(decode, "_address string, _cell int, _values array<double>")
    return placed.join(found, ["_address", "_cell"], "left").select(*points.columns, F.col("_values").alias(into))

"""Conservative regridding of projected cells: their outlines, turned back to latitudes and longitudes, against cells.

Outlines are polygons in the plane of longitude and sine of latitude, where areas are those on the sphere, and where cells
of latitude and longitude are rectangles. Neighbouring outlines share their corners, so that nothing is lost or counted
twice. The weights depend on the cells' places alone: they are one sparse table, used for all times and sectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .grid import decimals

#: pairs of an outline and a cell that are clipped at once
PAIRS = 1 << 17
WEIGHTS = "x double, y double, lat_index bigint, lon_index bigint, area double"


def clipped_areas(corners: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Areas of convex polygons (n, k, 2) within rectangles from low to high (n, 2 each): cut at one side after the other."""
    p = corners
    for axis in (0, 1):
        for edge, sign in ((low[:, axis], 1.0), (high[:, axis], -1.0)):
            d = sign * (p[:, :, axis] - edge[:, None])
            q, e = np.roll(p, -1, axis=1), np.roll(d, -1, axis=1)
            inside, crossing = d >= 0, (d >= 0) != (e >= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(crossing, d / (d - e), 0.0)
            met = p + t[:, :, None] * (q - p)
            met[:, :, axis] = np.where(crossing, edge[:, None], met[:, :, axis])
            both = np.stack([p, met], axis=2).reshape(len(p), -1, 2)
            real = np.stack([inside, crossing], axis=2).reshape(len(p), -1)
            order = np.argsort(~real, axis=1, kind="stable")[:, : p.shape[1] + 1]
            out = np.take_along_axis(both, order[:, :, None], axis=1)
            # what is left over repeats the first corner, which adds no area
            p = np.where(np.take_along_axis(real, order, axis=1)[:, :, None], out, out[:, :1])
            p[~real.any(axis=1)] = 0.0
    return polygon_areas(p)


def polygon_areas(p: np.ndarray) -> np.ndarray:
    o = p - p[:, :1]  # areas of small outlines far from the origin keep their places
    q = np.roll(o, -1, axis=1)
    return np.abs((o[:, :, 0] * q[:, :, 1] - q[:, :, 0] * o[:, :, 1]).sum(axis=1)) / 2


def outlines(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """(n, 4, 2) corners as longitude (within half a turn of the first) and sine of latitude."""
    first = lon[:, :1]
    return np.stack([first + (lon - first + 180.0) % 360.0 - 180.0, np.sin(np.radians(lat))], axis=2)


def overlap_weights(cells: DataFrame, p: geo.Lambert, dx: float, dy: float, resolution: float) -> DataFrame:
    """(x, y, lat_index, lon_index, area) for each projected cell and each cell of the resolution that it overlaps.

    Areas are degrees of longitude times sine of latitude. Cells must not hold a pole.
    """
    at = cells.select(F.col("x").cast("double"), F.col("y").cast("double")).filter("x IS NOT NULL AND y IS NOT NULL").distinct()
    for n, (i, j) in enumerate(((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))):
        lat, lon = p.inverse(F.col("x") + i * dx, F.col("y") + j * dy)
        at = at.withColumn(f"lat{n}", lat).withColumn(f"lon{n}", lon)

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lon, lat = (b[[f"{c}{n}" for n in range(4)]].to_numpy() for c in ("lon", "lat"))
            shape = outlines(lon, lat)
            i0, i1 = (np.floor(f(shape[:, :, 0], axis=1) / resolution).astype(np.int64) for f in (np.min, np.max))
            j0, j1 = (np.floor(f(lat, axis=1) / resolution).astype(np.int64) for f in (np.min, np.max))
            many = (i1 - i0 + 1) * (j1 - j0 + 1)
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(many[lo:]), PAIRS)) + lo)
                own = np.repeat(np.arange(lo, hi), many[lo:hi])
                k = np.arange(len(own)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
                i, j = i0[own] + k % (i1 - i0 + 1)[own], j0[own] + k // (i1 - i0 + 1)[own]
                sine = lambda v: np.sin(np.radians(np.clip(v * resolution, -90.0, 90.0)))
                low, high = np.stack([i * resolution, sine(j)], axis=1), np.stack([(i + 1) * resolution, sine(j + 1)], axis=1)
                area = clipped_areas(shape[own], low, high)
                some = area > 0
                yield pd.DataFrame({"x": b["x"].to_numpy()[own], "y": b["y"].to_numpy()[own], "lat_index": j, "lon_index": i, "area": area})[some]
                lo = hi

    return at.mapInPandas(clip, WEIGHTS)


def reproject_conservative(df: DataFrame, p: geo.Lambert, dx: float, dy: float, resolution: float, coords: Sequence[str] = ("time", "sector"), method: str = "conservative", value: str = "value", x: str = "x", y: str = "y") -> DataFrame:
    """Values on square cells of latitude and longitude: a row for each cell that a projected one (dx * dy) overlaps.

    conservative: what lies in the cell over its whole area, null where a value is null; conservative_normed: the mean over
    the part that has values. Amounts (value times area) are kept by the first. Rows that repeat a cell add up: sum them
    first if they are parts of one, else take means.
    """
    if p is None:
        raise ValueError("the table has latitudes and longitudes already")
    if method not in ("conservative", "conservative_normed"):
        raise ValueError(f"unknown method {method}")
    src = df.select(*coords, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).alias("_value"))
    each = src.join(overlap_weights(src, p, dx, dy, resolution), ["x", "y"])
    period = F.lit(round(360.0 / resolution))
    turned = F.pmod(F.col("lon_index") + F.floor(period / 2), period) - F.floor(period / 2) if abs(360.0 / resolution - round(360.0 / resolution)) < 1e-9 else F.col("lon_index")
    agg = each.groupBy(*coords, "lat_index", turned.alias("lon_index")).agg(F.sum(F.col("area") * F.col("_value")).alias("_s"), F.sum(F.when(F.col("_value").isNotNull(), F.col("area"))).alias("_w"), (F.count("_value") == F.count(F.lit(1))).alias("_all"))
    full = resolution * (F.sin(F.radians((F.col("lat_index") + 1) * resolution)) - F.sin(F.radians(F.col("lat_index") * resolution)))
    out = F.try_divide(F.col("_s"), F.col("_w")) if method == "conservative_normed" else F.when(F.col("_all"), F.col("_s") / full)
    centre = lambda c: F.round((F.col(c) + 0.5) * resolution, decimals(resolution) + 1)
    return agg.select(*coords, centre("lat_index").alias("lat"), centre("lon_index").alias("lon"), out.alias(value))

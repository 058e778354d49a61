"""Points in many polygons, with holes and several parts: squares are classed once, and only those at an edge look at edges.

A polygon is its rings (arrays of x, y structs, closed or not); the even-odd rule decides, so that inner rings are holes and
parts may be listed one after the other. Squares of a polygon lie wholly inside, or touch an edge; others have no row.
Points meet squares by equal keys, and those in squares at an edge meet the polygon's edges of their row of squares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: squares that a polygon has along the root of its box's area, on average, if no side is given
ALONG = 16
#: squares of a batch
BATCH = 1 << 17
#: what rounding may move an edge, as a share of a square
SLACK = 1e-9


def edges_of(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, x1, y1, x2, y2) of every edge; corners with a null or non-finite number are left out of their ring."""
    good = lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")) & ~F.isnan(p["x"].cast("double")) & ~F.isnan(p["y"].cast("double"))
    one = polygons.filter(F.col(key).isNotNull()).select(F.col(key).alias("poly"), F.explode(rings).alias("ring"))
    one = one.select("poly", F.filter("ring", good).alias("ring")).filter(F.size("ring") > 2)
    turn = lambda p, i: F.struct(p["x"].cast("double").alias("x1"), p["y"].cast("double").alias("y1"), F.get("ring", (i + 1) % F.size("ring"))["x"].cast("double").alias("x2"), F.get("ring", (i + 1) % F.size("ring"))["y"].cast("double").alias("y2"))
    return one.select("poly", F.explode(F.transform("ring", turn)).alias("e")).select("poly", "e.*")


def squares_of(e: np.ndarray, side: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, inside) of a polygon's squares, from its edges (rows of x1, y1, x2, y2), some rows of squares at a time."""
    x1, y1, x2, y2 = e.T
    low, high = np.floor(np.minimum(y1, y2) / side - SLACK).astype(np.int64), np.floor(np.maximum(y1, y2) / side + SLACK).astype(np.int64)
    wide = int(np.ptp(np.concatenate([x1, x2])) / side) + 3
    step = max(1, BATCH // wide)
    for j0 in range(int(low.min()), int(high.max()) + 1, step):
        j1 = min(j0 + step, int(high.max()) + 1)
        a, b = np.maximum(low, j0), np.minimum(high, j1 - 1)
        some = np.flatnonzero(b >= a)
        own = np.repeat(some, (b - a + 1)[some])
        j = np.concatenate([np.arange(p, q + 1) for p, q in zip(a[some], b[some], strict=True)]) if len(some) else np.zeros(0, np.int64)
        # the part of each edge in each row of squares
        slope = np.divide((x2 - x1)[own], (y2 - y1)[own], out=np.zeros(len(own)), where=(y2 - y1)[own] != 0)
        at = lambda y: x1[own] + (np.clip(y, np.minimum(y1, y2)[own], np.maximum(y1, y2)[own]) - y1[own]) * slope  # noqa: E731, B023
        left, right = at(j * side), at((j + 1) * side)
        flat = (y1 == y2)[own]
        left, right = np.where(flat, x1[own], left), np.where(flat, x2[own], right)
        i0, i1 = np.floor(np.minimum(left, right) / side - SLACK).astype(np.int64), np.floor(np.maximum(left, right) / side + SLACK).astype(np.int64)
        many = i1 - i0 + 1
        bj, bi = np.repeat(j, many), np.repeat(i0, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        touched = np.unique(np.stack([bj, bi], axis=1), axis=0)
        # between every other pair of crossings with a row's middle line lies the inside
        rows = np.arange(j0, j1)
        inner = []
        for row in rows.tolist():
            y = (row + 0.5) * side
            hit = (y1 > y) != (y2 > y)
            xs = np.sort(x1[hit] + (y - y1[hit]) * (x2[hit] - x1[hit]) / (y2[hit] - y1[hit])) / side
            for p, q in zip(np.ceil(xs[0::2] - 0.5).astype(np.int64).tolist(), np.ceil(xs[1::2] - 0.5).astype(np.int64).tolist(), strict=True):
                if q > p:
                    inner.append(np.stack([np.full(q - p, row), np.arange(p, q)], axis=1))
        yield touched[:, 1], touched[:, 0], np.zeros(len(touched), bool)
        if inner:
            found = np.concatenate(inner)
            known = {tuple(t) for t in touched.tolist()}
            free = np.array([t not in known for t in map(tuple, found.tolist())], bool)
            yield found[free, 1], found[free, 0], np.ones(int(free.sum()), bool)


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, x: str = "lon", y: str = "lat", rings: str = "rings", side: float | None = None) -> DataFrame:
    """points with the key of each polygon that holds them: a row for each, none for points in no polygon.

    A point on an edge belongs to one of the two sides only (crossings to its right are counted, lower ends included).
    Points without a finite place, and polygons without a key or without a ring of three corners, have no rows; parts of
    one key in several rows are one polygon. Points are searched as distinct places. The edges of one polygon are read by
    one task. side: of the squares; without it, a job derives it from the polygons' boxes.
    """
    edges = edges_of(polygons, key, rings)
    if side is None:
        box = edges.groupBy("poly").agg((F.max("x1") - F.min("x1")).alias("w"), (F.max("y1") - F.min("y1")).alias("h"))
        area = box.agg(F.avg(F.sqrt(F.greatest(F.col("w") * F.col("h"), F.lit(1e-18)))).alias("a")).first()["a"]
        side = (area or 1.0) / ALONG
    kind = edges.schema["poly"].dataType
    schema = T.StructType([T.StructField("poly", kind), T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("inside", T.BooleanType())])

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, packed in zip(b["poly"], b["edges"], strict=True):
                e = np.array([[p["x1"], p["y1"], p["x2"], p["y2"]] for p in packed], float)
                for i, j, inside in squares_of(e, side):
                    yield pd.DataFrame({"poly": pd.Series([name] * len(i), dtype=object if isinstance(kind, T.StringType) else None), "i": i, "j": j, "inside": inside})

    gathered = edges.groupBy("poly").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    squares = gathered.mapInPandas(classed, schema)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    places = points.filter(finite(x) & finite(y)).select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct()
    square = lambda c: F.floor(F.col(c) / side).cast("bigint")
    met = places.withColumn("i", square("px")).withColumn("j", square("py")).join(squares, ["i", "j"])
    sure = met.filter("inside").select("px", "py", "poly")
    rows = F.explode(F.sequence(F.floor(F.least("y1", "y2") / side).cast("bigint"), F.floor(F.greatest("y1", "y2") / side).cast("bigint")))
    banded = edges.filter("y1 <> y2").withColumn("j", rows)
    asked = met.filter("NOT inside").select("px", "py", "poly", "j").join(banded, ["poly", "j"])
    cross = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    near = asked.groupBy("px", "py", "poly").agg(F.sum(cross.cast("int")).alias("n")).filter("n % 2 = 1").select("px", "py", "poly")
    found = sure.unionByName(near)
    at = (points[x].cast("double") == found["px"]) & (points[y].cast("double") == found["py"])
    return points.join(found, at).select(*[points[c] for c in points.columns], found["poly"].alias(key if key not in points.columns else f"{key}_"))


def clip_to_polygons(grid: DataFrame, polygons: DataFrame, key: str, x: str = "lon", y: str = "lat", rings: str = "rings", side: float | None = None) -> DataFrame:
    """Rows of grid whose centre lies in one of the polygons."""
    inside = points_in_polygons(grid.select(F.col(x).alias("cx"), F.col(y).alias("cy")).distinct(), polygons, key, "cx", "cy", rings, side).select("cx", "cy").distinct()
    return grid.join(inside, (grid[x] == inside["cx"]) & (grid[y] == inside["cy"]), "left_semi")

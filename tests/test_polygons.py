"""Points in polygons with holes, and patch regridding, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import grid, polygons

SHAPES = "name string, rings array<array<struct<x:double,y:double>>>"


def even_odd(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(cx, cy, r, n, rng):
    return [(cx + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.mark.parametrize("side", [None, 0.13, 5.0, 100.0])
def test_points_in_polygons(spark, side):
    rng = random.Random(3)
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    shapes = {"hole": [box(0, 0, 10, 10), box(3, 3, 7, 7), box(4, 4, 5, 5)], "two": [box(-5, -5, -1, -1), box(20, 20, 25, 30) + [(20, 20)]], "big": [star(5, 5, 30, 40, rng), star(5, 5, 9, 12, rng)], "bow": [[(0, 0), (10, 10), (10, 0), (0, 10)]]}
    shapes |= {f"s{k}": [star(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0.1, 4), 7, rng)] for k in range(25)}
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in v]) for k, v in shapes.items()]
    rows += [("line", [[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 9.0}]]), ("none", None), ("empty", []), (None, rows[0][1])]
    rows[0] = ("hole", [[*rows[0][1][0], {"x": None, "y": 3.0}], *rows[0][1][1:]])
    at = [(rng.uniform(-30, 35), rng.uniform(-30, 35)) for _ in range(600)] + [(float(a), float(b)) for a in range(-1, 12) for b in range(-1, 12)] + [(2.5, 2.5)] * 40
    pts = [(i, a, b) for i, (a, b) in enumerate(at)] + [(9000, None, 1.0), (9001, float("nan"), 1.0)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double").repartition(3)
    got = {(r["id"], r["name"]) for r in polygons.points_in_polygons(df, spark.createDataFrame(rows, SHAPES), "name", side=side).collect()}
    want = {(i, k) for i, x, y in pts[:-2] for k, v in shapes.items() if even_odd(x, y, v)}
    assert got == want


def test_polygons_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, "mine")], "id int, lon double, lat double, name string")
    none = spark.createDataFrame([], SHAPES)
    assert polygons.points_in_polygons(df, none, "name").count() == 0
    one = spark.createDataFrame([("a", [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]])], SHAPES)
    assert polygons.points_in_polygons(df.limit(0), one, "name").count() == 0
    assert [(r["name"], r["name_"]) for r in polygons.points_in_polygons(df, one, "name").collect()] == [("mine", "a")]
    cells = grid.regular_grid(spark, (0, 0, 3, 3), 0.5, 0.5)
    assert polygons.clip_to_polygons(cells, one, "name").count() == sum(even_odd(x, y, [[(0, 0), (1, 0), (1, 2)]]) for x in np.arange(0.25, 3, 0.5) for y in np.arange(0.25, 3, 0.5))


# ---------------------------------------------------------------- patch regridding

def centres(spark, values, col):
    return spark.createDataFrame([(float(v),) for v in values], f"{col} double").select(col, (F.col(col) - 0.1).alias("lo"), (F.col(col) + 0.1).alias("hi"))


def test_patch_reproduces_quadratic_fields(spark):
    """On uneven axes, up to the outermost centres, for several times at once."""
    ys, xs = [0.0, 1.0, 2.5, 3.0, 5.0], [-3.0, -2.0, 0.0, 0.5, 2.0, 4.0]
    f = lambda t, y, x: 2 + t * y - 0.5 * x + 0.3 * x * y + 0.25 * y * y - 0.1 * t * x * x
    src = spark.createDataFrame([(t, y, x, f(t, y, x)) for t in (1, 2) for y in ys for x in xs], "time int, lat double, lon double, value double")
    new_y, new_x = [0.0, 0.7, 2.5, 2.9, 4.9, 5.0], [-3.0, -1.1, 0.2, 3.99, 4.0]
    got = grid.regrid(src, centres(spark, [*new_y, 5.1], "lat"), centres(spark, [*new_x, -3.5], "lon"), "patch").collect()
    assert len(got) == 2 * len(new_y) * len(new_x)
    assert all(abs(r["value"] - f(r["time"], r["lat"], r["lon"])) < 1e-11 for r in got)


def test_patch_against_least_squares(spark):
    """A rough field: the four fits by a solver, blended; a null near a new centre makes it null."""
    rng = np.random.default_rng(1)
    ys, xs = np.array([0.0, 1.0, 2.5, 3.0, 5.0]), np.array([-3.0, -2.0, 0.0, 0.5, 2.0])
    v = rng.normal(size=(5, 5))
    rows = [(float(y), float(x), None if (i, j) == (4, 4) else float(v[i, j])) for i, y in enumerate(ys) for j, x in enumerate(xs)]
    got = {(r["lat"], r["lon"]): r["value"] for r in grid.regrid(spark.createDataFrame(rows, "lat double, lon double, value double"), centres(spark, [0.4, 1.8, 2.7, 4.0], "lat"), centres(spark, [-2.2, -0.7, 0.3, 1.0], "lon"), "patch", ()).collect()}
    assert len(got) == 16
    basis = lambda y, x: np.stack([np.ones_like(y), x, y, x * x, x * y, y * y], axis=-1)
    for (y, x), mine in got.items():
        i, j = np.searchsorted(ys, y) - 1, np.searchsorted(xs, x) - 1
        ty, tx = (y - ys[i]) / (ys[i + 1] - ys[i]), (x - xs[j]) / (xs[j + 1] - xs[j])
        want, missing = 0.0, False
        for a, wy in ((i, 1 - ty), (i + 1, ty)):
            for b, wx in ((j, 1 - tx), (j + 1, tx)):
                ma, mb = min(max(a, 1), 3), min(max(b, 1), 3)
                yy, xx = np.meshgrid(ys[ma - 1 : ma + 2], xs[mb - 1 : mb + 2], indexing="ij")
                missing |= ma == 3 and mb == 3
                coef, *_ = np.linalg.lstsq(basis(yy.ravel(), xx.ravel()), v[ma - 1 : ma + 2, mb - 1 : mb + 2].ravel(), rcond=None)
                want += wy * wx * float(basis(np.array(y), np.array(x)) @ coef)
        assert mine is None if missing else mine == pytest.approx(want, abs=1e-10)
    few = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 1.0)], "lat double, lon double, value double")
    assert grid.regrid(few, centres(spark, [0.5], "lat"), centres(spark, [0.0], "lon"), "patch", ()).count() == 0

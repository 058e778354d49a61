"""Chunk stores, nearest places in a plane and conservative reprojection, against brute force and odd rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.operators import grid, nearest, overlap
from aerolith.sources import chunks, inventories, names

# ---------------------------------------------------------------- chunk stores

GRID = chunks.ChunkGrid(-112.0, 0.1, 50, 38.0, 0.2, 33, size=16)


def hours(model: str = "anl"):
    return names.zarr_address(F.col("hour"), "sfc", F.lit("10m"), F.col("variable"), model, F.col("_chunk"))


def fields(spark, hour=dt.datetime(2023, 1, 1, 5)):
    rows = [(hour, v, i, j, float(1000 * k + 50 * i + j) if (i, j) != (3, 4) else None) for k, v in enumerate(("UGRD", "VGRD")) for i in range(33) for j in range(50) if i != 20]
    return spark.createDataFrame(rows, "hour timestamp_ntz, variable string, iy int, ix int, value double")


@pytest.mark.parametrize("codec", chunks.CODECS)
def test_points_of_a_chunk_store(spark, tmp_path, codec):
    path = str(tmp_path / codec)
    chunks.write_chunks(chunks.to_chunks(fields(spark), GRID, hours(), codec=codec), path)
    store = spark.read.parquet(path)
    assert store.count() == 2 * 3 * 4 and store.filter("address = 'sfc/20230101/20230101_05z_anl.zarr/10m/UGRD/10m/UGRD/2.3'").count() == 1
    at = [(-112.0, 38.0), (-111.94, 38.1), (-107.1, 44.4), (-200.0, 90.0), (-111.6, 38.6), (-110.0, 42.0), (None, 38.0), (float("nan"), 1.0), (-109.34, 40.71)]
    points = spark.createDataFrame([(n, dt.datetime(2023, 1, 1, 5), "VGRD", lon, lat) for n, (lon, lat) in enumerate(at)] + [(99, dt.datetime(2024, 1, 1), "VGRD", -112.0, 38.0)], "n int, hour timestamp_ntz, variable string, lon double, lat double")
    got = {r["n"]: r["values"] for r in chunks.read_points(store, points, GRID, hours()).collect()}
    value = lambda i, j: [float(1000 + 50 * i + j)]
    assert got == {0: value(0, 0), 1: value(1, 1), 2: value(32, 49), 3: value(32, 0), 4: [None], 5: [None], 6: None, 7: None, 8: value(14, 27), 99: None}


def test_only_the_points_chunks_are_decoded(spark, tmp_path, monkeypatch):
    """Many points of one chunk and one of another: two chunks of 24 are decoded, and the store's scan names them."""
    path = str(tmp_path / "store")
    chunks.write_chunks(chunks.to_chunks(fields(spark), GRID, hours()), path)
    seen = spark.sparkContext.accumulator(0)
    plain = chunks.decoded

    def counted(*a):
        seen.add(1)
        return plain(*a)

    monkeypatch.setattr(chunks, "decoded", counted)
    points = spark.range(2000).select("id", F.lit(dt.datetime(2023, 1, 1, 5)).cast("timestamp_ntz").alias("hour"), F.lit("UGRD").alias("variable"), F.when(F.col("id") == 7, -107.2).otherwise(-112 + F.col("id") % 15 * 0.1).alias("lon"), F.lit(38.0).alias("lat"))
    store = spark.read.parquet(path)
    out = chunks.read_points(store, points, GRID, hours())
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    assert "GreaterThanOrEqual(address," in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert out.agg(F.sum(out["values"][0])).first()[0] == sum(48 if i == 7 else i % 15 for i in range(2000)) and seen.value == 2


def test_forecasts_and_projected_grids(spark):
    """A leading axis of lead times; cells in a Lambert plane."""
    p = geo.Lambert()
    g = chunks.ChunkGrid(-3000.0, 3000.0, 3, -3000.0, 3000.0, 3, size=2, projection=p)
    rows = [("t", i, j, k, 100.0 * k + 10 * i + j) for i in range(3) for j in range(3) for k in range(2)]
    cells = spark.createDataFrame(rows, "a string, iy int, ix int, k int, value double")
    store = chunks.to_chunks(cells, g, F.concat("a", F.lit("/0."), "_chunk"), lead="k", leads=2, dtype="<f2", codec="zlib")
    lat, lon = p.inverse(F.col("x"), F.col("y"))
    points = spark.createDataFrame([("t", 3100.0, -2500.0), ("t", 100.0, 900.0)], "a string, x double, y double").withColumn("lat", lat).withColumn("lon", lon)
    got = [r["values"] for r in chunks.read_points(store, points, g, F.concat("a", F.lit("/0."), "_chunk")).orderBy("x").collect()]
    assert got == [[11.0, 111.0], [2.0, 102.0]]
    assert chunks.read_points(store, points.limit(0), g, F.col("_chunk")).count() == 0
    with pytest.raises(ValueError, match="codec"):
        chunks.to_chunks(cells, g, F.lit("a"), codec="blosc")
    with pytest.raises(ValueError, match="numbers"):
        chunks.decoded(bytes(12), "raw", "<f4", 1, 2)


# ---------------------------------------------------------------- nearest places

def by_hand(left, right):
    out = {}
    for n, x, y in left:
        if x is None or y is None or not math.isfinite(x + y):
            out[n] = None
            continue
        best = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in right if a is not None and b is not None and math.isfinite(a + b))
        out[n] = best[1]
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "one", "lattice", "far"])
def test_nearest_in_plane(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 300
    if kind == "clusters":
        r = np.concatenate([rng.normal(size=(n // 2, 2)) * 0.01 + 5, rng.normal(size=(n // 2, 2)) * 100])
    elif kind == "line":
        r = np.stack([np.linspace(0, 10, n), np.full(n, 3.0)], axis=1)
    elif kind == "one":
        r = np.array([[1.5, -2.0]] * 40)
    elif kind == "lattice":
        r = np.stack(np.meshgrid(np.arange(15.0), np.arange(15.0)), axis=-1).reshape(-1, 2)
    else:
        r = rng.uniform(-50, 50, (n, 2))
    q = np.round(rng.uniform(-60, 60, (400, 2)) * (1000 if kind == "far" else 1), 0 if kind == "lattice" else 3) / (2 if kind == "lattice" else 1)
    right = [(int(k), float(a), float(b)) for k, (a, b) in zip(rng.permutation(len(r)), r, strict=True)] + [(9999, None, 1.0), (9998, float("nan"), 0.0)]
    left = [(i, float(a), float(b)) for i, (a, b) in enumerate(q)] + [(5000, None, 1.0), (5001, float("inf"), 1.0)] + [(6000 + i, 1.0, 1.0) for i in range(50)]
    got = nearest.nearest_in_plane(spark.createDataFrame(left, "n int, x double, y double"), spark.createDataFrame(right, "k int, a double, b double"), "x", "y", "a", "b", "k").collect()
    assert {g["n"]: g["nearest_key"] for g in got} == by_hand(left, right) and len(got) == len(left)


def test_nearest_without_sites(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "n int, x double, y double")
    none = spark.createDataFrame([], "k int, x double, y double")
    assert [tuple(r) for r in nearest.nearest_in_plane(left, none, "x", "y", "x", "y", "k").collect()] == [(1, 0.0, 0.0, None, None)]
    assert nearest.nearest_in_plane(left.limit(0), left, "x", "y", "x", "y", "n").count() == 0


# ---------------------------------------------------------------- reprojection

class Plain:
    """A projection that changes nothing, so that overlaps are those of rectangles."""

    def inverse(self, x, y):
        return y + F.lit(0.0), x + F.lit(0.0)


def test_areas_of_clipped_polygons():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    diamond = np.array([[1, 0], [2, 1], [1, 2], [0, 1]], float)
    shapes = np.stack([square, diamond, diamond, square, diamond[::-1], square])
    low = np.array([[1, 1], [0, 0], [0, 0], [5, 5], [0.5, 0.5], [-1, -1]], float)
    high = np.array([[3, 3], [1, 1], [2, 2], [6, 6], [1.5, 1.5], [9, 9]], float)
    assert overlap.clipped_areas(shapes, low, high) == pytest.approx([1, 0.5, 2, 0, 1, 4])


def test_reprojection_of_rectangles_is_regridding(spark):
    """Without a projection the result is that of conservative regridding, to the last places."""
    rng = np.random.default_rng(2)
    rows = [(float(j) + 0.25, float(i) + 10.25, float(rng.normal())) for i in range(6) for j in range(5)]
    src = spark.createDataFrame(rows, "x double, y double, value double").withColumn("time", F.lit(1))
    got = overlap.reproject_conservative(src, Plain(), 1.0, 1.0, 0.75, ["time"])
    mine = {(r["lat"], r["lon"]): r["value"] for r in got.collect()}
    # every overlapped cell has a row, and amounts are kept
    total = sum(v * 0.75 * (math.sin(math.radians(lat + 0.375)) - math.sin(math.radians(lat - 0.375))) for (lat, _), v in mine.items())
    want = sum(v * (math.sin(math.radians(y + 0.5)) - math.sin(math.radians(y - 0.5))) for x, y, v in rows)
    assert total == pytest.approx(want, abs=1e-12)
    whole = src.withColumnRenamed("x", "lon").withColumnRenamed("y", "lat")
    centres = lambda vs, name: spark.createDataFrame([(v, v - 0.375, v + 0.375) for v in vs], f"{name} double, lo double, hi double")
    same = grid.regrid(whole, centres(sorted({a for a, _ in mine}), "lat"), centres(sorted({b for _, b in mine}), "lon"), "conservative", ["time"]).collect()
    assert {(r["lat"], r["lon"]) for r in same} == set(mine)
    assert all(r["value"] == pytest.approx(mine[r["lat"], r["lon"]], abs=1e-12) for r in same)


@pytest.mark.parametrize("resolution", [0.004, 0.05, 1.0])
def test_reprojection_keeps_amounts(spark, resolution):
    """Finer and coarser than the cells: the weights of a cell add up to its outline, and no cell inside is missing."""
    p = inventories.projection("co2_lambert")
    cells = [(1000.0 * i - 95_000, 1000.0 * j + 3000) for i in range(6) for j in range(5)]
    df = spark.createDataFrame([(x, y, float(n % 7) + 1) for n, (x, y) in enumerate(cells)], "x double, y double, value double").withColumn("s", F.lit("a"))
    w = overlap.overlap_weights(df, p, 1000.0, 1000.0, resolution).toPandas()
    corners = df.select("x", "y", *[c.alias(f"{n}{k}") for k, (i, j) in enumerate(((-500, -500), (500, -500), (500, 500), (-500, 500))) for n, c in zip(("lat", "lon"), p.inverse(F.col("x") + i, F.col("y") + j), strict=True)]).toPandas()
    own = overlap.polygon_areas(overlap.outlines(corners[[f"lon{k}" for k in range(4)]].to_numpy(), corners[[f"lat{k}" for k in range(4)]].to_numpy()))
    merged = w.groupby(["x", "y"])["area"].sum().reset_index().merge(corners.assign(own=own), on=["x", "y"])
    assert len(merged) == 30 and (merged["area"] / merged["own"] - 1).abs().max() < 1e-9
    out = overlap.reproject_conservative(df, p, 1000.0, 1000.0, resolution, ["s"]).toPandas()
    full = resolution * (np.sin(np.radians(out["lat"] + resolution / 2)) - np.sin(np.radians(out["lat"] - resolution / 2)))
    amount = (own * df.toPandas()["value"]).sum()
    assert (out["value"] * full).sum() == pytest.approx(amount, rel=1e-9)
    if resolution < 0.01:
        inner = out[out["value"].between(0.999, 7.001)]
        step = lambda c: np.rint(inner[c] / resolution - 0.5).astype(int)
        held = set(zip(step("lat"), step("lon"), strict=True))
        assert sum((i, j) not in held and {(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)} <= held for i in range(min(a for a, _ in held), max(a for a, _ in held)) for j in range(min(b for _, b in held), max(b for _, b in held))) == 0


def test_reprojection_of_nulls_and_the_date_line(spark):
    src = spark.createDataFrame([(0.5, 0.5, 1.0), (1.5, 0.5, None), (179.75, 0.5, 2.0), (None, 0.5, 3.0)], "x double, y double, value double").withColumn("t", F.lit(0))
    plain = {(r["lat"], r["lon"]): r["value"] for r in overlap.reproject_conservative(src, Plain(), 1.0, 1.0, 2.0, ["t"]).collect()}
    normed = {(r["lat"], r["lon"]): r["value"] for r in overlap.reproject_conservative(src, Plain(), 1.0, 1.0, 2.0, ["t"], "conservative_normed").collect()}
    assert plain[1.0, 1.0] is None and normed[1.0, 1.0] == pytest.approx(1.0) and {k for k in plain} == {(1.0, 1.0), (1.0, 179.0), (1.0, -179.0)}
    assert normed[1.0, -179.0] == pytest.approx(2.0)
    assert overlap.reproject_conservative(src.limit(0), Plain(), 1.0, 1.0, 2.0, ["t"]).count() == 0
    for wrong in (lambda: overlap.reproject_conservative(src, None, 1, 1, 1.0), lambda: overlap.reproject_conservative(src, Plain(), 1, 1, 1.0, ["t"], "mean")):
        with pytest.raises(ValueError):
            wrong()



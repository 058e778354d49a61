"""Long grids (time, lat, lon, sector, value): clipping, area, regridding, emissions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, timeops
from .aggregates import sum_sectors


def decimals(step: float) -> int:
    return max(0, -math.floor(math.log10(step)) + 1)


def regular_grid(spark: SparkSession, bbox: tuple[float, float, float, float], dx: float, dy: float) -> DataFrame:
    """Cell centres (lat, lon) within a box."""
    nx, ny = math.ceil((bbox[2] - bbox[0]) / dx - 1e-9), math.ceil((bbox[3] - bbox[1]) / dy - 1e-9)
    lon = spark.range(nx).select(F.round(bbox[0] + dx / 2 + F.col("id") * dx, decimals(dx)).alias("lon"))
    lat = spark.range(ny).select(F.round(bbox[1] + dy / 2 + F.col("id") * dy, decimals(dy)).alias("lat"))
    return lat.crossJoin(lon)  # the grid itself


def bounds(centres: DataFrame, col: str) -> DataFrame:
    """(col, lo, hi): half-way to the neighbours, the ends mirrored."""
    w = Window.orderBy(col)
    p, n = F.lag(col).over(w), F.lead(col).over(w)
    c = F.col(col)
    lo, hi = F.coalesce((p + c) / 2, c - (n - c) / 2), F.coalesce((n + c) / 2, c + (c - p) / 2)
    once = centres.select(col).distinct()  # repeated centres would make cells without width
    return once.select(col, lo.alias("lo"), hi.alias("hi"))


def cell_key(col: str, digits: int = 4):
    return F.bround(F.col(col) * 10**digits).cast("bigint")


def clip(grid: DataFrame, bbox=None, extent=None, ring=None, x: str = "lon", y: str = "lat") -> DataFrame:
    if sum(v is not None for v in (bbox, extent, ring)) != 1:
        raise AssertionError("give a box, an extent or a polygon")
    if ring is not None:
        xs, ys = zip(*ring, strict=True)
        return grid.filter(geo.clip_box(x, y, (min(xs), min(ys), max(xs), max(ys))) & geo.inside_polygon(x, y, list(ring)))
    return grid.filter(geo.clip_box(x, y, bbox if bbox is not None else geo.extent_to_bbox(extent)))


def with_area(grid: DataFrame, dlat: float, dlon: float, radius_km: float | None = None) -> DataFrame:
    return grid.withColumn("area", geo.cell_area("lat", dlat, dlon, radius_km))


def absolute_emissions(flux: DataFrame, dlat: float, dlon: float, step: str, radius_km: float | None = None) -> DataFrame:
    """Amount of each cell and step: flux times area times seconds."""
    amount = F.col("value") * geo.cell_area("lat", dlat, dlon, radius_km) * timeops.seconds_in_step("time", step)
    return flux.withColumn("value", amount)


def integrate(flux: DataFrame, dlat: float, dlon: float, step: str, radius_km: float | None = None) -> DataFrame:
    return sum_sectors(absolute_emissions(flux, dlat, dlon, step, radius_km), ("time",))


def _overlaps(src: DataFrame, dst: DataFrame, col: str, cell: float, sine: bool) -> DataFrame:
    """(src, dst, weight) of one axis by cells of the axis; weight is the shared length (of the sine for latitudes)."""
    f = (lambda c: F.sin(F.radians(c))) if sine else (lambda c: c)
    deal = lambda d, a: d.select(F.col(col).alias(a), F.col("lo").alias(f"{a}_lo"), F.col("hi").alias(f"{a}_hi"), F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))).alias("_cell"))
    both = deal(src, "s").join(deal(dst, "d"), "_cell")
    lo, hi = F.greatest("s_lo", "d_lo"), F.least("s_hi", "d_hi")
    return both.filter(hi > lo).select("s", "d", (f(hi) - f(lo)).alias("w"), (f(F.col("d_hi")) - f(F.col("d_lo"))).alias("full")).distinct()


def regrid(grid: DataFrame, lats: DataFrame, lons: DataFrame, method: str = "conservative", coords: Sequence[str] = ("time",), value: str = "value") -> DataFrame:
    """Values on the cells of new centres. lats and lons: (lat, lo, hi) and (lon, lo, hi) of the new cells.

    conservative: area means, null-propagating; conservative_normed: over cells with values; nearest: the nearest source;
    nearest_d2s: each source goes to its nearest new cell, whose value is their sum (cells without a source have no row);
    patch: second-degree fits around the four nearest centres, blended (null if one of their values is; see _patch).
    """
    src_lat, src_lon = bounds(grid.select("lat").distinct(), "lat"), bounds(grid.select("lon").distinct(), "lon")
    if method == "nearest":
        from .series import nearest_value

        a = nearest_value(lats.select("lat"), src_lat, "lat", "lat", "lat").select(F.col("lat").alias("new_lat"), F.col("nearest_value").alias("lat"))
        b = nearest_value(lons.select("lon"), src_lon, "lon", "lon", "lon").select(F.col("lon").alias("new_lon"), F.col("nearest_value").alias("lon"))
        return grid.join(a, "lat").join(b, "lon").select(*coords, F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon"), value)
    if method == "nearest_d2s":
        return _nearest_d2s(grid, src_lat, src_lon, lats, lons, coords, value)
    if method == "bilinear":
        return _bilinear(grid, lats, lons, coords, value)
    if method == "patch":
        return _patch(grid, lats, lons, coords, value)
    if method not in ("conservative", "conservative_normed"):
        raise ValueError(f"unknown method {method}")
    wy = _overlaps(src_lat, lats, "lat", 1.0, True).select(F.col("s").alias("lat"), F.col("d").alias("new_lat"), F.col("w").alias("wy"), F.col("full").alias("fy"))
    wx = _overlaps(src_lon, lons, "lon", 1.0, False).select(F.col("s").alias("lon"), F.col("d").alias("new_lon"), F.col("w").alias("wx"), F.col("full").alias("fx"))
    each = grid.join(wy, "lat").join(wx, "lon")
    w = F.col("wx") * F.col("wy")
    agg = each.groupBy(*coords, "new_lat", "new_lon").agg(F.sum(w * F.col(value)).alias("_s"), F.sum(F.when(F.col(value).isNotNull(), w)).alias("_w"), F.first(F.col("fx") * F.col("fy")).alias("_f"), (F.count(value) == F.count(F.lit(1))).alias("_all"))
    out = F.try_divide(F.col("_s"), F.col("_w")) if method == "conservative_normed" else F.when(F.col("_all"), F.col("_s") / F.col("_f"))
    return agg.select(*coords, F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon"), out.alias(value))


def _nearest_d2s(grid, src_lat, src_lon, lats, lons, coords, value) -> DataFrame:
    from .series import nearest_value

    a = nearest_value(src_lat.select("lat"), lats, "lat", "lat", "lat").select("lat", F.col("nearest_value").alias("new_lat"))
    b = nearest_value(src_lon.select("lon"), lons, "lon", "lon", "lon").select("lon", F.col("nearest_value").alias("new_lon"))
    each = grid.join(a, "lat").join(b, "lon").groupBy(*coords, "new_lat", "new_lon").agg(F.sum(value).alias(value))
    return each.select(*coords, F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon"), value)


def _bilinear(grid: DataFrame, lats: DataFrame, lons: DataFrame, coords: Sequence[str], value: str) -> DataFrame:
    def brackets(new: DataFrame, old: DataFrame, col: str) -> DataFrame:
        """(old, new, weight) of the two old centres around each new one; none outside."""
        both = old.select(F.col(col).alias("x"), F.lit(0).alias("k")).unionByName(new.select(F.col(col).alias("x"), F.lit(1).alias("k")))
        down, up = Window.orderBy("x", "k"), Window.orderBy(F.desc("x"), "k")
        at = F.when(F.col("k") == 0, F.col("x"))
        span = both.withColumn("lo", F.last(at, True).over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.last(at, True).over(up.rowsBetween(Window.unboundedPreceding, 0))).filter("k = 1 AND lo IS NOT NULL AND hi IS NOT NULL")
        t = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
        return span.select(F.col("x").alias(f"new_{col}"), F.explode(F.array(F.struct(F.col("lo").alias("c"), (1 - t).alias("w")), F.struct(F.col("hi").alias("c"), t.alias("w")))).alias("e")).select(f"new_{col}", F.col("e.c").alias(col), F.col("e.w").alias(f"w_{col}")).filter(f"w_{col} > 0")

    a, b = brackets(lats, grid.select("lat").distinct(), "lat"), brackets(lons, grid.select("lon").distinct(), "lon")
    each = grid.join(a, "lat").join(b, "lon")
    return each.groupBy(*coords, "new_lat", "new_lon").agg(F.sum(F.col("w_lat") * F.col("w_lon") * F.col(value)).alias(value)).select(*coords, F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon"), value)


def _patch_axis(new: DataFrame, old: DataFrame, col: str) -> DataFrame:
    """(new, old, t, a0, a1, a2): how three old centres around each of the two that bracket a new one share in the fits of
    degree 0, 1 and 2 along this axis. At the ends the three centres are the outermost ones.

    On three places the fit of degree 2 goes through all of them (Lagrange's weights), that of degree 0 is their mean and
    that of degree 1 the line by moments; what the higher ones add is the weight of their degree.
    """
    ranked = old.select(F.col(col).alias("x")).distinct().withColumn("i", F.row_number().over(Window.orderBy("x")))
    size = ranked.agg(F.max("i").alias("n"))  # one row
    both = ranked.select("x", F.lit(0).alias("k"), "i").unionByName(new.select(F.col(col).alias("x"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("i")).distinct())
    down, up = Window.orderBy("x", "k"), Window.orderBy(F.desc("x"), "k")
    at = F.when(F.col("k") == 0, F.struct("x", "i"))
    span = both.withColumn("lo", F.last(at, True).over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.last(at, True).over(up.rowsBetween(Window.unboundedPreceding, 0))).filter("k = 1 AND lo IS NOT NULL AND hi IS NOT NULL")
    share = F.coalesce(F.try_divide(F.col("x") - F.col("lo.x"), F.col("hi.x") - F.col("lo.x")), F.lit(0.0))
    ends = F.explode(F.array(F.struct(F.col("lo.i").alias("i"), (1 - share).alias("t")), F.struct(F.col("hi.i").alias("i"), share.alias("t"))))
    node = span.select(F.col("x").alias("p"), ends.alias("e")).filter("e.t > 0").crossJoin(F.broadcast(size)).filter("n > 2")
    middle = F.greatest(F.lit(2), F.least(F.col("n") - 1, F.col("e.i")))
    three = node.select("p", "e.t", F.col("e.i").alias("node"), F.explode(F.array(middle - 1, middle, middle + 1)).alias("i")).join(ranked, "i")
    three = three.withColumn("xs", F.collect_list("x").over(Window.partitionBy("p", "node")))
    mean = (F.get("xs", F.lit(0)) + F.get("xs", F.lit(1)) + F.get("xs", F.lit(2))) / 3
    moment = F.aggregate("xs", F.lit(0.0), lambda a, x: a + (x - mean) ** 2)
    lagrange = F.aggregate("xs", F.lit(1.0), lambda a, x: F.when(x == F.col("x"), a).otherwise(a * (F.col("p") - x) / (F.col("x") - x)))
    a0, a1 = F.lit(1 / 3), (F.col("x") - mean) * (F.col("p") - mean) / moment
    return three.select(F.col("p").alias(f"new_{col}"), F.col("x").alias(col), F.struct("t", a0.alias("a0"), a1.alias("a1"), (lagrange - a0 - a1).alias("a2")).alias(f"w_{col}"))


def _patch(grid: DataFrame, lats: DataFrame, lons: DataFrame, coords: Sequence[str], value: str) -> DataFrame:
    """Each of the four centres around a new one has a least-squares fit 1, x, y, x2, xy, y2 over the 3 * 3 centres around it;
    the fits are blended as bilinear interpolation blends values. On a product of axes such a fit is a sum of products of
    the axes' own fits. Needs three centres an axis; new centres beyond the outermost ones have no row."""
    a, b = _patch_axis(lats, grid, "lat"), _patch_axis(lons, grid, "lon")
    each = grid.join(a, "lat").join(b, "lon")
    u, v = F.col("w_lat"), F.col("w_lon")
    w = u["t"] * v["t"] * (u["a0"] * (v["a0"] + v["a1"] + v["a2"]) + u["a1"] * (v["a0"] + v["a1"]) + u["a2"] * v["a0"])
    blend = u["t"] * v["t"] / 9  # adds up to 1 if all values are there
    agg = each.groupBy(*coords, "new_lat", "new_lon").agg(F.sum(w * F.col(value)).alias("_s"), F.sum(F.when(F.col(value).isNotNull(), blend)).alias("_w"))
    return agg.select(*coords, F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon"), F.when(F.col("_w") > 1 - 1e-9, F.col("_s")).alias(value))


def resample(grid: DataFrame, resolution: float, method: str = "conservative", coords: Sequence[str] = ("time",)) -> DataFrame:
    """Regrid to square cells over the grid's outer bounds."""
    edges = [bounds(grid.select(c).distinct(), c).agg(F.min("lo"), F.max("hi")).first() for c in ("lon", "lat")]
    spark = grid.sparkSession
    (x0, x1), (y0, y1) = edges
    axis = lambda lo, hi, name: spark.range(math.ceil((hi - lo) / resolution - 1e-9)).select(F.round(lo + resolution / 2 + F.col("id") * resolution, decimals(resolution)).alias(name))
    half = resolution / 2
    cells = lambda d, name: d.select(name, (F.col(name) - half).alias("lo"), (F.col(name) + half).alias("hi"))
    return regrid(grid, cells(axis(y0, y1, "lat"), "lat"), cells(axis(x0, x1, "lon"), "lon"), method, coords)


def long_sectors(wide: DataFrame, coords: Sequence[str], sectors: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(coords), list(sectors), "sector", "value")


def scale_by_month(annual: DataFrame, factors: DataFrame, cells: Sequence[str] = ("lat", "lon", "sector")) -> DataFrame:
    """Monthly values: the latest annual value at or before each factor's month, times the factor (same cell and sector)."""
    from .series import asof

    joined = asof(factors.select("time", *cells, "factor"), annual.select("time", *cells, "value"), "time", ["value"], cells)
    return joined.filter("value IS NOT NULL").select("time", *cells, (F.col("value") * F.col("factor")).alias("value"))


def combine_first(first: DataFrame, second: DataFrame, coords: Sequence[str], value: str = "value") -> DataFrame:
    b = second.withColumnRenamed(value, "_other")
    return first.join(b, list(coords), "full_outer").select(*coords, F.coalesce(value, "_other").alias(value))


def round_positions(grid: DataFrame, lat_digits: int, lon_digits: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates rounded half to even, so that equal cells of two grids can be joined."""
    return grid.withColumns({c: F.rint(F.col(c) * 10.0**n) / 10.0**n for c, n in ((lat, lat_digits), (lon, lon_digits))})


def without_sectors(grid: DataFrame, sectors: list[str], sector: str = "sector") -> DataFrame:
    """Leaves out sectors that are sums of others; rows without a sector stay."""
    return grid.filter(F.coalesce(~F.col(sector).isin(*sectors), F.lit(True)))


def replicate_factors(factors: DataFrame, year: int, until: int, time: str = "time") -> DataFrame:
    """Monthly factors of one year, repeated at the same months of each later year up to `until`."""
    of_year = factors.filter(F.year(time) == year)
    if until <= year:
        return of_year
    later = of_year.select("*", F.explode(F.sequence(F.lit(1), F.lit(until - year))).alias("_years")).withColumn(time, F.col(time) + F.make_ym_interval(F.col("_years"), F.lit(0))).drop("_years")
    return of_year.unionByName(later)

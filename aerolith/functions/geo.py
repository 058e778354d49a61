"""Positions on the earth as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# WGS84 half-axes in km.
WGS84_A, WGS84_B = 6378.137, 6356.752314245
WGS84_E = math.sqrt(1 - (WGS84_B / WGS84_A) ** 2)


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def bbox_to_extent(b: tuple) -> tuple:
    """(xmin, ymin, xmax, ymax) to (xmin, xmax, ymin, ymax)."""
    return b[0], b[2], b[1], b[3]


def extent_to_bbox(e: tuple) -> tuple:
    return e[0], e[2], e[1], e[3]


def dms_to_degrees(d, m, s) -> Column:
    """Degrees, minutes and seconds added up (a sign isn't carried over); null for what is no number."""
    return _c(d).try_cast("double") + _c(m).try_cast("double") / 60 + _c(s).try_cast("double") / 3600


def wrap_lon(lon, base: float = -180.0, period: float = 360.0) -> Column:
    return F.pmod(_c(lon) - base, F.lit(period)) + base


def earth_radius(lat) -> Column:
    """Distance of the WGS84 surface from the centre, km."""
    a, b = WGS84_A, WGS84_B
    c, s = F.cos(F.radians(_c(lat))), F.sin(F.radians(_c(lat)))
    return F.sqrt(((a * a * c) ** 2 + (b * b * s) ** 2) / ((a * c) ** 2 + (b * s) ** 2))


def cosine_weight(lat) -> Column:
    return F.cos(F.radians(_c(lat)))


def bearing(lat1, lon1, lat2, lon2, final: bool = False) -> Column:
    p1, p2, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    b = F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))
    return F.pmod(b + (180.0 if final else 0.0), F.lit(360.0))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.sin((p2 - p1) / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(F.radians(_c(lon2) - _c(lon1)) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def cell_area(lat, dlat: float, dlon: float, radius_km: float | None = None) -> Column:
    """km2 of a cell of the given size around a latitude: R2 dlon (sin north - sin south)."""
    r = F.lit(radius_km) if radius_km is not None else earth_radius(lat)
    north, south = F.radians(F.least(_c(lat) + dlat / 2, F.lit(90.0))), F.radians(F.greatest(_c(lat) - dlat / 2, F.lit(-90.0)))
    return r * r * math.radians(dlon) * (F.sin(north) - F.sin(south))


@dataclass(frozen=True)
class Lambert:
    """Lambert conformal conic projection, tangent or secant, of a sphere or (with an eccentricity) an ellipsoid."""

    lat1: float = 38.5
    lat2: float = 38.5
    lat0: float = 38.5
    lon0: float = 262.5
    radius: float = 6371229.0
    e: float = 0.0
    x0: float = 0.0
    y0: float = 0.0

    def _conformal(self, lat: float) -> float:
        """tan of half the conformal colatitude."""
        s = self.e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) * ((1 + s) / (1 - s)) ** (self.e / 2)

    def _cone(self) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(x) for x in (self.lat1, self.lat2, self.lat0))
        m = lambda p: math.cos(p) / math.sqrt(1 - (self.e * math.sin(p)) ** 2)
        t1, t2 = self._conformal(p1), self._conformal(p2)
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(m(p1) / m(p2)) / math.log(t1 / t2)
        f = m(p1) / (n * t1**n)
        return n, f, self.radius * f * self._conformal(p0) ** n

    def forward(self, lat, lon) -> tuple[Column, Column]:
        n, f, rho0 = self._cone()
        phi = F.radians(_c(lat))
        t = F.tan(math.pi / 4 - phi / 2)
        if self.e:
            s = self.e * F.sin(phi)
            t = t * F.pow((1 + s) / (1 - s), F.lit(self.e / 2))
        rho = self.radius * f * F.pow(t, F.lit(n))
        a = n * F.radians(wrap_lon(_c(lon) - self.lon0))
        x, y = rho * F.sin(a), rho0 - rho * F.cos(a)
        return (x + self.x0, y + self.y0) if self.x0 or self.y0 else (x, y)

    def inverse(self, x, y) -> tuple[Column, Column]:
        """The latitude by the series of the conformal one up to e^8: right to some 1e-9 degrees."""
        n, f, rho0 = self._cone()
        x, dy = (_c(x) - self.x0, rho0 + self.y0 - _c(y)) if self.x0 or self.y0 else (_c(x), rho0 - _c(y))
        rho = math.copysign(1, n) * F.sqrt(x**2 + dy**2)
        lat = math.pi / 2 - 2 * F.atan(F.pow(rho / (self.radius * f), F.lit(1 / n)))
        if self.e:
            e2, e4, e6, e8 = (self.e**i for i in (2, 4, 6, 8))
            terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
            chi = lat
            for i, c in enumerate(terms):
                lat = lat + c * F.sin(2 * (i + 1) * chi)
        return F.degrees(lat), wrap_lon(self.lon0 + F.degrees(F.atan2(x, dy)) / n)


def inside_polygon(x, y, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule for a point and a closed ring of few corners."""
    x, y = _c(x), _c(y)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def clip_box(x, y, bbox: tuple[float, float, float, float]) -> Column:
    return _c(x).between(bbox[0], bbox[2]) & _c(y).between(bbox[1], bbox[3])

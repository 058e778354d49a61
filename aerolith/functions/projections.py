"""Projections from text (proj4 strings, WKT, EPSG numbers) and back, and kept in column metadata."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame

from . import geo

# Half-axes in metres (WGS84's are those of `geo`), unit lengths in metres, plain geographic EPSG numbers,
# and the names of parameters in proj4 and WKT.
ELLIPSOIDS = {"wgs84": (1000 * geo.WGS84_A, 1000 * geo.WGS84_B), "grs80": (6378137.0, 6378137.0 * (1 - 1 / 298.257222101)), "clrk66": (6378206.4, 6356583.8), "sphere": (6370997.0, 6370997.0)}
DATUMS = {"wgs84": "wgs84", "nad83": "grs80", "nad27": "clrk66"}
LENGTHS = {"m": 1.0, "metre": 1.0, "meter": 1.0, "km": 1000.0, "kilometre": 1000.0, "kilometer": 1000.0}
GEOGRAPHIC = (4326, 4269, 4267)
PARAMETERS = {
    "lat1": ("lat_1", "standard_parallel_1", "latitude of 1st standard parallel"),
    "lat2": ("lat_2", "standard_parallel_2", "latitude of 2nd standard parallel"),
    "lat0": ("lat_0", "latitude_of_origin", "latitude_of_center", "latitude of false origin", "latitude of natural origin"),
    "lon0": ("lon_0", "central_meridian", "longitude_of_center", "longitude of false origin", "longitude of natural origin"),
    "x0": ("x_0", "false_easting", "easting at false origin", "false easting"),
    "y0": ("y_0", "false_northing", "northing at false origin", "false northing"),
}


def _eccentricity(a: float, b: float) -> float:
    if a == ELLIPSOIDS["wgs84"][0] and b == ELLIPSOIDS["wgs84"][1]:
        return geo.WGS84_E
    return math.sqrt(max(0.0, 1 - (b / a) ** 2))


def _lambert(found: dict[str, float], a: float, b: float) -> geo.Lambert:
    """Angles and shifts by our names; one parallel means a tangent cone, and the origin's latitude is the first one's."""
    lat1 = found.get("lat1", found.get("lat0"))
    if lat1 is None:
        raise ValueError("a Lambert projection needs a standard parallel")
    lat2 = found.get("lat2", lat1)
    if abs(lat1 + lat2) < 1e-9:
        raise ValueError("the parallels of a cone can't lie opposite each other")
    return geo.Lambert(lat1, lat2, found.get("lat0", 0.0 if "lat2" in found else lat1), found.get("lon0", 0.0), a, _eccentricity(a, b), found.get("x0", 0.0), found.get("y0", 0.0))


def from_proj4(text: str) -> geo.Lambert | None:
    """The projection of a proj4 string; None for longitudes and latitudes."""
    parts = {k.lower(): v for k, v in re.findall(r"\+([A-Za-z_0-9]+)(?:=([^\s]+))?", text)}
    kind = parts.get("proj", "").lower()
    if kind in ("longlat", "latlong", "lonlat", "latlon"):
        return None
    if kind != "lcc":
        raise ValueError(f"projection {kind!r} isn't supported; known: lcc, longlat")
    if LENGTHS.get(parts.get("units", "m").lower()) != 1.0 or float(parts.get("k_0", parts.get("k", 1))) != 1:
        raise ValueError("only metres and a scale of 1 are supported")
    if "r" in parts:
        a = b = float(parts["r"])
    elif "a" in parts:
        a = float(parts["a"])
        b = float(parts["b"]) if "b" in parts else a * (1 - 1 / float(parts["rf"])) if "rf" in parts else a
    else:
        name = parts.get("ellps", DATUMS.get(parts.get("datum", "wgs84").lower(), "")).lower()
        if name not in ELLIPSOIDS:
            raise ValueError(f"unknown ellipsoid {name!r}; known: {sorted(ELLIPSOIDS)}")
        a, b = ELLIPSOIDS[name]
    return _lambert({k: float(parts[names[0]]) for k, names in PARAMETERS.items() if names[0] in parts}, a, b)


def from_wkt(text: str) -> geo.Lambert | None:
    """The projection of WKT (1 or 2): Lambert's conformal cone; None for a geographic system."""
    head = re.match(r"\s*([A-Z_0-9]+)\s*\[", text, re.I)
    if not head or text.count("[") != text.count("]"):
        raise ValueError("not WKT")
    body = re.search(r'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)', text, re.I)
    if head[1].upper() in ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS", "GEODETICCRS"):
        return None
    method = re.search(r'(?:PROJECTION|METHOD)\s*\[\s*"([^"]*)"', text, re.I)
    if not method or not re.search(r"lambert.*conformal|lambert.*conic conformal|lambert conic conformal", method[1].replace("_", " "), re.I):
        raise ValueError(f"projection {method[1] if method else None!r} isn't supported")
    if not body:
        raise ValueError("the WKT names no ellipsoid")
    a, inverse = float(body[1]), float(body[2])
    b = a * (1 - 1 / inverse) if inverse else a
    if (a, inverse) == (6378137.0, 298.257223563):
        a, b = ELLIPSOIDS["wgs84"]
    units = re.findall(r'(?:UNIT|LENGTHUNIT)\s*\[\s*"(metre|meter|kilometre|kilometer|km|m|[^"]*foot[^"]*)"', text, re.I)
    if any(LENGTHS.get(u.lower()) != 1.0 for u in units):
        raise ValueError("only metres are supported")
    given = {k.strip().lower(): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]*)"\s*,\s*([-+.\deE]+)', text, re.I)}
    found = {k: given[n] for k, names in PARAMETERS.items() for n in names if n in given}
    return _lambert(found, a, b)


def from_text(text: str | int) -> geo.Lambert | None:
    """The projection of an EPSG number or 'EPSG:n' (geographic ones), a proj4 string, or WKT."""
    number = re.fullmatch(r"\s*(?:epsg:)?(\d+)\s*", str(text), re.I)
    if number:
        if int(number[1]) in GEOGRAPHIC:
            return None
        raise ValueError(f"EPSG {number[1]} isn't known; give its proj4 or WKT text")
    return from_proj4(text) if "+proj" in text else from_wkt(text)


def to_proj4(p: geo.Lambert | None) -> str:
    if p is None:
        return "+proj=longlat +ellps=WGS84 +no_defs"
    body = "+ellps=WGS84" if p.e == geo.WGS84_E and p.radius == ELLIPSOIDS["wgs84"][0] else f"+a={p.radius!r} +b={p.radius * math.sqrt(1 - p.e**2)!r}" if p.e else f"+R={p.radius!r}"
    return f"+proj=lcc +lat_1={p.lat1!r} +lat_2={p.lat2!r} +lat_0={p.lat0!r} +lon_0={p.lon0!r} +x_0={p.x0!r} +y_0={p.y0!r} {body} +units=m +no_defs"


def with_projection(df: DataFrame, text: str | int, x: str = "x", y: str = "y") -> DataFrame:
    """The same rows; both columns' metadata name the projection, as proj4 text."""
    proj4 = to_proj4(from_text(text))
    for c in (x, y):
        df = df.withMetadata(c, {**df.schema[c].metadata, "projection": proj4})
    return df


def projection_of(df: DataFrame, x: str = "x", y: str = "y") -> geo.Lambert | None:
    """The projection that the columns' metadata name; an error if there is none, or if they differ."""
    named = {df.schema[c].metadata.get("projection") for c in (x, y)}
    if len(named) != 1 or None in named:
        raise ValueError(f"columns {x} and {y} name no common projection")
    return from_proj4(named.pop())


def to_degrees(df: DataFrame, x: str = "x", y: str = "y", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with latitudes and longitudes of its projected columns."""
    p = projection_of(df, x, y)
    a, b = p.inverse(x, y) if p else (geo._c(y), geo._c(x))
    return df.withColumns({lat: a, lon: b})

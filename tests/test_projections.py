"""Projection text: proj4 and WKT give the settings that the library has, and go through metadata."""

import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions import projections as pr
from aerolith.sources import inventories as inv

CO2 = "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=40 +lon_0=-97 +x_0=0 +y_0=0 +ellps=WGS84 +units=m +no_defs"
FORECAST = "+proj=lcc +lat_1=38.5 +lat_2=38.5 +lat_0=38.5 +lon_0=262.5 +R=6371229 +units=m"
WKT1 = """PROJCS["a",GEOGCS["b",DATUM["c",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],
 PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",33],PARAMETER["standard_parallel_2",45],PARAMETER["latitude_of_origin",40],
 PARAMETER["central_meridian",-97],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1]]"""
WKT2 = """PROJCRS["a",BASEGEOGCRS["b",DATUM["c",ELLIPSOID["sphere",6371229,0,LENGTHUNIT["metre",1]]]],CONVERSION["d",METHOD["Lambert Conic Conformal (2SP)",ID["EPSG",9802]],
 PARAMETER["Latitude of 1st standard parallel",38.5],PARAMETER["Latitude of 2nd standard parallel",38.5],PARAMETER["Latitude of false origin",38.5],
 PARAMETER["Longitude of false origin",262.5],PARAMETER["Easting at false origin",0],PARAMETER["Northing at false origin",0]],CS[Cartesian,2]]"""


def test_known_strings():
    assert pr.from_text(CO2) == pr.from_text(WKT1) == inv.projection("co2_lambert") == inv.projection(CO2)
    assert pr.from_text(FORECAST) == pr.from_text(WKT2) == inv.projection("forecast_lambert") == geo.Lambert()
    for plain in (4326, "EPSG:4326", "epsg:4269", "+proj=longlat +datum=WGS84", 'GEOGCS["WGS 84",DATUM["d",SPHEROID["s",6378137,298.257223563]]]'):
        assert pr.from_text(plain) is None
    assert pr.from_text("+proj=lcc +lat_1=30 +lon_0=10 +a=6378206.4 +b=6356583.8 +x_0=500 +y_0=-7").x0 == 500
    assert pr.from_text("+proj=lcc +lat_0=30 +ellps=GRS80").lat1 == 30


@pytest.mark.parametrize("wrong", [5070, "EPSG:1", "+proj=utm +zone=12", "+proj=lcc +lat_1=10 +lat_2=-10 +ellps=WGS84", "+proj=lcc +lat_1=10 +units=us-ft", "+proj=lcc +lat_1=10 +ellps=moon", "+proj=lcc +ellps=WGS84", "nothing", WKT1[:-1], WKT1.replace("Lambert_Conformal_Conic_2SP", "Mercator_1SP"), WKT1.replace('UNIT["metre",1]', 'UNIT["US survey foot",0.3048]')])
def test_what_is_not_understood(wrong):
    with pytest.raises(ValueError):
        pr.from_text(wrong)


def test_round_trips_and_metadata(spark):
    shifted = geo.Lambert(30.0, 50.0, 40.0, 10.0, 6378206.4, 0.08, 1000.0, -2000.0)
    for p in (inv.projection("co2_lambert"), geo.Lambert(), shifted):
        again = pr.from_text(pr.to_proj4(p))
        assert again.e == pytest.approx(p.e, abs=1e-13) and again == geo.Lambert(p.lat1, p.lat2, p.lat0, p.lon0, p.radius, again.e, p.x0, p.y0)
    at = spark.createDataFrame([(38.0, 12.0), (45.5, -3.0)], "lat0 double, lon0 double")
    x, y = shifted.forward("lat0", "lon0")
    df = pr.with_projection(at.withColumn("x", x).withColumn("y", y), pr.to_proj4(shifted))
    assert all(abs(r["lat"] - r["lat0"]) < 1e-8 and abs(r["lon"] - r["lon0"]) < 1e-8 for r in pr.to_degrees(df.filter(F.col("x") > -1e9)).collect())
    plain = geo.Lambert(30.0, 50.0, 40.0, 10.0, 6378206.4, 0.08)
    a, b = plain.forward("lat0", "lon0")
    assert all(abs(r["dx"] - 1000) < 1e-6 and abs(r["dy"] + 2000) < 1e-6 for r in at.select((x - a).alias("dx"), (y - b).alias("dy")).collect())
    with pytest.raises(ValueError):
        pr.projection_of(at.withColumn("x", F.lit(1)).withColumn("y", F.lit(1)))

"""The inventory loader: hooks, units, files; the ellipsoidal projection; any-callable statistics."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.operators import aggregates
from aerolith.sources import inventories as inv

RAW = "file string, lat double, lon double, value double, year string, long_name string, extra int"


def test_files_hooks_and_units(spark, tmp_path):
    rows = [("a.nc", 1.0, 359.0, 2.0, "2012", "Rice, paddy-fields x", 7), ("a_TOTALS.nc", 1.0, 2.0, 3.0, "2012", "All", 7), ("a.nc", None, 2.0, None, "2012", "Fuel exploitation", 7)]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "v8" / "CH4"))
    p = inv.product("edgar-v8", units="Mg km-2 a-1", skip=())
    not_totals = lambda d: d.filter(~F.col("long_name").eqNullSafe("All"))
    doubled = lambda d: d.withColumn("value", F.col("value") * 2)
    raw = spark.read.parquet(str(tmp_path / "v8" / "CH4"))
    got = inv.process(raw, p, before=[not_totals], after=[lambda d: inv.with_units(doubled(d), inv.units_of(d))], standardize=True)
    assert inv.units_of(got) == "kg km-2 d-1"
    assert [(r["time"], r["sector"], r["extra"], round(r["value"], 9)) for r in got.collect()] == [(dt.datetime(2012, 1, 1), "Rice_paddy_fields_x", 7, round(4000 / 365.25, 9))]
    loaded = inv.load(spark, str(tmp_path), p).collect()  # any depth of folders; `file` is the name of the Parquet file
    assert sorted(r["sector"] for r in loaded) == ["All", "Rice_paddy_fields_x"] and all(r["file"].endswith(".parquet") for r in loaded)
    assert "units" not in inv.without_units(got).schema["value"].metadata
    assert inv.process(raw.limit(0), p).count() == 0


def test_errors(spark):
    raw = spark.createDataFrame([], RAW)
    for wrong in (lambda: inv.product("nothing"), lambda: inv.process(raw, inv.product("edgar-v8", units="x")), lambda: inv.units_of(raw), lambda: inv.projection(9999), lambda: inv.estimate(raw, region="AK"), lambda: inv.estimate(raw, "lower", p=inv.product("vulcan-hourly")), lambda: inv.reproject(raw, inv.projection(4326), 1.0), lambda: inv.process(raw, inv.product("epa-v1", time_step="weekly"))):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        inv.deviations(raw, "absolute", inv.product("gfei-v1"))


def test_ellipsoidal_projection(spark):
    """A published example (Clarke 1866, parallels 33 and 45, origin 23 N 96 W) and round trips."""
    clarke = geo.Lambert(33.0, 45.0, 23.0, -96.0, 6378206.4, math.sqrt(0.00676866))
    x, y = clarke.forward(F.lit(35.0), F.lit(-75.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(1894410.9, abs=0.1) and r["y"] == pytest.approx(1564649.5, abs=0.1)
    for p in (clarke, inv.projection("co2_lambert"), inv.projection("forecast_lambert")):
        back = p.inverse(*p.forward("lat", "lon"))
        places = spark.createDataFrame([(a, o) for a in (20.0, 33.3, 50.0, 70.0) for o in (-130.0, -97.0, -60.5)], "lat double, lon double")
        assert all(abs(q["a"] - q["lat"]) < 1e-8 and abs(q["o"] - q["lon"]) < 1e-8 for q in places.select("lat", "lon", back[0].alias("a"), back[1].alias("o")).collect())


def test_labels_and_indices(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 1), 1.0), (dt.datetime(2018, 12, 1), 3.0), (dt.datetime(2019, 1, 1), None)], "time timestamp_ntz, value double").selectExpr("time", "0 AS lat", "0 AS lon", "'s' AS sector", "value")
    assert sorted(r["value"] for r in inv.at_time(df, "2018").collect()) == [1.0, 3.0]
    assert [r["value"] for r in inv.at_time(df, -2).collect()] == [3.0] and inv.at_time(df, 3).count() == 0
    assert inv.at_time(df).first()["value"] == 2.0


def test_any_callable(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None)], "k int, v double")
    got = {r["k"]: r["v_q"] for r in aggregates.by_callable(df, ["k"], "v", lambda v: pd.Series(v).quantile(0.25), "q").collect()}
    assert got == {1: 2.5, 2: None}

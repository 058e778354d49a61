"""Formulas, pandas parity, properties and the pinned decisions of the library's own operators."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo, physics, timeops
from aerolith.operators import aggregates, grid, polar, series
from aerolith.sources import names, readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_round_trips(spark):
    r = one(spark, physics.inverse_potential_temperature(90000.0, physics.potential_temperature(280.0, 90000.0)), physics.temperature_from_vapor(physics.saturation_pressure(280.0)))
    assert r[0] == pytest.approx(280) and r[1] == pytest.approx(280)
    for wd in (0.0, 11.25, 180.0, 359.0):
        u, v = physics.wind_components(5.0, wd)
        assert one(spark, physics.wind_direction(u, v))[0] % 360 == pytest.approx(wd % 360, abs=1e-9)


def test_gas_law_uses_temperature(spark):
    p, v, zero = one(spark, physics.ideal_gas("p", n=2.0, V=3.0, T=300.0), physics.ideal_gas("V", m=2.0, p=1e5, T=300.0), physics.ideal_gas("p", m=0.0, V=1.0, T=300.0))
    assert p == pytest.approx(2 * physics.R_STAR * 300 / 3)
    assert v == pytest.approx(2 * physics.RD * 300 / 1e5)
    assert zero == 0


def test_hypsometric(spark):
    dz = physics.RD * 280 / physics.G * math.log(1000 / 900)
    r = one(spark, physics.hypsometric("deltaz", Tv=280.0, p1=1000.0, p2=900.0), physics.hypsometric("p2", Z1=0.0, Z2=dz, Tv=280.0, p1=1000.0))
    assert r[0] == pytest.approx(dz) and r[1] == pytest.approx(900)


def test_units():
    assert physics.molecular_weight("CCl4") == pytest.approx(12.011 + 4 * 35.45)
    assert physics.molecular_weight("Ca(OH)2") == pytest.approx(40.078 + 2 * (15.999 + 1.008))
    assert physics.flux_factor("kg m-2 s-1", "kg km-2 d-1") == pytest.approx(1e6 * 86400)
    assert physics.flux_factor("Mg km-2 a-1", "kg km-2 d-1") == pytest.approx(1000 / 365.25)
    there, back = physics.flux_factor("molec cm-2 s-1", "kg km-2 d-1", "CH4"), physics.flux_factor("kg km-2 d-1", "molec cm-2 s-1", "CH4")
    assert there * back == pytest.approx(1)
    with pytest.raises(ValueError):
        physics.flux_factor("kg m-2 s-1", "mol m-2 s-1")


def test_positions(spark):
    r = one(spark, geo.wrap_lon(180.0), geo.wrap_lon(-540.5), geo.dms_to_degrees(F.lit("-40"), F.lit("30"), F.lit("0")), geo.dms_to_degrees(F.lit("x"), F.lit("1"), F.lit("1")), geo.earth_radius(0.0), geo.earth_radius(90.0))
    assert r[0] == -180 and r[1] == pytest.approx(179.5) and r[2] == pytest.approx(-39.5) and r[3] is None
    assert r[4] == pytest.approx(6378.137) and r[5] == pytest.approx(6356.752314245)
    x, y = geo.Lambert().forward(40.0, -110.0)
    lat, lon = geo.Lambert().inverse(x, y)
    assert one(spark, lat, lon) == (pytest.approx(40), pytest.approx(-110))


def test_area_of_the_globe(spark):
    cells = grid.regular_grid(spark, (-180, -90, 180, 90), 5, 5)
    total = grid.with_area(cells, 5, 5, 6371.0).agg(F.sum("area")).first()[0]
    assert cells.count() == 72 * 36 and total == pytest.approx(4 * math.pi * 6371.0**2)


def test_regrid_keeps_the_integral(spark):
    src = grid.regular_grid(spark, (-180, -90, 180, 90), 30, 30).withColumn("value", F.col("lat") + F.col("lon") / 7 + 300)
    cells = [spark.range(n).select((F.lit(lo) + step / 2 + F.col("id") * step).alias(c)).select(c, (F.col(c) - step / 2).alias("lo"), (F.col(c) + step / 2).alias("hi")) for c, lo, step, n in (("lat", -90.0, 20.0, 9), ("lon", -180.0, 24.0, 15))]
    out = grid.regrid(src, *cells, "conservative", ())
    before = grid.with_area(src, 30, 30, 1.0).agg(F.sum(F.col("value") * F.col("area"))).first()[0]
    after = grid.with_area(out, 20, 24, 1.0).agg(F.sum(F.col("value") * F.col("area"))).first()[0]
    assert after == pytest.approx(before)
    near = grid.regrid(src, *cells, "nearest", ())
    assert near.count() == 9 * 15
    line = grid.regrid(src, *cells, "bilinear", ()).filter("abs(lat) <= 75 AND abs(lon) <= 165").withColumn("want", F.col("lat") + F.col("lon") / 7 + 300)
    assert line.filter("abs(value - want) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        grid.regrid(src, *cells, "spline", ())


def test_clip_is_idempotent_and_exclusive(spark):
    g = grid.regular_grid(spark, (0, 0, 10, 10), 1, 1)
    box = grid.clip(g, bbox=(2, 2, 5, 5))
    assert box.count() == grid.clip(box, bbox=(2, 2, 5, 5)).count() == 9
    assert grid.clip(g, ring=[(0, 0), (10, 0), (0, 10)]).count() in (45, 55)
    with pytest.raises(AssertionError):
        grid.clip(g, bbox=(0, 0, 1, 1), extent=(0, 1, 0, 1))


def test_time_ranges():
    at = timeops.parse_iso
    assert at("2024-01-15T10:30") == dt.datetime(2024, 1, 15, 10)
    assert at("202412", inclusive=True) == dt.datetime(2025, 1, 1)
    assert at("2024-1") == dt.datetime(2024, 1, 1, 1)
    with pytest.raises(ValueError):
        at("x")
    r = timeops.TimeRange.of("2024-01")
    assert dt.datetime(2024, 1, 1) in r and dt.datetime(2024, 2, 1) in r and dt.datetime(2023, 12, 31) not in r
    assert dt.datetime(1900, 1, 1) in timeops.TimeRange()
    with pytest.raises(ValueError):
        timeops.TimeRange().total_seconds()


def test_rounding_is_half_even_like_pandas(spark):
    ts = [dt.datetime(2024, 1, 1, h, 30) for h in (0, 1, 2, 23)] + [dt.datetime(1969, 12, 31, 22, 29, 59)]
    df = frame(spark, [(t,) for t in ts], "ts timestamp_ntz")
    got = [r[0] for r in df.select(timeops.from_micros(timeops.rounded_micros("ts", 3_600_000_000, "round"))).collect()]
    assert got == [x.to_pydatetime() for x in pd.Series(ts).dt.round("1h")]


def test_december_belongs_to_its_winter(spark):
    rows = [(dt.datetime(2019, 12, 5), 1.0), (dt.datetime(2020, 2, 5), 3.0), (dt.datetime(2020, 10, 1), 5.0)]
    got = {(r["season"], r["year"]): r["value_mean"] for r in aggregates.seasonal(frame(spark, rows, "ts timestamp_ntz, value double"), ["value"]).collect()}
    assert got == {("DJF", 2019): 2.0, ("MAM", 2020): None, ("JJA", 2020): None, ("SON", 2020): 5.0}


def test_all_null_sums_to_zero(spark):
    df = frame(spark, [(1, 1.0, 1.0, None), (2, 1.0, 1.0, 2.0)], "time int, lat double, lon double, value double")
    assert {r["time"]: r["value"] for r in aggregates.sum_sectors(df).collect()} == {1: 0.0, 2: 2.0}


def test_baseline_halo_equals_pandas_and_windows(spark):
    rng = np.random.default_rng(3)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 6 * 86400, 400)), "s")
    v = rng.normal(size=400)
    v[::17] = np.nan
    df = frame(spark, [(x.to_pydatetime(), None if np.isnan(y) else float(y), 1) for x, y in zip(t, v, strict=True)], "ts timestamp_ntz, value double, k int")
    s = pd.Series(v, index=t)
    one_side = s.rolling("24h", center=True, min_periods=1).quantile(0.1)
    want = one_side.rolling("24h", center=True, min_periods=1).mean().sort_index()
    got = series.rolling_baseline(df, q=0.1).orderBy("ts", "value").toPandas()["baseline"].astype(float)
    assert np.allclose(np.sort(got), np.sort(want), equal_nan=True)
    keyed = series.rolling_baseline_keyed(df, ["k"], q=0.1).toPandas()["baseline"].astype(float)
    assert np.allclose(np.sort(keyed), np.sort(got), equal_nan=True)


def test_runs_and_their_filter(spark):
    day = dt.datetime(2024, 1, 1)
    flags = [5, 5, 5, None, 5, 5, 1, 5, 5, 5, 5]
    df = frame(spark, [(day + dt.timedelta(hours=12 * i), None if x is None else float(x)) for i, x in enumerate(flags)], "ts timestamp_ntz, v double")
    ev = series.runs(df, F.col("v") > 3)
    got = [(r["event_id"], r["start"], r["end"]) for r in ev.orderBy("event_id").collect()]
    assert got == [(0, day, day + dt.timedelta(hours=24 + 11, minutes=59, seconds=59)), (1, day + dt.timedelta(hours=84), day + dt.timedelta(hours=120 + 11, minutes=59, seconds=59))]
    inside, outside = (series.filter_events(df, ev, keep=k).count() for k in ("inside", "outside"))
    assert inside + outside == len(flags) and inside == 7


def test_profiles(spark):
    rows = [("a", 0, 1300.0, 1.0), ("a", 0, 1310.0, None), ("a", 0, 1320.0, 3.0)]
    df = frame(spark, rows, "station string, time int, height double, v double")
    got = {r["height"]: r["v"] for r in series.interpolate_profiles(df, ["station", "time"], ["v"], start=1290, stop=1341, interval=10).collect()}
    assert got == {1290.0: None, 1300.0: 1.0, 1310.0: 2.0, 1320.0: 3.0, 1330.0: 3.0, 1340.0: 3.0}


def test_direction_bins(spark):
    at = [0.0, 11.25, 11.26, 348.75, 348.76, 360.0, None, -0.1, 371.25, 400.0]
    got = [r[0] for r in frame(spark, [(x,) for x in at], "wd double").select(polar.direction_bin("wd")).collect()]
    assert got == [0, 0, 1, 15, 0, 0, None, None, 0, None]


def test_smooth_curve_recovers_a_cycle(spark):
    t0 = dt.datetime(2015, 1, 1)
    rows = [("a", t0 + dt.timedelta(days=7 * i), 400 + 2 * (7 * i / 365.25) + 3 * math.sin(2 * math.pi * (7 * i / 365.25))) for i in range(300)]
    out = series.thoning(frame(spark, rows, "k string, ts timestamp_ntz, value double"), ["k"]).orderBy("ts").toPandas()
    assert np.abs(out["smooth"] - [r[2] for r in rows]).max() < 0.05


def test_phase_shift_of_a_constant(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 7.0) for i in range(0, 50, 2)]
    out = series.phase_shift_baseline(frame(spark, rows, "ts timestamp_ntz, value double"), n=9, q=0.1).toPandas()
    assert len(out) == 49 and np.allclose(out["baseline"], 7.0)


def test_asof_and_nearest(spark):
    left = frame(spark, [(1, 5.0), (2, 0.5), (3, 9.0)], "id int, x double")
    right = frame(spark, [(10, 1.0), (11, 6.0), (12, 4.0)], "k int, x double")
    got = {r["id"]: r["k"] for r in series.asof(left, right, "x", ["k"]).collect()}
    assert got == {1: 12, 2: None, 3: 11}
    near = {r["id"]: r["nearest_key"] for r in series.nearest_value(left, right.withColumnRenamed("x", "y"), "x", "y", "k").collect()}
    assert near == {1: 11, 2: 10, 3: 11}


def test_names(spark):
    r = one(spark, names.sector_name(F.lit("Oil (refining) & gas, non-road")), *names.flux_file_parts(F.lit("v7.0_FT_2012_ENE.0.1x0.1.nc")), names.flux_file_parts(F.lit("TOTALS.nc"))[0], *names.inventory_variable(F.lit("emi_ch4_Supp_1B2a_Petroleum")), names.factor_variable(F.lit("a_b_c_d_e_f")), names.long_name_variable(F.lit("Oil, gas-fired plant")))
    assert tuple(r) == ("Oil__refining___gas_non_road", 2012, "ENE", None, "1B2a", "Petroleum", "e_f", "Oil_gas_fired_plant")


def test_readers(spark, tmp_path):
    (tmp_path / "flask.txt").write_text("# made\nsite datetime value qcflag\nA 2020-01-02T03:04:05Z 1.5 ...\nA - 2 ...\nA 2020-01-03T00:00:00Z 3 C..\n")
    got = readers.quality_flags(readers.read_flask(spark, str(tmp_path / "flask.txt")))
    assert [(r["datetime"], r["value"]) for r in got.collect()] == [(dt.datetime(2020, 1, 2, 3, 4, 5), "1.5")]
    for h in ("2020010100", "2020010112"):
        (tmp_path / f"SLC_{h}.csv").write_text("pressure,height,temperature\n850,1300,5\n800,,x\n")
    out = readers.read_soundings(spark, str(tmp_path), "SLC", start=dt.datetime(2020, 1, 1))
    assert {(r["time"], r["temperature"]) for r in out.collect()} == {(dt.datetime(2020, 1, 1, 12), 5.0), (dt.datetime(2020, 1, 1, 12), None)}
    sodar = readers.decode_sodar(frame(spark, [(0, 1, -9999.0), (60, 1, 25.0)], "DATTIM bigint, level int, WD double"), frame(spark, [("WD", 10)], "SHORTNAME string, MULT int"), ["WD"])
    assert [r["WD"] for r in sodar.orderBy("ts").collect()] == [None, 2.5]


def test_streams_agree_with_batches(spark, tmp_path):
    from aerolith.streaming.windows import windowed_statistics

    rows = frame(spark, [(dt.datetime(2024, 1, 1, h, m), float(h)) for h in range(3) for m in (0, 30)], "ts timestamp, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_statistics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "v", "ts")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, windowed_statistics(rows, "v", "ts").collect()))


def test_heat_deficit_of_profiles_with_nulls(spark):
    """Against plain loops: a level that is null at all times is left out, a null elsewhere makes a time null."""
    rows = []
    for time in range(3):
        for h in range(1290, 1400, 10):
            temp = None if h == 1330 or (time == 1 and h == 1350) else 12.0 - h * 0.004 * (time + 1)
            rows.append(("s", time, float(h), temp, 900.0 - (h - 1290) * 0.1, 1290.0))
    df = frame(spark, rows, "station string, time int, height double, temperature double, pressure double, elevation double")
    got = {r["time"]: r["VHD_MJ_m2"] for r in series.valley_heat_deficit(df).collect()}

    def plain(time):
        levels = [(h, None if t is None else (t + 273.15) * (1000 / p) ** (physics.RD / physics.CP), p * 100) for _, at, h, t, p, _ in rows if at == time]
        layer = [10 * physics.G / physics.RD / math.log(a[2] / b[2]) for a, b in itertools.pairwise(levels)]
        f = [(h, physics.CP * p / (physics.RD * (layer[i] + layer[i - 1]) / 2) * (levels[-1][1] - th)) for i, (h, th, p) in enumerate(levels) if 0 < i < len(layer) and th is not None]
        return sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in itertools.pairwise(f)) / 1e6

    assert got[1] is None and all(math.isclose(got[t], plain(t), rel_tol=1e-9) for t in (0, 2))
    assert not series.valley_heat_deficit(df.limit(0)).collect()


def test_phase_shift_takes_the_mean_of_repeated_times(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, 1.0), (t, 3.0), (t + dt.timedelta(seconds=1), 2.0), (None, 9.0)]
    out = series.phase_shift_baseline(frame(spark, rows, "ts timestamp_ntz, value double"), n=3, q=0.5).collect()
    assert [round(r["baseline"], 9) for r in out] == [2.0, 2.0]

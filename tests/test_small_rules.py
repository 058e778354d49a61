"""Edges of polar bins, closed sides of intervals, months of soundings, values that aren't finite."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import physics, timeops
from aerolith.operators import polar, series
from aerolith.plans import catalog
from aerolith.sources import readers


def test_polar_bins_with_given_edges(spark):
    df = spark.createDataFrame([(x, 10.0) for x in (0.0, 1.0, 1.5, 3.0, 3.1, 10.0, 11.0, -1.0, None, float("nan"))], "ws double, wd double")
    got = [(r["x_bin"], r["x_index"]) for r in polar.bin_polar(df, edges=[3, 0, 1, 10]).collect()]
    assert got == [(1.0, 1), (1.0, 1), (3.0, 2), (3.0, 2), (10.0, 3), (10.0, 3), *[(None, None)] * 4]
    for wrong in ([1], [1, 1]):
        with pytest.raises(ValueError):
            polar.bin_polar(df, edges=wrong)


def test_closed_sides(spark):
    df = spark.createDataFrame([(t,) for t in (1, 2, 3, 4)], "t int")
    held = lambda side: [r["t"] for r in df.filter(timeops.in_interval("t", F.lit(2), F.lit(4), side)).collect()]
    assert [held(s) for s in ("left", "right", "both", "neither")] == [[2, 3], [3, 4], [2, 3, 4], [3]]
    with pytest.raises(ValueError):
        timeops.in_interval("t", "t", "t", "middle")


def test_months_of_soundings(spark, tmp_path):
    for name in ("SLC_2020010100", "SLC_2020070112", "SLC_2021011500"):
        (tmp_path / f"{name}.csv").write_text("height,temperature\n1300,1.5\n")
    got = readers.read_soundings(spark, str(tmp_path), "SLC", months=(1, 2))
    assert sorted(r["time"] for r in got.collect()) == [dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 15)]


def test_baselines_pass_over_values_that_are_not_finite(spark):
    t0 = dt.datetime(2024, 1, 1)
    values = [5.0, float("inf"), 3.0, float("nan"), None, float("-inf"), 4.0, 8.0]
    df = spark.createDataFrame([("k", t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "k string, ts timestamp_ntz, value double")
    one = [r["baseline"] for r in series.rolling_baseline(df, q=0.5).orderBy("ts").collect()]
    keyed = [r["baseline"] for r in series.rolling_baseline_keyed(df, ["k"], q=0.5).orderBy("ts").collect()]
    assert one == pytest.approx(keyed) and one == pytest.approx([4.5] * 8)


def test_calm_wind_keeps_the_signs_of_zeros(spark):
    """As IEEE's atan2 has it, and DuckDB in e12_wind's SQL: of no wind at all too."""
    pairs = [(u, v) for u in (0.0, -0.0, 3.0, -3.0) for v in (0.0, -0.0, 3.0, -3.0)]
    df = spark.createDataFrame([*pairs, (None, 0.0), (-0.0, None)], "u double, v double")
    got = [r[0] for r in df.select(physics.wind_direction("u", "v")).collect()]
    assert got[:-2] == pytest.approx([(270 - math.degrees(math.atan2(v, u))) % 360 for u, v in pairs])
    assert got[-2:] == [None, None]


def test_wind_query_with_calm_rows(spark, tmp_path):
    sql = catalog.ORACLE_SQL["e12_wind"]
    spark.createDataFrame([(1, 0.0), (2, 0.005), (3, 12.34), (4, None)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT event_id, u, v, direction, east FROM ({sql})").fetchall())
    assert sorted(map(tuple, catalog.QUERIES["e12_wind"](spark, str(tmp_path)).collect())) == want and want[0][3] == 90.0


def test_quantiles_of_many_windows(monkeypatch):
    monkeypatch.setattr(series, "WINDOWS", 50)
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=300), rng.integers(0, 5, 300) / 4, np.zeros(300), rng.normal(size=1)):
        lo = np.sort(rng.integers(0, len(values) + 1, 170))
        hi = np.maximum.accumulate(np.maximum(lo, np.sort(rng.integers(0, len(values) + 1, 170))))
        for q in (0.0, 0.01, 0.5, 0.73, 1.0):
            want = [np.quantile(values[a:b], q) if b > a else np.nan for a, b in zip(lo, hi, strict=True)]
            assert np.allclose(series._quantiles(values, lo, hi, q), want, rtol=0, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("center", [True, False])
def test_baseline_tasks_hold_two_windows(spark, center):
    """A bucket and what its windows hold: not the rows of six days, and no digits lost to what lies in other days."""
    t0, hour = dt.datetime(2024, 1, 1), 3_600_000_000
    rows = [(t0 + dt.timedelta(minutes=10 * i), 1e12 if i < 144 else 0.1 + i % 3) for i in range(6 * 144)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    us = df.withColumn("_us", timeops.micros("ts"))
    held = series._by_halo(us, 24 * hour, *((12 * hour, 12 * hour) if center else (24 * hour, 0)), lambda v, order, t, mine: np.full(len(mine), float(len(t))), "value", "held")
    assert held.count() == len(rows) and held.agg(F.max("held")).first()[0] <= 2 * 144 + 1
    for bucket in (None, hour):
        got = series.rolling_baseline(df, center=center, bucket_us=bucket).orderBy("ts").collect()
        assert [(r["ts"], r["value"]) for r in got] == rows
        assert max(abs(r["baseline"] - 0.1) for r in got[3 * 144 + 1 :]) < 1e-13


def test_baseline_of_too_few_values(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h), v) for h, v in ((0, 1.0), (5, float("nan")), (6, 3.0), (200, 5.0))] + [(None, 1.0)], "ts timestamp_ntz, value double")
    got = series.rolling_baseline(df, q=0.5, min_periods=2).orderBy("ts").collect()
    assert [(r["value"], r["baseline"]) for r in got] == [(1.0, 2.0), (None, 2.0), (3.0, 2.0), (5.0, None)]

"""The NetCDF source: the three classic formats, what is read of a file, decoding, odd files, writing."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.sources import inventories as inv
from aerolith.sources import netcdf as nc


def sample(version: int, records: int = 3):
    rng = np.random.default_rng(version)
    t, y, x = np.arange(records) * 6, np.array([40.0, 41.0]), np.array([-112.0, -111.0, -110.0])
    flux = rng.normal(size=(records, 2, 3)).astype(np.float32)
    flux[:1, 1, 2] = -9999.0
    packed = rng.integers(-100, 100, (records, 2, 3))
    area = np.arange(6.0).reshape(2, 3)
    name = np.array([list("ab\0"), list("cde")], "S1")
    variables = {
        "time": (("time",), 4, {"units": "hours since 2020-02-29 06:30:00", "calendar": "standard"}, t),
        "lat": (("lat",), 6, {}, y),
        "lon": (("lon",), 6, {}, x),
        "flux": (("time", "lat", "lon"), 5, {"units": "kg m-2 s-1", "long_name": "A flux", "_FillValue": (5, [-9999.0])}, flux),
        "packed": (("time", "lat", "lon"), 3, {"scale_factor": (6, [0.5]), "add_offset": (6, [10.0])}, packed),
        "area": (("lat", "lon"), 6, {}, area),
        "site": (("lat", "length"), 2, {}, name),
    }
    if version == 5:
        variables["count"] = (("time", "lat", "lon"), 10, {}, packed.astype(np.int64) * 10**12)
    data = nc.classic_bytes({"time": records, "lat": 2, "lon": 3, "length": 3}, variables, {"title": "s"}, version, "time")
    return data, flux, packed, area, [dt.datetime(2020, 2, 29, 6, 30) + dt.timedelta(hours=6 * i) for i in range(records)]


def opened(data: bytes) -> nc.NetcdfFile:
    return nc.NetcdfFile(lambda at, n: data[at : at + n], len(data))


@pytest.mark.parametrize("version", [1, 2, 5])
def test_formats(spark, tmp_path, version):
    data, flux, packed, area, times = sample(version)
    (tmp_path / "a.nc").write_bytes(data)
    (tmp_path / "_hidden.nc").write_bytes(b"nothing")
    got = nc.read_netcdf(spark, str(tmp_path))
    assert [f.simpleString() for f in got.schema][:5] == ["time:timestamp_ntz", "lat:double", "lon:double", "flux:float", "packed:double"]
    assert inv.units_of(got, "flux") == "kg m-2 s-1"
    rows = got.orderBy("time", "lat", "lon").collect()
    assert [r["time"] for r in rows] == [t for t in times for _ in range(6)]
    assert [r["flux"] for r in rows] == [None if v == -9999 else float(v) for v in flux.ravel()]
    assert [r["packed"] for r in rows] == [0.5 * v + 10 for v in packed.ravel().tolist()]
    spread = nc.read_netcdf(spark, str(tmp_path / "a.nc"), ["flux", "area", "site"]).orderBy("time", "lat", "lon").collect()
    assert [r["area"] for r in spread] == area.ravel().tolist() * 3 and [r["site"] for r in spread] == (["ab"] * 3 + ["cde"] * 3) * 3
    long = nc.read_netcdf(spark, "file:" + str(tmp_path), ["flux"], "long").filter("value IS NOT NULL").collect()
    assert len(long) == 17 and {(r["file"], r["variable"], r["long_name"], r["units"]) for r in long} == {("a.nc", "flux", "A flux", "kg m-2 s-1")}
    picked = nc.read_netcdf(spark, str(tmp_path), schema="lon double, file string, flux double, absent int").collect()
    assert len(picked) == 18 and picked[0]["file"] == "a.nc" and picked[0]["absent"] is None
    if version == 5:
        assert {r["count"] for r in rows} == {v * 10**12 for v in packed.ravel().tolist()}


def test_only_the_asked_bytes_are_read():
    """The header, coordinates, and the asked variable's cells: not the rest of the records."""
    n, cells = 200, 3000
    dims = {"time": n, "x": cells}
    values = {v: (("time", "x"), 6, {}, np.random.default_rng(1).normal(size=(n, cells))) for v in "abcd"}
    data = nc.classic_bytes(dims, {"time": (("time",), 4, {}, np.arange(n)), **values}, {}, 2, "time")
    schema = nc.T.StructType([nc.T.StructField(n, nc.TYPES[t]) for n, t in (("time", "int"), ("x", "bigint"), ("b", "double"))])
    whole = len(data)

    def read(filters, k=0, m=1):
        f = opened(data)
        rows = sum(len(b) for b in nc.read_table(f, nc.Share("a.nc", k, m), [f.header.variables["b"]], schema, filters, False))
        return rows, f.bytes_read

    rows, got = read([])
    assert rows == n * cells and got < whole / 4 + nc.HEAD_BYTES + 8 * n
    rows, got = read([("time", ">=", 190), ("time", "<", 192)])
    assert rows == 2 * cells and got < 2 * cells * 8 + nc.HEAD_BYTES + 8 * n
    rows, got = read([("x", "==", 7)])
    assert rows == n and got < n * 16 + nc.HEAD_BYTES + 8 * n
    assert read([("time", ">", 1000)])[0] == 0 and read([("b", ">", 0.0)])[0] == n * cells
    assert sum(read([], k, 7)[0] for k in range(7)) == n * cells
    f = opened(data)
    got = np.concatenate([b.column(2).to_numpy() for k in range(3) for b in nc.read_table(f, nc.Share("a.nc", k, 3), [f.header.variables["b"]], schema, [("x", "in", (5, 2900))], False)])
    assert (got == values["b"][3][:, [5, 2900]].ravel()).all()


def test_filters_are_handed_over(spark, tmp_path):
    data, flux, *_, times = sample(2)
    (tmp_path / "a.nc").write_bytes(data)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = nc.read_netcdf(spark, str(tmp_path), ["flux"]).filter((F.col("lat") > 40.5) & F.col("lon").isin(-112.0, -111.0) & (F.col("time") <= F.lit(times[1]).cast("timestamp_ntz")))
        assert sorted(r["flux"] for r in got.collect()) == sorted(flux[:2, 1, :2].ravel().tolist())
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("units", "want"), [("days since 1850-01-01", (86_400_000_000, -120 * 365 * 86_400_000_000 - 29 * 86_400_000_000)), ("Seconds since 1970-1-1 00:00:00 UTC", (1_000_000, 0)), ("h since 1970-01-02T01:30Z", (3_600_000_000, 91_800_000_000)), ("months since 2000-01-01", None), ("m", None)])
def test_time_units(units, want):
    assert nc.time_origin({"units": units}) == want
    assert nc.time_origin({"units": units, "calendar": "noleap"}) is None


def test_odd_files(spark, tmp_path):
    """No records; one record variable without padding; no bound on the number of records; nothing asked that is there."""
    (tmp_path / "none.nc").write_bytes(sample(2, 0)[0])
    assert nc.read_netcdf(spark, str(tmp_path)).count() == 0
    alone = nc.classic_bytes({"t": 5, "x": 3}, {"v": (("t", "x"), 1, {}, np.arange(15).reshape(5, 3))}, {}, 1, "t")
    streamed = alone[:4] + b"\xff\xff\xff\xff" + alone[8:]
    for data in (alone, streamed):
        f = opened(data)
        assert f.header.record_bytes == 3 and f.header.records == 5 and f.flat(f.header.variables["v"], 1, 5).tolist() == list(range(3, 15))
    for bad in (b"", b"CD", b"CDF\x07" + bytes(40), b"\x89HDF" + bytes(40), sample(2)[0][:60]):
        with pytest.raises(ValueError, match="NetCDF"):
            opened(bad)
    cut = sample(2)[0][:-40]
    with pytest.raises(ValueError, match="the file ends"):
        f = opened(cut)
        f.flat(f.header.variables["packed"], 0, 3)
    (tmp_path / "some.nc").write_bytes(sample(2)[0])
    assert nc.read_netcdf(spark, str(tmp_path), ["packed"]).count() == 18
    with pytest.raises(Exception, match="no variable"):
        nc.read_netcdf(spark, str(tmp_path), ["missing"]).count()
    with pytest.raises(Exception, match="NetCDF files|FileNotFound"):
        nc.read_netcdf(spark, str(tmp_path / "nowhere")).count()


def test_long_headers_are_read_in_steps():
    attrs = {f"a{i}": "x" * 1000 for i in range(300)}
    data = nc.classic_bytes({"x": 2}, {"v": (("x",), 6, {}, np.array([1.0, 2.0]))}, attrs)
    f = opened(data)
    assert f.header.attrs == attrs and f.flat(f.header.variables["v"], 0, 2).tolist() == [1.0, 2.0]


def test_writing(spark, tmp_path):
    """Absent cells and nulls come back as nulls; strings, times and whole numbers keep; an overwrite replaces the files."""
    t = dt.datetime(2020, 1, 1, 0, 0, 0, 250_001)
    rows = [("p", t, 1.0, 2.5, "é", 2**60, t), ("p", t, 2.0, None, None, None, None), ("p", dt.datetime(1960, 1, 1), 1.0, math.pi, "long text", -1, t), ("q", t, 1.0, 7.0, "", 0, t)]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, x double, v double, s string, n bigint, seen timestamp_ntz").repartition(3)
    path = str(tmp_path / "out")
    nc.write_netcdf(df, path, ["time", "x"], ["k"], {"v": {"units": "K"}, "": {"title": "two"}})
    back = nc.read_netcdf(spark, path, schema="file string, time timestamp_ntz, x double, v double, s string, n bigint, seen timestamp_ntz").withColumn("k", F.regexp_extract("file", "part_(.)", 1)).drop("file")
    got = sorted((tuple(r) for r in back.select(*df.columns).collect()), key=str)
    want = sorted([*((r[0], r[1], r[2], r[3], r[4] or "", *r[5:]) for r in rows), ("p", dt.datetime(1960, 1, 1), 2.0, None, "", None, None)], key=str)
    assert got == want
    assert inv.units_of(nc.read_netcdf(spark, path), "v") == "K"
    nc.write_netcdf(df.filter("k = 'q'"), path, ["time", "x"], ["k"], mode="overwrite")
    assert nc.read_netcdf(spark, path).count() == 1 and len(list((tmp_path / "out").iterdir())) == 1
    with pytest.raises(Exception, match="null"):
        nc.write_netcdf(spark.createDataFrame([(None, 1.0)], "x double, v double"), str(tmp_path / "bad"), ["x"])
    assert not list((tmp_path / "bad").glob("*.nc"))


def test_products_from_files(spark, tmp_path):
    """Files of a flux product go through the inventory loader."""
    lat, lon = np.array([40.0, 40.1]), np.array([0.0, 359.9])
    for year, sector in ((2011, "ENE"), (2012, "AGS"), (2012, "TOTALS")):
        data = nc.classic_bytes({"lat": 2, "lon": 2}, {"lat": (("lat",), 6, {}, lat), "lon": (("lon",), 6, {}, lon), "emi_ch4": (("lat", "lon"), 5, {"units": "kg m-2 s-1"}, np.full((2, 2), float(year)))})
        (tmp_path / f"v7.0_FT2021_CH4_{year}_{sector}.0.1x0.1.nc").write_bytes(data)
    got = inv.process(nc.read_netcdf(spark, str(tmp_path), layout="long"), inv.product("edgar-v7")).collect()
    assert sorted({(r["time"].year, r["sector"], r["value"]) for r in got}) == [(2011, "ENE", 2011.0), (2012, "AGS", 2012.0)]
    assert {r["lon"] for r in got} == {0.0, -0.1} and len(got) == 8


def test_component_times(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i int, v double")
    parts = spark.createDataFrame([(i, c, x) for i, xs in ((0, (2020, 2, 29, 1, 2, 3)), (1, (2021, 1, 1, 0, 0, 0))) for c, x in enumerate(xs)], "i int, c int, value int")
    got = {r["v"]: r["time"] for r in nc.with_component_time(df, parts, ["i"], "c").collect()}
    assert got == {1.0: dt.datetime(2020, 2, 29, 1, 2, 3), 2.0: dt.datetime(2021, 1, 1), 3.0: None}


def test_a_file_is_put_together_by_records(tmp_path, monkeypatch):
    """The same bytes as from whole arrays, whatever the batches; what is held doesn't grow with the file."""
    import tracemalloc

    import pyarrow as pa

    schema = nc.T.StructType([nc.T.StructField(n, nc.TYPES[t]) for n, t in (("k", "string"), ("t", "int"), ("x", "double"), ("v", "double"), ("s", "string"), ("n", "smallint"))])

    def written(table, dims, step, name):
        w = nc.NetcdfWriter({"path": str(tmp_path / name), "dims": dims, "key": "k"}, schema, False)
        w.commit([w.write(iter(table.to_batches(step)))])
        return sorted((tmp_path / name).glob("part_a*.nc"))

    rng = np.random.default_rng(2)
    t, x = np.divmod(np.flatnonzero(rng.random(200) < 0.6), 4)
    v, text, n = rng.normal(size=len(t)), ["xyz"[: i % 4] for i in range(len(t))], np.arange(len(t)) % 50
    table = pa.table({"k": ["a"] * len(t), "t": pa.array(t, pa.int32()), "x": x * 0.5, "v": v, "s": text, "n": pa.array(n, pa.int16(), mask=n == 7)})
    times, shape = np.unique(t), (len(np.unique(t)), 4)
    at = (np.searchsorted(times, t), x)
    values, numbers, texts = np.full(shape, nc.FILLS[6]), np.full(shape, nc.FILLS[3]), np.zeros(shape, "S3")
    values[at], texts[at] = v, [s.encode() for s in text]
    numbers[at[0][n != 7], at[1][n != 7]] = n[n != 7]
    fill = lambda kind: {"_FillValue": (kind, [nc.FILLS[kind]])}
    variables = {"t": (("t",), 4, {}, times), "x": (("x",), 6, {}, np.arange(4) * 0.5), "v": (("t", "x"), 6, fill(6), values), "s": (("t", "x", "s_length"), 2, {}, texts.view("S1").reshape(*shape, 3)), "n": (("t", "x"), 3, fill(3), numbers)}
    want = nc.classic_bytes({"t": len(times), "x": 4, "s_length": 3}, variables, {}, 2, "t")
    for step in (1, 7, 1000):
        assert written(table, "t,x", step, f"step{step}")[0].read_bytes() == want
    monkeypatch.setattr(nc, "BLOCK_BYTES", 100)  # a record or two at once
    monkeypatch.setattr(nc, "SPOOL_BYTES", 100)
    assert written(table, "t,x", 1000, "small")[0].read_bytes() == want
    monkeypatch.setattr(nc, "BLOCK_BYTES", 1 << 16)
    with pytest.raises(ValueError, match="sorted"):
        written(table.take(pa.array(range(len(t) - 1, -1, -1))), "t,x", 1000, "unsorted")

    def peak(rows):
        long = pa.table({"k": ["a"] * rows, "t": pa.array(np.arange(rows), pa.int32()), "x": np.zeros(rows), "v": np.zeros(rows), "s": ["view"] * rows, "n": pa.array(np.zeros(rows), pa.int16())})
        tracemalloc.start()
        try:
            assert len(written(long, "t", 5000, f"long{rows}")) == 1
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    few, many = peak(80_000), peak(240_000)
    assert many < 1.5 * few and many < 10e6


def test_records_are_read_in_stretches():
    """Small records by whole stretches, of which a share takes its own, coordinates too."""
    n = 50_000
    variables = {"obs": (("obs",), 4, {}, np.arange(n) * 3), "v": (("obs",), 6, {}, np.arange(n) / 8), "s": (("obs", "l"), 2, {}, np.full((n, 1), b"q", "S1"))}
    data = nc.classic_bytes({"obs": n, "l": 1}, variables, {}, 2, "obs")
    reads = []
    f = nc.NetcdfFile(lambda at, k: (reads.append(k), data[at : at + k])[1], len(data))
    assert f.flat(f.header.variables["v"], 17, n).tolist() == (np.arange(17, n) / 8).tolist()  # the last record too
    reads.clear()
    schema = nc.T.StructType([nc.T.StructField(c, nc.TYPES[t]) for c, t in (("obs", "int"), ("v", "double"), ("s", "string"))])
    got = [r for b in nc.read_table(f, nc.Share("a.nc", 3, 10), [f.header.variables[c] for c in "vs"], schema, [], False) for r in b.to_pylist()]
    assert got == [{"obs": 3 * i, "v": i / 8, "s": "q"} for i in range(15_000, 20_000)]
    assert len(reads) <= 6 and sum(reads) <= 3 * len(data) / 10

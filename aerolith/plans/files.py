"""Registered queries over files that the tables are written to first (NetCDF grids, chunk stores) and in planes, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import physics
from ..operators import grid, nearest, network, overlap, polygons
from ..sources import cache, chunks, inventories, names, netcdf, shared
from .catalog import query, table


def folder(spark, tag: str) -> str:
    return f"{shared.shared_dir(spark)}/aerolith/{tag}-{uuid.uuid4().hex}"


def sales_grid(spark, d):
    """A grid of sums: months of shipping, order lines and quantities, by return flag."""
    cell = table(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), F.col("l_linenumber").cast("double").alias("lat"), F.col("l_quantity").cast("double").alias("lon"), "l_returnflag", (F.col("l_extendedprice") * 100).cast("decimal(18,0)").alias("v"))
    return cell.groupBy("time", "lat", "lon", "l_returnflag").agg(F.sum("v").cast("double").alias("flux"))


GRID_SQL = """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS time, l_linenumber::DOUBLE AS lat, l_quantity::DOUBLE AS lon, l_returnflag, sum((l_extendedprice * 100)::DECIMAL(18,0))::DOUBLE AS flux
FROM lineitem GROUP BY ALL"""


@query("s1_netcdf_grid", f"SELECT * FROM ({GRID_SQL})")
def _(spark, d):
    """Written by executors as one file a flag and year, read back in the long layout."""
    grid = sales_grid(spark, d)
    wide = grid.withColumn("year", F.year("time")).withColumnRenamed("flux", "emi")
    path = folder(spark, "netcdf")
    netcdf.write_netcdf(wide, path, ["time", "lat", "lon"], ["l_returnflag", "year"], {"emi": {"units": "kg m-2 s-1", "long_name": "sums of prices"}})
    back = netcdf.read_netcdf(spark, path, ["emi"], "long")
    return back.filter("value IS NOT NULL").select("time", "lat", "lon", F.regexp_extract("file", r"^part_([A-Z])_", 1).alias("l_returnflag"), F.col("value").alias("flux"))


@query("s1_netcdf_slice", f"""SELECT time, lat, lon, l_returnflag, flux, 'kg m-2 s-1' AS units FROM ({GRID_SQL}) WHERE time >= TIMESTAMP '1995-01-01' AND lat BETWEEN 2 AND 3""")
def _(spark, d):
    """A part of the time and one of the axes, asked of the files."""
    path = folder(spark, "netcdf")
    netcdf.write_netcdf(sales_grid(spark, d).withColumnRenamed("flux", "emi"), path, ["time", "lat", "lon"], ["l_returnflag"], {"emi": {"units": "kg m-2 s-1"}})
    back = netcdf.read_netcdf(spark, path, ["emi"], "long", split_bytes=1 << 20)
    some = back.filter((F.col("time") >= F.lit("1995-01-01").cast("timestamp_ntz")) & F.col("lat").between(2, 3) & F.col("value").isNotNull())
    return some.select("time", "lat", "lon", F.regexp_extract("file", r"^part_([A-Z])", 1).alias("l_returnflag"), F.col("value").alias("flux"), "units")


@query("s23_netcdf_observations", """
SELECT row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1 AS obs, 'site_' || (user_id % 7) AS site, ts AS time, value, event_type AS qcflag FROM events""")
def _(spark, d):
    """Observations along one dimension, with times, values and flags as characters: one file a site."""
    from pyspark.sql import Window

    events = table(spark, d, "events").select((F.col("user_id") % 7).alias("site"), "event_id", F.col("ts").cast("timestamp_ntz").alias("time"), "value", F.col("event_type").alias("qcflag"))
    numbered = events.withColumn("obs", (F.row_number().over(Window.partitionBy("site").orderBy("event_id")) - 1).cast("int")).drop("event_id")
    path = folder(spark, "observations")
    netcdf.write_netcdf(numbered, path, ["obs"], ["site"])
    back = netcdf.read_netcdf(spark, path, schema="file string, obs bigint, time timestamp_ntz, value double, qcflag string")
    return back.select("obs", F.concat(F.lit("site_"), F.regexp_extract("file", r"^part_(\d+)", 1)).alias("site"), "time", "value", "qcflag")


@query("s20_netcdf_components", """
SELECT date_trunc('second', ts) AS time, event_type AS level, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE AS ch4 FROM events GROUP BY ALL""")
def _(spark, d):
    """Mole fractions by time and level whose times are six numbers each, in a variable of its own; one file a day."""
    from pyspark.sql import Window

    cells = table(spark, d, "events").groupBy(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"), "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("ch4"))
    levels = cells.select("event_type").distinct().withColumn("level", F.row_number().over(Window.orderBy("event_type")) - 1)  # one row a type
    placed = cells.join(levels, "event_type").withColumn("day", F.to_date("at"))
    numbered = placed.withColumn("time", (F.dense_rank().over(Window.partitionBy("day").orderBy("at")) - 1).cast("int"))
    parts = F.array(*[F.date_part(F.lit(p), "at").cast("int") for p in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")])
    path = folder(spark, "molefractions")
    netcdf.write_netcdf(numbered.select("day", "time", "level", "ch4"), f"{path}/values", ["time", "level"], ["day"])
    components = numbered.select("day", "time", F.posexplode(parts).alias("calendar_component", "time_components")).distinct()
    netcdf.write_netcdf(components, f"{path}/times", ["time", "calendar_component"], ["day"])
    day = lambda df: df.withColumn("day", F.regexp_extract("file", r"^part_([\d-]{10})", 1))
    values = day(netcdf.read_netcdf(spark, f"{path}/values", ["ch4"], schema="file string, time int, level int, ch4 double")).filter("ch4 IS NOT NULL")
    times = day(netcdf.read_netcdf(spark, f"{path}/times", ["time_components"], schema="file string, time int, calendar_component int, time_components int")).withColumnRenamed("time_components", "value")
    whole = netcdf.with_component_time(values, times, ["day", "time"], "calendar_component", "when")
    return whole.join(levels, "level").select(F.col("when").alias("time"), F.col("event_type").alias("level"), "ch4")


# ---------------------------------------------------------------- chunk stores

@query("s29_chunk_points", """
WITH g AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS hour, CAST(l_partkey % 150 AS INTEGER) AS iy, CAST(l_suppkey % 90 AS INTEGER) AS ix, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS value FROM lineitem GROUP BY ALL),
 p AS (SELECT c_custkey, TIMESTAMP '1995-01-01' + to_months(CAST(c_nationkey AS INTEGER)) AS hour, 30 + (c_custkey % 997) * 0.0173::DOUBLE AS lat, -115 + (c_custkey % 1009) * 0.0091::DOUBLE AS lon FROM customer),
 q AS (SELECT *, CAST(greatest(0, least(149, floor((lat - 31) / 0.1::DOUBLE + 0.5::DOUBLE))) AS INTEGER) AS iy, CAST(greatest(0, least(89, floor((lon + 114) / 0.1::DOUBLE + 0.5::DOUBLE))) AS INTEGER) AS ix FROM p)
SELECT c_custkey, hour, value FROM q LEFT JOIN g USING (hour, iy, ix)""")
def _(spark, d):
    """Monthly fields of sums in chunks of 32 * 32, read at the customers' places and months."""
    field = table(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("hour"), (F.col("l_partkey") % 150).cast("int").alias("iy"), (F.col("l_suppkey") % 90).cast("int").alias("ix")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    grid = chunks.ChunkGrid(-114.0, 0.1, 90, 31.0, 0.1, 150, size=32)
    address = names.zarr_address("hour", "sfc", F.lit("surface"), F.lit("QTY"), "anl", F.col("_chunk"))
    path = folder(spark, "chunks")
    chunks.write_chunks(chunks.to_chunks(field, grid, address), path)
    months = F.make_ym_interval(F.lit(0), F.col("c_nationkey").cast("int"))
    points = table(spark, d, "customer").select("c_custkey", (F.lit("1995-01-01").cast("timestamp_ntz") + months).alias("hour"), (30 + (F.col("c_custkey") % 997) * F.lit(0.0173)).alias("lat"), (-115 + (F.col("c_custkey") % 1009) * F.lit(0.0091)).alias("lon"))
    return chunks.read_points(spark.read.parquet(path), points, grid, address).select("c_custkey", "hour", F.get("values", F.lit(0)).alias("value"))


@query("s29_point_winds", """
WITH g AS (SELECT CAST(hour(ts) // 6 * 6 AS INTEGER) AS h, CAST(user_id % 40 AS INTEGER) AS iy, CAST(event_id % 40 AS INTEGER) AS ix, max(CAST(event_id % 17 AS DOUBLE) - 8) AS u, max(CAST(event_id % 13 AS DOUBLE) - 6) AS v FROM events GROUP BY ALL),
 s AS (SELECT s_suppkey, CAST(s_suppkey % 4 * 6 AS INTEGER) AS h, CAST(s_suppkey % 40 AS INTEGER) AS iy, CAST(s_nationkey AS INTEGER) AS ix, -110 + s_nationkey * 0.25 AS lon FROM supplier),
 k AS (SELECT s.*, u, v, 0.622515::DOUBLE * (lon + 97.5) * 0.017453 AS a FROM s LEFT JOIN g USING (h, iy, ix))
SELECT s_suppkey, round(cos(a) * u + sin(a) * v, 6) AS u, round(-sin(a) * u + cos(a) * v, 6) AS v FROM k""")
def _(spark, d):
    """Wind components of six-hourly fields at the suppliers' places, turned from the grid to the earth."""
    ev = table(spark, d, "events").select(F.date_trunc("day", F.lit("2023-01-01").cast("timestamp_ntz")).cast("timestamp_ntz").alias("day"), (F.floor(F.hour("ts") / 6) * 6).cast("int").alias("h"), (F.col("user_id") % 40).cast("int").alias("iy"), (F.col("event_id") % 40).cast("int").alias("ix"), (F.col("event_id") % 17 - 8).cast("double").alias("UGRD"), (F.col("event_id") % 13 - 6).cast("double").alias("VGRD"))
    field = ev.groupBy("day", "h", "iy", "ix").agg(F.max("UGRD").alias("UGRD"), F.max("VGRD").alias("VGRD")).unpivot(["day", "h", "iy", "ix"], ["UGRD", "VGRD"], "variable", "value")
    hour = lambda df: df.withColumn("hour", F.col("day") + F.make_dt_interval(F.lit(0), F.col("h"), F.lit(0), F.lit(0)))
    grid = chunks.ChunkGrid(-110.0, 0.25, 40, 35.0, 0.25, 40, size=10)
    address = names.zarr_address("hour", "sfc", F.lit("10m_above_ground"), "variable", "anl", F.col("_chunk"))
    path = folder(spark, "chunks")
    chunks.write_chunks(chunks.to_chunks(hour(field), grid, address), path)
    at = table(spark, d, "supplier").select("s_suppkey", F.lit("2023-01-01").cast("timestamp_ntz").alias("day"), (F.col("s_suppkey") % 4 * 6).cast("int").alias("h"), (35 + F.col("s_suppkey") % 40 * 0.25).alias("lat"), (-110 + F.col("s_nationkey") * 0.25).alias("lon"))
    asked = names.zarr_requests(hour(at), [("10m_above_ground", "UGRD"), ("10m_above_ground", "VGRD")])
    got = chunks.read_points(spark.read.parquet(path), asked, grid, address).withColumn("value", F.get("values", F.lit(0)))
    wind = got.groupBy("s_suppkey", "lon").agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in ("UGRD", "VGRD")])
    u, v = physics.rotate_to_earth("UGRD", "VGRD", "lon")
    return wind.select("s_suppkey", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


# ---------------------------------------------------------------- the plane

@query("j3_nearest_in_plane", """
WITH s AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS x, CAST(s_suppkey * 37 % 1000 AS DOUBLE) * 10 AS y FROM supplier),
 c AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_custkey * 53 % 1000 AS DOUBLE) * 10 AS y FROM customer)
SELECT c_custkey, s_suppkey AS nearest_key, round(sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), 6) AS distance
FROM c, s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y), s_suppkey) = 1""")
def _(spark, d):
    place = lambda t, key, x, k: table(spark, d, t).select(key, F.col(x).cast("double").alias("x"), ((F.col(key) * k % 1000).cast("double") * 10).alias("y"))
    out = nearest.nearest_in_plane(place("customer", "c_custkey", "c_acctbal", 53), place("supplier", "s_suppkey", "s_acctbal", 37), "x", "y", "x", "y", "s_suppkey")
    return out.select("c_custkey", "nearest_key", F.round("distance", 6).alias("distance"))


@query("g15_reproject_conservative", """
WITH o AS (SELECT o_orderpriority AS sector, 20000.0::DOUBLE * (o_orderkey % 50) - 500000 AS x, 20000.0::DOUBLE * (o_custkey % 50) - 500000 AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
 k AS (SELECT sin(radians(38.5::DOUBLE)) AS n, tan(pi() / 4 + radians(38.5::DOUBLE) / 2) AS t0, cos(radians(38.5::DOUBLE)) AS c, 6371229.0::DOUBLE AS r),
 q AS (SELECT *, c * power(t0, n) / n AS f, r * (c * power(t0, n) / n) / power(t0, n) AS rho0 FROM k),
 e AS (SELECT sector, x, y, v, i, x + CASE WHEN i IN (0, 3) THEN -10000 ELSE 10000 END AS cx, y + CASE WHEN i < 2 THEN -10000 ELSE 10000 END AS cy FROM o, (SELECT unnest(range(4)) AS i)),
 l AS (SELECT sector, x, y, v, i, degrees(2 * atan(power(r * f / sqrt(cx * cx + (rho0 - cy) * (rho0 - cy)), 1 / n)) - pi() / 2) AS lat, 262.5 - 360 + degrees(atan2(cx, rho0 - cy)) / n AS lon FROM e, q),
 m AS (SELECT sector, x, y, v, max(lon) FILTER (i = 0) AS a0, max(lon) FILTER (i = 1) AS a1, max(lon) FILTER (i = 2) AS a2, max(lon) FILTER (i = 3) AS a3,
  max(sin(radians(lat))) FILTER (i = 0) AS s0, max(sin(radians(lat))) FILTER (i = 1) AS s1, max(sin(radians(lat))) FILTER (i = 2) AS s2, max(sin(radians(lat))) FILTER (i = 3) AS s3 FROM l GROUP BY ALL)
SELECT sector, round(sum(v * abs((a2 - a0) * (s3 - s1) - (a3 - a1) * (s2 - s0)) / 2) / 1000, 4) AS amount FROM m GROUP BY 1""")
def _(spark, d):
    """Amounts by sector after conservative reprojection to cells finer than the projected ones, against the outlines' own."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("sector"), (20000.0 * (F.col("o_orderkey") % 50) - 500000).alias("x"), (20000.0 * (F.col("o_custkey") % 50) - 500000).alias("y")).agg(F.sum("o_totalprice").alias("value"))
    out = overlap.reproject_conservative(o, inventories.projection("forecast_lambert"), 20000.0, 20000.0, 0.15, ["sector"], "conservative")
    full = 0.15 * (F.sin(F.radians(F.col("lat") + 0.075)) - F.sin(F.radians(F.col("lat") - 0.075)))
    return out.groupBy("sector").agg(F.round(F.sum(F.col("value") * full) / 1000, 4).alias("amount"))


@query("g5_polygons", """
WITH r AS (SELECT n_nationkey AS k, p, (n_nationkey % 5) * 2000.0::DOUBLE + 311 AS cx, (n_nationkey // 5) * 2000.0::DOUBLE + 713 AS cy, CASE p WHEN 0 THEN 1300.0::DOUBLE WHEN 1 THEN 600.0::DOUBLE ELSE 150.0::DOUBLE END AS s FROM nation, (SELECT unnest(range(3)) AS p)),
 c AS (SELECT k, p, i, cx + s * CASE i WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN -0.875 ELSE 0.125 END::DOUBLE AS x, cy + s * CASE i WHEN 0 THEN 0.125 WHEN 1 THEN 1.0 WHEN 2 THEN -0.25 ELSE -0.75 END::DOUBLE AS y FROM r, (SELECT unnest(range(4)) AS i)),
 e AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.k = b.k AND a.p = b.p AND b.i = (a.i + 1) % 4),
 q AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS lon, CAST(c_custkey * 53 % 1000 AS DOUBLE) * 10 AS lat FROM customer)
SELECT c_custkey, k AS n_nationkey FROM q, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1""")
def _(spark, d):
    """Customers in the nations' areas, which overlap, with a hole each and an island in it."""
    corners = ((1.0, 0.125), (0.25, 1.0), (-0.875, -0.25), (0.125, -0.75))
    cx, cy = (F.col("n_nationkey") % 5) * 2000.0 + 311, F.floor(F.col("n_nationkey") / 5) * 2000.0 + 713
    rings = F.array(*[F.array(*[F.struct((cx + s * a).alias("x"), (cy + s * b).alias("y")) for a, b in corners]) for s in (1300.0, 600.0, 150.0)])
    areas = table(spark, d, "nation").select("n_nationkey", rings.alias("rings"))
    places = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("lon"), ((F.col("c_custkey") * 53 % 1000).cast("double") * 10).alias("lat"))
    return polygons.points_in_polygons(places, areas, "n_nationkey").select("c_custkey", "n_nationkey")


@query("g13_regrid_patch", """
WITH s AS (SELECT o_orderpriority AS sector, CAST(count(*) % 7 AS DOUBLE) AS a, CAST(count(*) % 5 AS DOUBLE) AS b FROM orders GROUP BY 1),
 g AS (SELECT max(o_orderkey % 18)::DOUBLE AS y1, max(o_custkey % 36)::DOUBLE AS x1 FROM orders),
 n AS (SELECT sector, a, b, 0.4::DOUBLE + i * 1.3::DOUBLE AS lat, 0.7::DOUBLE + j * 2.1::DOUBLE AS lon FROM s, (SELECT unnest(range(13)) AS i), (SELECT unnest(range(16)) AS j))
SELECT sector, round(lat, 2) AS lat, round(lon, 2) AS lon, round(a + b * lat + 0.5::DOUBLE * lon * lat - 0.25::DOUBLE * lat * lat + a * lon * lon, 5) AS value FROM n, g WHERE lat <= y1 AND lon <= x1""")
def _(spark, d):
    """Fields of second degree over the orders' cells, whose factors follow from the number of orders: kept exactly."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("sector"), (F.col("o_orderkey") % 18).cast("double").alias("lat"), (F.col("o_custkey") % 36).cast("double").alias("lon"))
    n = F.count(F.lit(1))
    factors = o.groupBy("sector").agg((n % 7).cast("double").alias("a"), (n % 5).cast("double").alias("b"))
    cells = o.select("lat").distinct().crossJoin(o.select("lon").distinct()).crossJoin(factors)  # the grid itself
    field = cells.withColumn("value", F.col("a") + F.col("b") * F.col("lat") + 0.5 * F.col("lon") * F.col("lat") - 0.25 * F.col("lat") ** 2 + F.col("a") * F.col("lon") ** 2)
    axis = lambda k, first, step, name: spark.range(k).select((first + F.col("id") * step).alias(name))
    out = grid.regrid(field, axis(13, 0.4, 1.3, "lat"), axis(16, 0.7, 2.1, "lon"), "patch", ["sector"])
    return out.select("sector", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"), F.round("value", 5).alias("value"))


@query("w4_stream_runs", """
WITH m AS (SELECT epoch_ms(max(ts)) * 1000 - 7200000000 AS now FROM events),
 e AS (SELECT user_id, epoch_us(ts) AS t, bool_or(value > 50) AS flag FROM events, m WHERE epoch_us(ts) <= now GROUP BY ALL),
 l AS (SELECT *, lag(t) OVER w AS before, lag(flag) OVER w AS held FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 n AS (SELECT *, sum(CASE WHEN flag AND held AND t - before <= 604800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM l),
 r AS (SELECT user_id, run, min(t) AS a, max(t) AS b, count(*) AS n FROM n WHERE flag GROUP BY ALL),
 c AS (SELECT r.*, now, (SELECT min(t) FROM e WHERE e.user_id = r.user_id AND e.t > r.b) AS next FROM r, m)
SELECT user_id, make_timestamp(a) AS start, make_timestamp(b) + INTERVAL 43199 SECOND AS "end", n FROM c WHERE n >= 3 AND (next IS NOT NULL OR now - b > 604800000000)""")
def _(spark, d):
    """The users' runs of high values, found by a stream over the events and read from what it has written."""
    from ..streaming import runs

    one = table(spark, d, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    path = folder(spark, "stream")
    one.write.parquet(f"{path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.PROVIDER)
    try:
        stream = spark.readStream.schema(one.schema).parquet(f"{path}/in")
        found = runs.stream_runs(stream, F.col("value") > 50, ["user_id"], gap="7 days")
        q = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{path}/out").select("user_id", "start", "end", "n")


@query("k7_cached_result", "SELECT user_id, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events WHERE value >= 10 GROUP BY 1")
def _(spark, d):
    """Sums by user, made once and then read: the second call must not make them again."""
    results = cache.ResultCache(spark, folder(spark, "results"))
    path = f"{d}/events.parquet"

    def sums(least):
        e = spark.read.parquet(path).filter(F.col("value") >= least)
        return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))

    def never(least):
        raise AssertionError(f"the sums from {least} on were there")

    results.get("sums", sums, {"least": 10}, [path])
    return results.get("sums", never, {"least": 10}, [path])


# ---------------------------------------------------------------- line networks

_STROKES = """s AS (SELECT DISTINCT c_nationkey AS net, 4 * (c_custkey * 7919 % 2000) AS x0, 4 * (c_custkey * 104729 % 2000) AS y0,
   4 * (c_custkey * 7919 % 2000 + CASE WHEN c_custkey % 4 <> 1 THEN 1 + c_custkey * 31 % 300 ELSE 0 END) AS x1,
   4 * (c_custkey * 104729 % 2000 + CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 3 THEN -1 ELSE 1 END * (1 + c_custkey * 31 % 300)) AS y1 FROM customer),
 p AS (SELECT a.*, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1, a.x1 - a.x0 AS rx, a.y1 - a.y0 AS ry, b.x1 - b.x0 AS sx, b.y1 - b.y0 AS sy, b.x0 - a.x0 AS qx, b.y0 - a.y0 AS qy FROM s a JOIN s b ON a.net = b.net),
 m AS (SELECT *, rx * sy - ry * sx AS d, qx * sy - qy * sx AS t, qx * ry - qy * rx AS u FROM p),
 c AS (SELECT net, x0, y0, x1, y1, x0 + t * rx // d AS x, y0 + t * ry // d AS y FROM m WHERE (d > 0 AND t BETWEEN 0 AND d AND u BETWEEN 0 AND d) OR (d < 0 AND t BETWEEN d AND 0 AND u BETWEEN d AND 0)
  UNION SELECT net, x0, y0, x1, y1, u0, v0 FROM m WHERE d = 0 AND u = 0 AND u0 BETWEEN x0 AND x1 AND v0 BETWEEN least(y0, y1) AND greatest(y0, y1)
  UNION SELECT net, x0, y0, x1, y1, u1, v1 FROM m WHERE d = 0 AND u = 0 AND u1 BETWEEN x0 AND x1 AND v1 BETWEEN least(y0, y1) AND greatest(y0, y1)
  UNION SELECT net, x0, y0, x1, y1, x0, y0 FROM s UNION SELECT net, x0, y0, x1, y1, x1, y1 FROM s),
 l AS (SELECT net, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY net, x0, y0, x1, y1 ORDER BY x, y)),
 e AS (SELECT DISTINCT net, x::DOUBLE AS x0, y::DOUBLE AS y0, x2::DOUBLE AS x1, y2::DOUBLE AS y1 FROM l WHERE x2 IS NOT NULL)"""


def strokes(spark, d):
    """A stroke a customer, straight or diagonal; a nation is a network."""
    key = F.col("c_custkey")
    size, kind = 1 + key * 31 % 300, key % 4
    x, y = key * 7919 % 2000, key * 104729 % 2000
    ends = F.array(F.struct((4 * x).cast("double").alias("x"), (4 * y).cast("double").alias("y")), F.struct((4 * (x + F.when(kind != 1, size).otherwise(0))).cast("double").alias("x"), (4 * (y + F.when(kind == 0, 0).when(kind == 3, -size).otherwise(size))).cast("double").alias("y")))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("net"), ends.alias("line"))


@query("g22_split_lines", f"WITH {_STROKES} SELECT * FROM e")
def _(spark, d):
    """Lines split at all their crossings."""
    return network.split_lines(strokes(spark, d), ["net"], places=0)


@query("g22_network_parts", f"""WITH RECURSIVE {_STROKES},
 n AS (SELECT net, x0 AS x, y0 AS y, x1 AS x2, y1 AS y2 FROM e UNION SELECT net, x1, y1, x0, y0 FROM e),
 r AS (SELECT DISTINCT net, x, y, x AS px, y AS py FROM n UNION SELECT n.net, n.x2, n.y2, r.px, r.py FROM r JOIN n ON r.net = n.net AND r.x = n.x AND r.y = n.y)
SELECT net, x, y, min((px, py))[1] AS part_x, min((px, py))[2] AS part_y FROM r GROUP BY net, x, y""")
def _(spark, d):
    """Every node with the smallest node of its connected part."""
    return network.network_parts(network.split_lines(strokes(spark, d), ["net"], places=0), ["net"])


@query("g22_spaced_points")
def _(spark, d):
    """Points along the nations' networks, 100 apart at least; the choice isn't SQL's."""
    return network.points_along_network(strokes(spark, d), ["net"], 100.0, places=0)

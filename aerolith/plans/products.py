"""Registered queries of the inventory loader, reprojection, profiles and scalars, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, physics, projections, timeops
from ..operators import aggregates, grid
from ..sources import inventories, names
from .catalog import query, r6, rounded, table

# Orders as the rows of a product's files: a cell of ten degrees, the year of the order, a sector from the priority.
_RAW = """r AS (SELECT o_orderkey, -85.004::DOUBLE + 10 * (o_orderkey % 18) AS lat, 10.003::DOUBLE * (o_custkey % 36) AS lon, year(o_orderdate) AS y, o_orderdate AS t,
 replace(o_orderpriority, '-', '_') AS s, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS i, o_totalprice AS v FROM orders)"""


def _raw(spark, d: str, **cols: Column) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"s": F.translate("o_orderpriority", "-", "_"), "i": F.substring("o_orderpriority", 1, 1).cast("int"), "y": F.year("o_orderdate")})
    lat, lon = -85.004 + 10 * (F.col("o_orderkey") % 18), 10.003 * (F.col("o_custkey") % 36)
    return o.select("o_orderkey", lat.alias("lat"), lon.alias("lon"), F.col("o_totalprice").alias("value"), *[c.alias(n) for n, c in cols.items()])


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _grid(df: DataFrame) -> DataFrame:
    return rounded(df, "lat", "lon", "value")


@query("s3_edgar_v7", f"""WITH {_RAW} SELECT o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) AS time, round(round_even(lat * 100, 0) / 100, 6) AS lat,
 round(round_even(((lon + 180) % 360 - 180) * 100, 0) / 100, 6) AS lon, s AS sector, round(v, 6) AS value,
 'v7.0_FT_CH4_' || y || '_' || s || '.0.1x0.1.nc' AS file FROM r WHERE i NOT IN (4, 5)""")
def _(spark, d):
    totals, other = F.when(F.col("i") == 4, "TOTALS_").otherwise(""), F.when(F.col("i") == 5, ".txt").otherwise("")
    raw = _raw(spark, d, file=_cat("v7.0_FT_CH4_", totals, F.col("y"), "_", F.col("s"), ".0.1x0.1.nc", other))
    return _grid(inventories.process(raw, inventories.product("edgar-v7")))


@query("s8_edgar_v8", f"""WITH {_RAW} SELECT o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, 'Solid_waste_' || i || '_x' AS sector,
 round(v, 6) AS value, 'f.nc' AS file FROM r WHERE i <> 1""")
def _(spark, d):
    name = F.when(F.col("i") == 1, "Fuel exploitation").otherwise(_cat("Solid, waste-", F.col("i"), " x"))
    raw = _raw(spark, d, file=F.lit("f.nc"), long_name=name, year=F.col("y").cast("string"))
    return _grid(inventories.process(raw, inventories.product("edgar-v8")))


@query("s8_edgar_v8_monthly", f"""WITH {_RAW} SELECT o_orderkey, CAST(date_trunc('month', t) AS TIMESTAMP) AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, 'Solid_waste' AS sector, round(v, 6) AS value, 'f.nc' AS file FROM r""")
def _(spark, d):
    raw = _raw(spark, d, file=F.lit("f.nc"), long_name=F.lit("Solid waste"), time=F.col("o_orderdate"))
    return _grid(inventories.process(raw, inventories.product("edgar-v8-monthly")))


def _means(df: DataFrame) -> DataFrame:
    """Means of amounts with two places, moved off half-way values before rounding."""
    return df.withColumn("value", F.round(F.col("value") + 1e-7, 4))


def _epa(step: str, time: str, index: str):
    @query(f"s12_epa_v1_{step}", f"""WITH {_RAW} SELECT o_orderkey, {time} AS time, round(round_even(lat * 100, 0) / 100, 6) AS lat, round(round_even(lon * 100, 0) / 100, 6) AS lon, 'Name_' || chr(96 + i) AS sector,
 round(v, 6) AS value, '1B' || i || 'a' AS ipcc_code, 'f.nc' AS file FROM r WHERE i <> 3""")
    def _(spark, d):
        name = F.when(F.col("i") == 3, "grid_cell_area").otherwise(_cat("emissions_1B", F.col("i"), "a_Name_", F.chr(96 + F.col("i"))))
        raw = _raw(spark, d, file=F.lit("f.nc"), variable=name, time_index=F.expr(index))
        return _grid(inventories.process(raw, inventories.product("epa-v1" if step == "annual" else f"epa-v1-{step}")))


_epa("annual", "TIMESTAMP '2012-01-01'", "0")
_epa("monthly", "TIMESTAMP '2012-01-01' + to_months(CAST(o_orderkey % 12 AS INTEGER))", "o_orderkey % 12")
_epa("daily", "TIMESTAMP '2012-01-01' + to_days(CAST(o_orderkey % 366 AS INTEGER))", "o_orderkey % 366")


@query("s11_epa_v2", f"""WITH {_RAW} SELECT o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) AS time, round(round_even(lat * 100, 0) / 100, 6) AS lat, round(round_even(lon * 100, 0) / 100, 6) AS lon,
 CASE WHEN i = 2 THEN 'other_variable' ELSE 'Rice_Cultivation' END AS sector, round(v, 6) AS value, CASE WHEN i <> 2 THEN '3C' END AS ipcc_code, 'f.nc' AS file FROM r WHERE i <> 3""")
def _(spark, d):
    name = F.when(F.col("i") == 3, "grid_cell_area").when(F.col("i") == 2, "other_variable").otherwise("emi_ch4_Supp_3C_Rice_Cultivation")
    raw = _raw(spark, d, file=F.lit("f.nc"), variable=name, time=F.col("o_orderdate"))
    return _grid(inventories.process(raw, inventories.product("epa-v2")))


_GFEI = "Global_Fuel_Exploitation_Inventory"


@query("s13_gfei", f"""WITH {_RAW} SELECT o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) AS time, round(round_even(lat * 100, 0) / 100, 6) AS lat, round(round_even(lon * 100, 0) / 100, 6) AS lon, 'Gas_' || s AS sector, round(v, 6) AS value,
 '{_GFEI}_Gas_' || s || '.nc' AS file FROM r WHERE i > 3""")
def _(spark, d):
    tail = F.when(F.col("i") == 1, "Total_Fuel_Exploitation").when(F.col("i") == 2, "Gas_All").when(F.col("i") == 3, "Gas_rsd").otherwise(_cat("Gas_", F.col("s")))
    raw = _raw(spark, d, file=_cat(_GFEI + "_", tail, ".nc"), year=F.col("y"))
    return _grid(inventories.process(raw, inventories.product("gfei-v1")))


@query("s15_gfei_deviations", f"""WITH {_RAW} SELECT o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) AS time, round(round_even(lat * 100, 0) / 100, 6) AS lat, round(round_even(lon * 100, 0) / 100, 6) AS lon, 'Gas' AS sector, round(v, 6) AS value,
 '{_GFEI}_Gas_gsd.nc' AS file FROM r WHERE i = 4""")
def _(spark, d):
    tail = F.when(F.col("i") == 2, "All_gsd").when(F.col("i") == 3, "Gas_rsd").when(F.col("i") == 4, "Gas_gsd").otherwise("Gas")
    raw = _raw(spark, d, file=_cat(_GFEI + "_", tail, ".nc"), year=F.col("y"))
    return _grid(inventories.deviations(raw, "geometric", inventories.product("gfei-v1")))


def _vulcan(kind: str, digit: int):
    @query(f"s17_vulcan_{kind}", f"""WITH {_RAW} SELECT o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, 's' || (o_orderkey % 7) AS sector, round(v, 6) AS value,
 'a_b_US_v3_c_s' || (o_orderkey % 7) || '_{inventories.names.ESTIMATES[kind]}.nc4' AS file FROM r WHERE i = {digit} AND o_orderkey % 9 <> 0 AND o_orderkey % 5 <> 0""")
    def _(spark, d):
        k = F.col("o_orderkey")
        mark = F.when(F.col("i") == 1, "mn").when(F.col("i") == 2, "lo").when(F.col("i") == 3, "hi").otherwise("xx")
        sector = F.when(k % 9 == 0, "total").otherwise(_cat("s", k % 7))
        raw = _raw(spark, d, file=_cat("a_b_", F.when(k % 5 == 0, "AK").otherwise("US"), "_v3_c_", sector, "_", mark, ".nc4"), time=F.col("o_orderdate"))
        return _grid(inventories.estimate(raw, kind))


for _kind, _digit in (("central", 1), ("lower", 2), ("upper", 3)):
    _vulcan(_kind, _digit)


@query("s19_wetcharts", f"""WITH {_RAW} SELECT CAST(date_trunc('month', t) AS TIMESTAMP) AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, 'wetlands' AS sector, round(median(v), 6) AS value FROM r GROUP BY ALL""")
def _(spark, d):
    raw = _raw(spark, d, file=F.lit("f.nc"), time=F.col("o_orderdate"), model=F.col("s"))
    return _grid(inventories.one_model(raw, "median"))


# Annual values of three sectors, of which one is not scaled after 1998, and factors of every month.
_EXPRESS = """a AS (SELECT make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS time, CAST(o_orderkey % 6 AS DOUBLE) AS lat, CAST(o_custkey % 4 AS DOUBLE) AS lon,
 CASE o_custkey % 3 WHEN 0 THEN 'Rice_Cultivation' WHEN 1 THEN 'Field_Burning' ELSE 'Landfills' END AS sector, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
f AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time, CAST(o_orderkey % 6 AS DOUBLE) AS lat, CAST(o_custkey % 4 AS DOUBLE) AS lon,
 CASE o_custkey % 3 WHEN 0 THEN 'Rice_Cultivation' WHEN 1 THEN 'Field_Burning' ELSE 'Landfills' END AS sector, count(*) / 10.0::DOUBLE AS factor FROM orders WHERE year(o_orderdate) <= 1998 GROUP BY ALL)"""


@query("i3_express", f"""WITH {_EXPRESS}, g AS (SELECT * FROM f UNION ALL SELECT time + to_years(CAST(y AS INTEGER)) AS time, lat, lon, sector, factor FROM f, (SELECT unnest([1, 2, 3]) AS y) WHERE year(time) = 1998 AND sector <> 'Landfills')
SELECT g.time, g.lat, g.lon, g.sector, round(a.value * g.factor, 4) AS value FROM g ASOF JOIN a ON g.lat = a.lat AND g.lon = a.lon AND g.sector = a.sector AND g.time >= a.time""")
def _(spark, d):
    k = F.col("o_custkey") % 3
    sector = F.when(k == 0, "Rice_Cultivation").when(k == 1, "Field_Burning").otherwise("Landfills").alias("sector")
    where = [(F.col("o_orderkey") % 6).cast("double").alias("lat"), (F.col("o_custkey") % 4).cast("double").alias("lon"), sector]
    o = table(spark, d, "orders")
    at = lambda unit: F.date_trunc(unit, "o_orderdate").cast("timestamp_ntz").alias("time")
    annual = o.groupBy(at("year"), *where).agg(F.sum("o_totalprice").alias("value"))
    factors = o.filter("year(o_orderdate) <= 1998").groupBy(at("month"), *where).agg((F.count(F.lit(1)) / 10.0).alias("factor"))
    return rounded(inventories.express_monthly(annual, factors, 2001, 1998), "value", places=4)


@query("i7_standard_name", "SELECT p_partkey, lower(p_type) || '_' || p_brand || '_emissions' AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", names.standard_name("p_type", "p_brand").alias("name"))


@query("s10_product_path", "SELECT o_orderkey, '/d/v8/' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'monthly/' END || o_orderpriority AS path FROM orders")
def _(spark, d):
    step = F.when(F.col("o_orderstatus") == "F", "annual").otherwise("monthly")
    return table(spark, d, "orders").select("o_orderkey", inventories.product_path("/d", "v8", step, "o_orderpriority").alias("path"))


_DAYS = "x AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS time, CAST(o_orderkey % 5 AS DOUBLE) AS lat, CAST(o_custkey % 5 AS DOUBLE) AS lon, o_orderpriority AS sector, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


def _days(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderdate").alias("time"), (F.col("o_orderkey") % 5).cast("double").alias("lat"), (F.col("o_custkey") % 5).cast("double").alias("lon"), F.col("o_orderpriority").alias("sector")).agg(F.sum("o_totalprice").alias("value"))


@query("a9_time_mean", f"WITH {_DAYS} SELECT lat, lon, sector, round(avg(value) + 1e-7, 4) AS value FROM x GROUP BY ALL")
def _(spark, d):
    return _means(inventories.at_time(_days(spark, d)))


@query("a9_time_index", f"WITH {_DAYS} SELECT time, lat, lon, sector, round(value, 4) AS value FROM x WHERE time = (SELECT DISTINCT time FROM x ORDER BY time OFFSET 3 LIMIT 1)")
def _(spark, d):
    return rounded(inventories.at_time(_days(spark, d), 3), "value", places=4)


@query("a9_time_label", f"WITH {_DAYS} SELECT time, lat, lon, sector, round(value, 4) AS value FROM x WHERE year(time) = 1997")
def _(spark, d):
    return rounded(inventories.at_time(_days(spark, d), "1997"), "value", places=4)


@query("x4_any_callable", "SELECT user_id, round(max(value) - min(value), 6) AS value_range FROM events GROUP BY 1")
def _(spark, d):
    return rounded(aggregates.by_callable(table(spark, d, "events"), ["user_id"], "value", lambda v: v.max() - v.min(), "range"), "value_range")


@query("u5_standardize", f"""WITH {_RAW} SELECT o_orderkey, round(v * 1000 / 365.25::DOUBLE, 4) AS value, 'kg km-2 d-1' AS units FROM r""")
def _(spark, d):
    raw = _raw(spark, d, file=F.lit("f.nc"), year=F.col("y"), long_name=F.lit("x"))
    out = inventories.process(raw, inventories.product("edgar-v8", units="Mg km-2 a-1"), standardize=True)
    return out.select("o_orderkey", F.round("value", 4).alias("value"), F.lit(inventories.units_of(out)).alias("units"))


@query("g15_reproject", """WITH p AS (SELECT o_orderkey, o_orderpriority AS sector, o_totalprice AS v, 20000.0::DOUBLE * (o_orderkey % 50) - 500000 AS x, 20000.0::DOUBLE * (o_custkey % 50) - 500000 AS y FROM orders),
 k AS (SELECT sin(radians(38.5::DOUBLE)) AS n, tan(pi() / 4 + radians(38.5::DOUBLE) / 2) AS t0, cos(radians(38.5::DOUBLE)) AS c, 6371229.0::DOUBLE AS r),
 q AS (SELECT *, c * power(t0, n) / n AS f, r * (c * power(t0, n) / n) / power(t0, n) AS rho0 FROM k),
 l AS (SELECT sector, v, degrees(2 * atan(power(r * f / sqrt(x * x + (rho0 - y) * (rho0 - y)), 1 / n)) - pi() / 2) AS lat, 262.5 - 360 + degrees(atan2(x, rho0 - y)) / n AS lon FROM p, q)
SELECT sector, round((floor(lat / 0.5) + 0.5) * 0.5, 2) AS lat, round((floor(lon / 0.5) + 0.5) * 0.5, 2) AS lon, round(avg(v) + 1e-7, 4) AS value FROM l GROUP BY ALL""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("sector"), F.col("o_totalprice").alias("value"), (20000.0 * (F.col("o_orderkey") % 50) - 500000).alias("x"), (20000.0 * (F.col("o_custkey") % 50) - 500000).alias("y"))
    return _means(inventories.reproject(o, inventories.projection("forecast_lambert"), 0.5, ["sector"]))


@query("g13_nearest_d2s", """WITH x AS (SELECT o_orderpriority AS sector, CAST(o_orderkey % 18 AS DOUBLE) AS lat, CAST(o_custkey % 36 AS DOUBLE) AS lon, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT sector, least(floor(lat / 4) * 4 + 1.75, 17.75) AS lat, least(floor(lon / 4) * 4 + 1.75, 33.75) AS lon, round(sum(value), 4) AS value FROM x GROUP BY ALL""")
def _(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("sector"), (F.col("o_orderkey") % 18).cast("double").alias("lat"), (F.col("o_custkey") % 36).cast("double").alias("lon")).agg(F.sum("o_totalprice").alias("value"))
    axis = lambda n, name: spark.range(n).select((F.col("id") * 4 + 1.75).alias(name))
    return rounded(grid.regrid(x, axis(5, "lat"), axis(9, "lon"), "nearest_d2s", ["sector"]), "value", places=4)


@query("g11_round_positions", "SELECT o_orderkey, round_even(o_totalprice, 1) AS lat, round_even(o_totalprice / 7, 2) AS lon FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("lat"), (F.col("o_totalprice") / 7).alias("lon"))
    return grid.round_positions(o, 1, 2)


# Events as winds of stations: a level of each event, heights that the station's first profile fixes.
_WINDS = """w AS (SELECT user_id AS station, ts, event_id % 4 AS level, 50.0 * (event_id % 4 + 1) AS height, CASE WHEN event_id % 5 <> 0 THEN value END AS wd, CASE WHEN event_id % 3 <> 0 THEN value / 10 END AS ws FROM events)"""


def _winds(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("station"), "ts", (k % 4).alias("level"), (50.0 * (k % 4 + 1)).alias("HEIGHT"), F.when(k % 5 != 0, F.col("value")).alias("WD"), F.when(k % 3 != 0, F.col("value") / 10).alias("WS"))


@query("f8_winds_at_height", f"""WITH {_WINDS}, f AS (SELECT station, min(ts) AS ts FROM w GROUP BY 1), l AS (SELECT station, min(level) AS level FROM w JOIN f USING (station, ts) WHERE height = 100 GROUP BY 1)
SELECT w.station, w.ts, w.wd AS direction, round(w.ws, 6) AS speed FROM w JOIN l USING (station, level) WHERE w.wd IS NOT NULL OR w.ws IS NOT NULL""")
def _(spark, d):
    return rounded(inventories.sodar_at_height(_winds(spark, d), 100.0), "speed")


@query("s28_merge_profiles", f"""WITH {_WINDS} SELECT ts, level, round(max(wd), 6) AS "WD", round(max(ws), 6) AS "WS" FROM w WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL""")
def _(spark, d):
    import datetime as dt

    w = _winds(spark, d)
    return rounded(inventories.merge_profiles([w.select("ts", "level", "WD"), w.select("ts", "level", "WS")], dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)), "WD", "WS")


# ---------------------------------------------------------------- scalars

@query("e7_e11_inverses", """WITH x AS (SELECT l_orderkey, l_linenumber, 250 + l_quantity AS t, 50000 + l_extendedprice % 50000 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, round(t, 6) AS t_theta, round(t, 6) AS t_vapor FROM x""")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (250 + F.col("l_quantity")).alias("t"), (50000 + F.col("l_extendedprice") % 50000).alias("p"))
    theta = physics.potential_temperature("t", "p")
    return x.select("l_orderkey", "l_linenumber", r6(physics.inverse_potential_temperature("p", theta), "t_theta"), r6(physics.temperature_from_vapor(physics.saturation_pressure("t")), "t_vapor"))


@query("e1_constants", """SELECT * FROM (VALUES ('R_STAR', 6.02214076e23::DOUBLE * 1.380649e-23::DOUBLE), ('L_SUBLIMATION', 2.501e6::DOUBLE + 3.337e5::DOUBLE), ('EPSILON', 287.05::DOUBLE / 461.5::DOUBLE), ('LIGHT', 299792458.0::DOUBLE)) AS t(name, v)""")
def _(spark, d):
    some = ["R_STAR", "L_SUBLIMATION", "EPSILON", "LIGHT"]
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(getattr(physics, n)).alias("v")) for n in some])).alias("e")).select("e.*")


@query("g3_degrees", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_linenumber / 60.0::DOUBLE + l_discount * 100 / 3600.0::DOUBLE, 9) AS degrees FROM lineitem")
def _(spark, d):
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.round(geo.dms_to_degrees("l_quantity", "l_linenumber", F.col("l_discount") * 100), 9).alias("degrees"))


@query("g10_regular_grid", "SELECT round(38.5 + 0.25 + 0.5 * i, 3) AS lat, round(-112 + 0.05 + 0.1 * j, 3) AS lon FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(20)) AS j)")
def _(spark, d):
    return rounded(grid.regular_grid(spark, (-112.0, 38.5, -110.0, 41.5), 0.1, 0.5), "lat", "lon", places=3)


@query("d10_bin_edges", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS start FROM orders)
SELECT start FROM m UNION ALL SELECT max(start) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND FROM m""")
def _(spark, d):
    return timeops.bin_edges(table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("start")).distinct(), "start", "monthly")


@query("d8_zones", """SELECT event_id, ts - INTERVAL 7 HOUR AS mst, ts + INTERVAL 7 HOUR AS from_mst,
 ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver') AS denver, ((ts AT TIME ZONE 'America/Denver') AT TIME ZONE 'UTC') AS from_denver FROM events""")
def _(spark, d):
    zone = timeops.convert_zone
    return table(spark, d, "events").select("event_id", zone("ts", "MST").alias("mst"), zone("ts", "UTC", "MST").alias("from_mst"), zone("ts", "America/Denver").alias("denver"), zone("ts", "UTC", "America/Denver").alias("from_denver"))


@query("g2_projection_text", """
WITH p AS (SELECT c_custkey, 100.0::DOUBLE * (c_custkey % 9973) - 300000 AS x, 50.0::DOUBLE * CAST(c_acctbal AS DOUBLE) AS y FROM customer),
 k AS (SELECT sin(radians(38.5::DOUBLE)) AS n, tan(pi() / 4 + radians(38.5::DOUBLE) / 2) AS t0, cos(radians(38.5::DOUBLE)) AS c, 6371229.0::DOUBLE AS r),
 q AS (SELECT *, c * power(t0, n) / n AS f, r * (c * power(t0, n) / n) / power(t0, n) AS rho0 FROM k)
SELECT c_custkey, round(degrees(2 * atan(power(r * f / sqrt((x - 7000) * (x - 7000) + (rho0 - (y + 500)) * (rho0 - (y + 500))), 1 / n)) - pi() / 2), 6) AS lat,
 round(262.5 - 360 + degrees(atan2(x - 7000, rho0 - (y + 500))) / n, 6) AS lon FROM p, q""")
def _(spark, d):
    """Places in a plane whose projection is given as text, and kept with the columns."""
    text = "+proj=lcc +lat_1=38.5 +lat_2=38.5 +lat_0=38.5 +lon_0=262.5 +x_0=7000 +y_0=-500 +R=6371229 +units=m +no_defs"
    at = table(spark, d, "customer").select("c_custkey", (F.lit(100.0) * (F.col("c_custkey") % 9973) - 300000).alias("x"), (50.0 * F.col("c_acctbal").cast("double")).alias("y"))
    return rounded(projections.to_degrees(projections.with_projection(at, text)).select("c_custkey", "lat", "lon"), "lat", "lon")


@query("k1_sounding_dates_of_events", """
WITH r AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) AS b FROM events)
SELECT t AS time FROM (SELECT unnest(generate_series(a, b, INTERVAL 12 HOUR)) AS t FROM r) WHERE day(t) <> 31""")
def _(spark, d):
    """12-hourly times over the span of the events."""
    first = table(spark, d, "events").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").cast("timestamp_ntz").alias("b")).first()
    return names.sounding_dates(spark, first["a"], first["b"]).filter("day(time) <> 31")


@query("g10_grid_of_orders", """
WITH b AS (SELECT floor(min(o_totalprice) / 1000)::DOUBLE AS x0, floor(max(o_totalprice) / 1000)::DOUBLE AS x1, min(o_custkey % 89)::DOUBLE AS y0, max(o_custkey % 89)::DOUBLE AS y1 FROM orders)
SELECT round(y0 + 2.0::DOUBLE + 4.0::DOUBLE * i, 3) AS lat, round(x0 + 2.5::DOUBLE + 5.0::DOUBLE * j, 3) AS lon
FROM b, (SELECT unnest(range(1000)) AS i), (SELECT unnest(range(1000)) AS j) WHERE i < ceil((y1 - y0) / 4 - 1e-9) AND j < ceil((x1 - x0) / 5 - 1e-9)""")
def _(spark, d):
    """Centres of a regular grid over the orders' box."""
    y = F.col("o_custkey") % 89
    b = table(spark, d, "orders").agg(F.floor(F.min("o_totalprice") / 1000).cast("double").alias("x0"), F.floor(F.max("o_totalprice") / 1000).cast("double").alias("x1"), F.min(y).cast("double").alias("y0"), F.max(y).cast("double").alias("y1")).first()
    return rounded(grid.regular_grid(spark, (b["x0"], b["y0"], b["x1"], b["y1"]), 5.0, 4.0), "lat", "lon", places=3)

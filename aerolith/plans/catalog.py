"""The registered queries of the library's own operators, with the DuckDB SQL that gives the same rows.

The tables have no weather in them, so each query derives what it needs (directions, pressures, cells) from their
numbers. Rounded values keep six places where engines differ in the last bits of sums; baselines, whose values often lie
half-way between two roundings, are moved by 1e-11 first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, physics, timeops
from ..operators import aggregates, grid, polar, series
from ..sources import names, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- time

@query("a1_diurnal", """
SELECT strftime(date_trunc('hour', ts), '%H:%M:%S') AS time, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std,
       round(median(value), 6) AS value_median, count(value) AS value_count
FROM events GROUP BY 1""")
def _(spark, d):
    out = aggregates.diurnal(table(spark, d, "events"), ["value"], statistic=["mean", "std", "median", "count"])
    return rounded(out, "value_mean", "value_std", "value_median")


@query("a1_diurnal_round", """
WITH u AS (SELECT epoch_us(ts) AS us, value FROM events),
 l AS (SELECT us - us % 900000000 AS low, us, value FROM u),
 b AS (SELECT CASE WHEN 2 * (us - low) > 900000000 OR (2 * (us - low) = 900000000 AND (low // 900000000) % 2 = 1) THEN low + 900000000 ELSE low END AS us, value FROM l)
SELECT strftime(make_timestamp(us), '%H:%M:%S') AS time, round(sum(value), 4) AS value_sum, max(value) AS value_max FROM b GROUP BY 1""")
def _(spark, d):
    out = aggregates.diurnal(table(spark, d, "events"), ["value"], freq_us=900_000_000, statistic=["sum", "max"], method="round")
    return rounded(out, "value_sum", places=4)


@query("a10_diurnal_min_count", """
SELECT strftime(date_trunc('hour', ts), '%H:%M:%S') AS time, CASE WHEN count(value) >= 400 THEN round(avg(value), 6) END AS value_mean
FROM events GROUP BY 1""")
def _(spark, d):
    return rounded(aggregates.diurnal(table(spark, d, "events"), ["value"], min_count=400), "value_mean")


@query("a2_seasonal", """
WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS DATE) AS quarter, o_totalprice FROM orders WHERE month(o_orderdate) <> 4),
 s AS (SELECT CAST(unnest(generate_series(min(quarter), max(quarter), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM q),
 a AS (SELECT quarter, avg(o_totalprice) AS m, count(o_totalprice) AS n FROM q GROUP BY 1)
SELECT CASE month(s.quarter) WHEN 12 THEN 'DJF' WHEN 3 THEN 'MAM' WHEN 6 THEN 'JJA' ELSE 'SON' END AS season, CAST(year(s.quarter) AS BIGINT) AS year,
       round(m, 4) AS o_totalprice_mean, n AS o_totalprice_count FROM s LEFT JOIN a USING (quarter)""")
def _(spark, d):
    out = aggregates.seasonal(table(spark, d, "orders").filter("month(o_orderdate) <> 4"), ["o_totalprice"], "o_orderdate", ["mean", "count"])
    return rounded(out, "o_totalprice_mean", places=4).withColumn("year", F.col("year").cast("bigint"))


@query("a2_seasonal_all", """
WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS DATE) AS quarter, o_totalprice FROM orders),
 s AS (SELECT CAST(unnest(generate_series(min(quarter), max(quarter), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM q),
 a AS (SELECT quarter, avg(o_totalprice) AS m, count(o_totalprice) AS n FROM q GROUP BY 1)
SELECT CASE month(s.quarter) WHEN 12 THEN 'DJF' WHEN 3 THEN 'MAM' WHEN 6 THEN 'JJA' ELSE 'SON' END AS season, CAST(year(s.quarter) AS BIGINT) AS year,
       round(m, 4) AS o_totalprice_mean, n AS o_totalprice_count FROM s LEFT JOIN a USING (quarter)""")
def _(spark, d):
    out = aggregates.seasonal(table(spark, d, "orders"), ["o_totalprice"], "o_orderdate", ["mean", "count"])
    return rounded(out, "o_totalprice_mean", places=4).withColumn("year", F.col("year").cast("bigint"))


@query("a11_seasonal_pivot", """
WITH q AS (SELECT date_trunc('quarter', o_orderdate + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS q, o_totalprice AS v FROM orders)
SELECT CAST(year(q) AS BIGINT) AS year,
 round(avg(v) FILTER (month(q) = 12), 4) AS "DJF_mean", round(stddev_samp(v) FILTER (month(q) = 12), 4) AS "DJF_std",
 round(avg(v) FILTER (month(q) = 3), 4) AS "MAM_mean", round(stddev_samp(v) FILTER (month(q) = 3), 4) AS "MAM_std",
 round(avg(v) FILTER (month(q) = 6), 4) AS "JJA_mean", round(stddev_samp(v) FILTER (month(q) = 6), 4) AS "JJA_std",
 round(avg(v) FILTER (month(q) = 9), 4) AS "SON_mean", round(stddev_samp(v) FILTER (month(q) = 9), 4) AS "SON_std"
FROM q GROUP BY 1""")
def _(spark, d):
    out = aggregates.seasonal_pivot(table(spark, d, "orders"), "o_totalprice", "o_orderdate")
    return rounded(out, *[c for c in out.columns if c != "year"], places=4).withColumn("year", F.col("year").cast("bigint"))


@query("a3_well_mixed", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, value FROM events WHERE hour(ts) IN (12, 13, 14, 15, 16) AND user_id % 40 = 1),
 g AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT day, round(m, 6) AS value FROM g LEFT JOIN (SELECT day, avg(value) AS m FROM s GROUP BY 1) USING (day)""")
def _(spark, d):
    return rounded(aggregates.well_mixed(table(spark, d, "events").filter("user_id % 40 = 1"), "value"), "value")


@query("a3_well_mixed_all", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, value FROM events WHERE hour(ts) IN (12, 13, 14, 15, 16)),
 g AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT day, round(m, 6) AS value FROM g LEFT JOIN (SELECT day, avg(value) AS m FROM s GROUP BY 1) USING (day)""")
def _(spark, d):
    return rounded(aggregates.well_mixed(table(spark, d, "events"), "value"), "value")


@query("d5_decimal_year", """
WITH x AS (SELECT event_id, ts, make_timestamp(year(ts), 1, 1, 0, 0, 0) AS j, dayofyear(make_date(year(ts), 12, 31)) AS n FROM events)
SELECT event_id, round(year(ts) + (epoch_us(ts) - epoch_us(j)) / 1e6::DOUBLE / (86400.0::DOUBLE * n), 9) AS year, ts AS back FROM x""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", timeops.decimal_year("ts").alias("y"))
    near = F.abs(timeops.micros(timeops.from_decimal_year("y")) - timeops.micros("ts")) < 100  # a double has some 10 us here
    return e.select("event_id", F.round("y", 9).alias("year"), F.when(near, F.col("ts")).alias("back"))


@query("d7_time_zones", """
SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS denver, ts - INTERVAL 7 HOUR AS mst FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", timeops.convert_zone("ts", "America/Denver").alias("denver"), timeops.convert_zone("ts", "MST").alias("mst"))


@query("d9_intervals", """
SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS month_stop, o_orderdate + INTERVAL 1 YEAR AS year_stop,
       CAST(day(last_day(o_orderdate)) * 86400 AS BIGINT) AS month_s, CAST(dayofyear(make_date(year(o_orderdate), 12, 31)) * 86400 AS BIGINT) AS year_s FROM orders""")
def _(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", timeops.interval_stop(t, "monthly").alias("month_stop"), timeops.interval_stop(t, "annual").alias("year_stop"), timeops.seconds_in_step(t, "monthly").cast("bigint").alias("month_s"), timeops.seconds_in_step(t, "annual").cast("bigint").alias("year_s"))


@query("d11_time_decay", """
SELECT a.user_id, a.ts AS i, b.ts AS j, round(exp(-abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6::DOUBLE / 86400.0::DOUBLE), 9) AS weight
FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'error' AND b.event_type = 'error'""")
def _(spark, d):
    return rounded(series.difference_pairs(table(spark, d, "events").filter("event_type = 'error'"), ["user_id"], decay_s=86400.0), "weight", places=9)


@query("d11_time_decay_day", """
SELECT a.user_id, a.ts AS i, b.ts AS j, round(exp(-abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6::DOUBLE / 86400.0::DOUBLE), 9) AS weight
FROM events a JOIN events b ON a.user_id = b.user_id WHERE abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 86400000000""")
def _(spark, d):
    return rounded(series.difference_pairs(table(spark, d, "events"), ["user_id"], decay_s=86400.0, within_us=86_400_000_000), "weight", places=9)


@query("d3_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-13'")
def _(spark, d):
    return table(spark, d, "events").filter(timeops.TimeRange.of(start="2024-01-10", stop="2024-01-12").condition("ts")).select("event_id", "ts")


# ---------------------------------------------------------------- sequences

@query("w1_baseline_keyed", """
WITH u AS (SELECT event_id, user_id, value, epoch_us(ts) AS us FROM events),
 l AS (SELECT *, quantile_cont(value, 0.01) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND 43200000000 FOLLOWING) AS low FROM u)
SELECT event_id, round(avg(low) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND 43200000000 FOLLOWING) + 1e-11, 9) AS baseline FROM l""")
def _(spark, d):
    return series.rolling_baseline_keyed(table(spark, d, "events"), ["user_id"]).select("event_id", F.round(F.col("baseline") + 1e-11, 9).alias("baseline"))


@query("w1_baseline_series", """
WITH u AS (SELECT ts, value, epoch_us(ts) AS us FROM events),
 l AS (SELECT *, quantile_cont(value, 0.01) OVER (ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND 43200000000 FOLLOWING) AS low FROM u)
SELECT ts, value, round(avg(low) OVER (ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND 43200000000 FOLLOWING) + 1e-11, 9) AS baseline FROM l""")
def _(spark, d):
    return series.rolling_baseline(table(spark, d, "events")).select("ts", "value", F.round(F.col("baseline") + 1e-11, 9).alias("baseline"))


@query("w1_baseline_trailing", """
WITH u AS (SELECT ts, value, epoch_us(ts) AS us FROM events),
 l AS (SELECT *, quantile_cont(value, 0.01) OVER (ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS low FROM u)
SELECT ts, value, round(avg(low) OVER (ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) + 1e-11, 9) AS baseline FROM l""")
def _(spark, d):
    return series.rolling_baseline(table(spark, d, "events"), center=False).select("ts", "value", F.round(F.col("baseline") + 1e-11, 9).alias("baseline"))


_HOURS = "h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1)"
_RUNS = f"""{_HOURS},
 f AS (SELECT ts, coalesce(v > 50, false) AS flag FROM h),
 t AS (SELECT ts, flag, coalesce(CAST(flag <> lag(flag) OVER (ORDER BY ts) AS INT), 0) AS turn FROM f),
 r AS (SELECT ts, flag, sum(turn) OVER (ORDER BY ts) AS run FROM t),
 e AS (SELECT min(ts) AS "start", max(ts) + INTERVAL '11:59:59' HOUR TO SECOND AS "end" FROM r WHERE flag GROUP BY run HAVING count(*) >= 3)"""
_RUNS = _RUNS.replace("INTERVAL '11:59:59' HOUR TO SECOND", "INTERVAL 43199 SECOND")


def _events_found(spark, d):
    hours = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("v"))
    return series.runs(hours, F.col("v") > 50)


@query("w4_runs", f"""WITH {_RUNS} SELECT row_number() OVER (ORDER BY "start") - 1 AS event_id, "start", "end" FROM e""")
def _(spark, d):
    return _events_found(spark, d)


@query("j5_outside_events", f"""WITH {_RUNS} SELECT event_id, ts FROM events x WHERE NOT EXISTS (SELECT 1 FROM e WHERE x.ts BETWEEN e."start" AND e."end")""")
def _(spark, d):
    return series.filter_events(table(spark, d, "events"), _events_found(spark, d)).select("event_id", "ts")


@query("j4_inside_events", f"""WITH {_RUNS} SELECT event_id, ts FROM events x WHERE EXISTS (SELECT 1 FROM e WHERE x.ts BETWEEN e."start" AND e."end")""")
def _(spark, d):
    return series.filter_events(table(spark, d, "events"), _events_found(spark, d), keep="inside").select("event_id", "ts")


@query("j2_asof", """
WITH e AS (SELECT user_id, ts, max(value) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT c.event_id, c.user_id, c.ts, e.last_error FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN e ON c.user_id = e.user_id AND c.ts >= e.ts""")
def _(spark, d):
    e = table(spark, d, "events")
    errors = e.filter("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("value").alias("last_error"))
    return series.asof(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), errors, "ts", ["last_error"], ["user_id"])


@query("j3_nearest", """
WITH s AS (SELECT s_acctbal AS x, min(s_suppkey) AS k FROM supplier GROUP BY 1),
 r AS (SELECT c_custkey, k, x, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - x), k) AS n FROM customer, s)
SELECT c_custkey, k AS nearest_key, x AS nearest_value FROM r WHERE n = 1""")
def _(spark, d):
    return series.nearest_value(table(spark, d, "customer"), table(spark, d, "supplier"), "c_acctbal", "s_acctbal", "s_suppkey").select("c_custkey", "nearest_key", "nearest_value")


_PROFILE = "p AS (SELECT user_id % 50 AS station, CAST(floor(value) AS DOUBLE) AS height, avg(CAST(event_id % 100 AS DOUBLE)) AS v FROM events GROUP BY 1, 2)"


def _profile(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("station"), F.floor("value").cast("double").alias("height")).agg(F.avg((F.col("event_id") % 100).cast("double")).alias("v"))


@query("w5_profile_interpolation", f"""
WITH {_PROFILE}, g AS (SELECT DISTINCT station, h FROM p, (SELECT CAST(unnest(range(50, 450, 25)) AS DOUBLE) AS h)),
 x AS (SELECT g.station, g.h, (SELECT max(height) FROM p WHERE p.station = g.station AND p.height <= g.h) AS lo, (SELECT min(height) FROM p WHERE p.station = g.station AND p.height >= g.h) AS hi FROM g)
SELECT x.station, x.h AS height, round(CASE WHEN lo IS NULL THEN NULL WHEN hi IS NULL OR hi = lo THEN a.v ELSE a.v + (b.v - a.v) * (x.h - lo) / (hi - lo) END, 6) AS v
FROM x LEFT JOIN p a ON a.station = x.station AND a.height = lo LEFT JOIN p b ON b.station = x.station AND b.height = hi""")
def _(spark, d):
    return rounded(series.interpolate_profiles(_profile(spark, d), ["station"], ["v"], start=50, stop=450, interval=25), "v")


@query("w7_trapezoid", f"""
WITH {_PROFILE}, l AS (SELECT *, lag(v) OVER w AS v0, lag(height) OVER w AS h0 FROM p WINDOW w AS (PARTITION BY station ORDER BY height))
SELECT station, round(sum((v + v0) / 2 * (height - h0)), 4) AS integral FROM l GROUP BY 1""")
def _(spark, d):
    return rounded(series.trapezoid(_profile(spark, d), ["station"], "height", "v"), "integral", places=4)


def _cube(spark, d):
    stations = table(spark, d, "events").select((F.col("user_id") % 20).alias("station"), (F.col("event_id") % 5).alias("time")).distinct()
    h = F.explode(F.sequence(F.lit(1200), F.lit(2400), F.lit(10)))
    return stations.withColumn("height", h).withColumn("height", F.col("height").cast("double")).select("station", "time", "height", F.lit(1288.0).alias("elevation"), (1013 * F.exp(-F.col("height") / 8000)).alias("pressure"), (15 - F.col("height") * 0.0065 + F.col("station") * 0.1 + F.col("time") * 0.001 * (F.col("height") - 1200) / 100).alias("temperature"))


@query("vhd_valley_heat_deficit", """
WITH s AS (SELECT DISTINCT user_id % 20 AS station, event_id % 5 AS time FROM events),
 c AS (SELECT station, time, CAST(h AS DOUBLE) AS height FROM s, (SELECT unnest(range(1290, 2201, 10)) AS h)),
 p AS (SELECT *, 101300 * exp(-height / 8000) AS p, 273.15::DOUBLE + (15 - height * 0.0065::DOUBLE + station * 0.1::DOUBLE + time * 0.001::DOUBLE * (height - 1200) / 100) AS t FROM c),
 th AS (SELECT *, t * pow(1e5::DOUBLE / p, 287.05::DOUBLE / 1005.0::DOUBLE) AS th FROM p),
 l AS (SELECT *, 10 * 9.81::DOUBLE / 287.05::DOUBLE / ln(p / lead(p) OVER w) AS layer, max_by(th, height) OVER (PARTITION BY station, time) AS top FROM th WINDOW w AS (PARTITION BY station, time ORDER BY height)),
 v AS (SELECT *, (layer + lag(layer) OVER w) / 2 AS tv FROM l WINDOW w AS (PARTITION BY station, time ORDER BY height)),
 f AS (SELECT *, 1005.0::DOUBLE * p / (287.05::DOUBLE * tv) * (top - th) AS f FROM v WHERE tv IS NOT NULL),
 z AS (SELECT *, (f + lag(f) OVER w) / 2 * (height - lag(height) OVER w) AS piece FROM f WINDOW w AS (PARTITION BY station, time ORDER BY height))
SELECT station, time, round(sum(piece) / 1e6, 6) AS "VHD_MJ_m2" FROM z GROUP BY 1, 2""")
def _(spark, d):
    return rounded(series.valley_heat_deficit(_cube(spark, d)), "VHD_MJ_m2")


@query("vhd_of_events", """
WITH c AS (SELECT user_id % 20 AS station, CAST(ts AS DATE) AS time, 1300.0::DOUBLE + 10 * (event_id % 30) AS height, max(CASE WHEN event_type <> 'error' THEN value END) / 10 AS temp FROM events GROUP BY ALL),
 p AS (SELECT *, 101300 * exp(-height / 8000) AS p, temp + 273.15::DOUBLE AS t FROM c),
 th AS (SELECT *, t * pow(1e5::DOUBLE / p, 287.05::DOUBLE / 1005.0::DOUBLE) AS th FROM p),
 l AS (SELECT *, 10 * 9.81::DOUBLE / 287.05::DOUBLE / ln(p / lead(p) OVER w) AS layer, last(th) OVER (PARTITION BY station, time ORDER BY height ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM th WINDOW w AS (PARTITION BY station, time ORDER BY height)),
 v AS (SELECT *, (layer + lag(layer) OVER w) / 2 AS tv FROM l WINDOW w AS (PARTITION BY station, time ORDER BY height)),
 f AS (SELECT *, 1005.0::DOUBLE * p / (287.05::DOUBLE * tv) * (top - th) AS f FROM v),
 u AS (SELECT * FROM f WHERE height IN (SELECT height FROM f WHERE f IS NOT NULL)),
 z AS (SELECT *, (f + lag(f) OVER w) / 2 * (height - lag(height) OVER w) AS piece FROM u WINDOW w AS (PARTITION BY station, time ORDER BY height))
SELECT station, time, round(CASE WHEN count(*) = count(f) THEN sum(piece) END / 1e6, 6) AS "VHD_MJ_m2" FROM z GROUP BY 1, 2""")
def _(spark, d):
    """Profiles of all events, a station and day each, with gaps and nulls."""
    height = F.lit(1300.0) + 10 * (F.col("event_id") % 30)
    temp = F.max(F.when(F.col("event_type") != "error", F.col("value"))) / 10
    c = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("station"), F.to_date("ts").alias("time"), height.alias("height")).agg(temp.alias("temperature"))
    return rounded(series.valley_heat_deficit(c.withColumn("pressure", 1013 * F.exp(-F.col("height") / 8000)).withColumn("elevation", F.lit(1290.0))), "VHD_MJ_m2")


def _phase_shift_sql(n: int, q: float) -> str:
    """Blackman's weights from their formula; a row's neighbours by lags within its day."""
    import math

    h = n // 2
    w = {k: 0.42 - 0.5 * math.cos(2 * math.pi * (k + h) / (n - 1)) + 0.08 * math.cos(4 * math.pi * (k + h) / (n - 1)) for k in range(-h, h + 1)}
    near = {k: f"lag(top, {k}) OVER w" if k > 0 else f"lead(top, {-k}) OVER w" if k else "top" for k in w}
    num = " + ".join(f"coalesce({near[k]}, 0) * {w[k]!r}::DOUBLE" for k in w)
    den = " + ".join(f"(CASE WHEN {near[k]} IS NULL THEN 0 ELSE {w[k]!r}::DOUBLE END)" for k in w)
    window = lambda f, way: f"{f} OVER (PARTITION BY day ORDER BY ts ROWS BETWEEN {f'{n - 1} PRECEDING AND CURRENT ROW' if way < 0 else f'CURRENT ROW AND {n - 1} FOLLOWING'})"
    return f"""WITH e AS (SELECT date_trunc('second', ts)::TIMESTAMP AS ts, avg(value) AS value FROM events GROUP BY 1),
 g AS (SELECT day, unnest(generate_series(lo, hi, INTERVAL 1 SECOND)) AS ts FROM (SELECT CAST(ts AS DATE) AS day, min(ts) AS lo, max(ts) AS hi FROM e GROUP BY 1)),
 v AS (SELECT day, ts, value FROM g LEFT JOIN e USING (ts)),
 b AS (SELECT day, ts, {window(f"quantile_cont(value, {q})", -1)} AS trail, {window(f"quantile_cont(value, {q})", 1)} AS ahead FROM v),
 t AS (SELECT day, ts, greatest({window("max(ahead)", -1)}, {window("max(trail)", 1)}) AS top FROM b),
 s AS (SELECT ts, {num} AS num, {den} AS den FROM t WINDOW w AS (PARTITION BY day ORDER BY ts))
SELECT ts, round(num / den, 6) AS baseline FROM s WHERE den > 1e-12"""


@query("w2_phase_shift_short", _phase_shift_sql(15, 0.1))
def _(spark, d):
    """Baselines of a quarter of a minute around all events."""
    e = table(spark, d, "events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "value").groupBy("ts").agg(F.avg("value").alias("value"))
    return rounded(series.phase_shift_baseline(e, n=15, q=0.1).filter("baseline IS NOT NULL AND NOT isnan(baseline)"), "baseline")


@query("w2_phase_shift")
def _(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "value").groupBy("ts").agg(F.avg("value").alias("value"))
    return series.phase_shift_baseline(e, n=600, q=0.1)


@query("w3_thoning")
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("value"))
    return series.thoning(o, ["o_orderpriority"])


# ---------------------------------------------------------------- wind and air

def _wind(spark, d):
    return table(spark, d, "events").select("event_id", "value", (F.col("value") / 20).alias("ws"), F.pmod(F.floor(F.col("value") * 100) * 37 / 100, F.lit(360.0)).alias("wd"))


_WIND = "w AS (SELECT event_id, value, value / 20 AS ws, ((floor(value * 100) * 37 / 100) % 360) AS wd FROM events)"
_BINS = f"""{_WIND}, m AS (SELECT min(ws) AS lo, (max(ws) - min(ws)) / 29 AS step FROM w),
 b AS (SELECT value, CAST(ceil((wd - 11.25::DOUBLE) / 22.5::DOUBLE) AS BIGINT) % 16 AS s, CAST(least(29, greatest(1, ceil((ws - lo) / step))) AS BIGINT) AS x_index FROM w, m)"""


@query("p2_polar_frequency", f"""WITH {_BINS} SELECT round(s * radians(22.5::DOUBLE), 6) AS radian, x_index, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM b GROUP BY s, x_index""")
def _(spark, d):
    return rounded(polar.polar_frequency(polar.bin_polar(_wind(spark, d))), "radian", "percent").withColumn("x_index", F.col("x_index").cast("bigint"))


@query("a6_polar_aggregate", f"""WITH {_BINS}, a AS (SELECT s, x_index, avg(value) AS m, count(*) AS n FROM b GROUP BY 1, 2),
 g AS (SELECT s, x_index FROM (SELECT DISTINCT s FROM a), (SELECT unnest(range(1, 30)) AS x_index))
SELECT round(s * radians(22.5::DOUBLE), 6) AS radian, x_index, CASE WHEN n > 1 THEN round(m, 6) END AS stat, coalesce(n, 0) AS n FROM g LEFT JOIN a USING (s, x_index)""")
def _(spark, d):
    return rounded(polar.polar_aggregate(polar.bin_polar(_wind(spark, d)), "value", F.avg("value")), "radian", "stat").withColumn("x_index", F.col("x_index").cast("bigint"))


@query("e12_wind", f"""WITH {_WIND}, c AS (SELECT event_id, ws, -ws * sin(radians(wd)) AS u, -ws * cos(radians(wd)) AS v FROM w)
SELECT event_id, round(u, 6) AS u, round(v, 6) AS v, round(((270 - degrees(atan2(v, u))) % 360 + 360) % 360, 4) AS direction,
 round(cos(0.622515::DOUBLE * 2.5::DOUBLE * 0.017453::DOUBLE) * u + sin(0.622515::DOUBLE * 2.5::DOUBLE * 0.017453::DOUBLE) * v, 6) AS east FROM c""")
def _(spark, d):
    u, v = physics.wind_components("ws", "wd")
    w = _wind(spark, d).select("event_id", u.alias("u"), v.alias("v"))
    return w.select("event_id", r6("u", "u"), r6("v", "v"), F.round(physics.wind_direction("u", "v"), 4).alias("direction"), r6(physics.rotate_to_earth("u", "v", -95.0)[0], "east"))


@query("e3_thermodynamics", """
WITH a AS (SELECT l_orderkey, l_linenumber, 250 + l_quantity AS t, 50000 + l_extendedprice % 50000 AS p, l_discount / 10 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(t * pow(1e5::DOUBLE / p, 287.05::DOUBLE / 1005.0::DOUBLE), 6) AS theta, round(t * (1 + 0.61::DOUBLE * q), 6) AS tv,
 round(2.53e11::DOUBLE * exp(-5420.0::DOUBLE / t), 4) AS es, round(3.41e11::DOUBLE * exp(-6130.0::DOUBLE / t), 4) AS es_ice,
 round(287.05::DOUBLE / 461.5::DOUBLE * (2.53e11::DOUBLE * exp(-5420.0::DOUBLE / t)) / p, 9) AS w, round(p / (287.05::DOUBLE * t), 6) AS rho,
 round(287.05::DOUBLE * t / 9.81::DOUBLE * ln(1e5::DOUBLE / p), 4) AS dz FROM a""")
def _(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (250 + F.col("l_quantity")).alias("t"), (50000 + F.col("l_extendedprice") % 50000).alias("p"), (F.col("l_discount") / 10).alias("q"))
    es = physics.saturation_pressure("t")
    return a.select("l_orderkey", "l_linenumber", r6(physics.potential_temperature("t", "p"), "theta"), r6(physics.virtual_temperature("t", "q"), "tv"), F.round(es, 4).alias("es"), F.round(physics.saturation_pressure("t", True), 4).alias("es_ice"), F.round(physics.mixing_ratio(es, "p"), 9).alias("w"), r6(physics.ideal_gas("rho", p="p", T="t"), "rho"), F.round(physics.hypsometric("deltaz", Tv="t", p1=1e5, p2="p"), 4).alias("dz"))


@query("u2_units", """SELECT l_orderkey, l_linenumber, round(l_quantity * (1 / 0.016043::DOUBLE / 86400), 9) AS umol FROM lineitem""")
def _(spark, d):
    # kg km-2 d-1 of CH4 to umol m-2 s-1
    f = physics.flux_factor("kg km-2 d-1", "umol m-2 s-1", "CH4")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * f, 9).alias("umol"))


# ---------------------------------------------------------------- earth

_PLACES = "p AS (SELECT c_custkey, CAST(c_custkey % 170 - 85 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 720 - 360 AS DOUBLE) AS lon, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat2, CAST(n_nationkey * 13 - 150 AS DOUBLE) AS lon2 FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _places(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = lambda x: x.cast("double")
    return c.select("c_custkey", f(F.col("c_custkey") % 170 - 85).alias("lat"), f(F.col("c_custkey") * 7 % 720 - 360).alias("lon"), f(F.col("n_nationkey") * 5 - 60).alias("lat2"), f(F.col("n_nationkey") * 13 - 150).alias("lon2"))


@query("g18_positions", f"""WITH {_PLACES}, q AS (SELECT *, radians(lat) AS a, radians(lat2) AS b, radians(lon2 - lon) AS dl FROM p)
SELECT c_custkey, ((lon + 180) % 360 + 360) % 360 - 180 AS wrapped,
 round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(dl / 2), 2))), 4) AS km,
 round(((degrees(atan2(sin(dl) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(dl))) % 360) + 360) % 360, 4) AS bearing,
 round(sqrt((pow(6378.137::DOUBLE * 6378.137::DOUBLE * cos(a), 2) + pow(6356.752314245::DOUBLE * 6356.752314245::DOUBLE * sin(a), 2)) / (pow(6378.137::DOUBLE * cos(a), 2) + pow(6356.752314245::DOUBLE * sin(a), 2))), 4) AS radius,
 round(6371.0::DOUBLE * 6371.0::DOUBLE * radians(1.0::DOUBLE) * (sin(radians(lat + 0.5::DOUBLE)) - sin(radians(lat - 0.5::DOUBLE))), 4) AS area FROM q""")
def _(spark, d):
    return _places(spark, d).select("c_custkey", geo.wrap_lon("lon").alias("wrapped"), F.round(geo.haversine("lat", "lon", "lat2", "lon2"), 4).alias("km"), F.round(geo.bearing("lat", "lon", "lat2", "lon2"), 4).alias("bearing"), F.round(geo.earth_radius("lat"), 4).alias("radius"), F.round(geo.cell_area("lat", 1.0, 1.0, 6371.0), 4).alias("area"))


@query("g19_lambert", f"""WITH {_PLACES}, n AS (SELECT sin(radians(38.5::DOUBLE)) AS n, cos(radians(38.5::DOUBLE)) AS c, tan(pi() / 4 + radians(38.5::DOUBLE) / 2) AS t),
 r AS (SELECT c_custkey, n, 6371229.0::DOUBLE * (c * pow(t, n) / n) / pow(tan(pi() / 4 + radians(lat) / 2), n) AS rho, 6371229.0::DOUBLE * (c * pow(t, n) / n) / pow(t, n) AS rho0,
  n * radians(((lon - 262.5::DOUBLE + 180) % 360 + 360) % 360 - 180) AS a, lat FROM p, n WHERE lat BETWEEN 20 AND 55)
SELECT c_custkey, round(rho * sin(a), 3) AS x, round(rho0 - rho * cos(a), 3) AS y, round(lat, 6) AS back FROM r""")
def _(spark, d):
    proj = geo.Lambert()
    x, y = proj.forward("lat", "lon")
    xy = _places(spark, d).filter("lat BETWEEN 20 AND 55").select("c_custkey", x.alias("x"), y.alias("y"))
    return xy.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), r6(proj.inverse("x", "y")[0], "back"))


_FLUX = """f AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS time, CAST(-85 + 10 * (o_orderkey % 18) AS DOUBLE) AS lat, CAST(-175 + 10 * (o_custkey % 36) AS DOUBLE) AS lon,
 o_orderpriority AS sector, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"""


def _flux(spark, d, *more: str):
    o = table(spark, d, "orders")
    return o.groupBy(F.trunc("o_orderdate", "year").alias("time"), (-85 + 10 * (F.col("o_orderkey") % 18)).cast("double").alias("lat"), (-175 + 10 * (F.col("o_custkey") % 36)).cast("double").alias("lon"), F.col("o_orderpriority").alias("sector"), *more).agg(F.sum("o_totalprice").alias("value"))


@query("a5_integrate", f"""WITH {_FLUX} SELECT time, round(sum(value * (6371.0::DOUBLE * 6371.0::DOUBLE * radians(10.0::DOUBLE) * (sin(radians(lat + 5)) - sin(radians(lat - 5)))) * (dayofyear(make_date(year(time), 12, 31)) * 86400)) / 1e18, 6) AS value FROM f GROUP BY 1""")
def _(spark, d):
    return grid.integrate(_flux(spark, d), 10, 10, "annual", 6371.0).select("time", F.round(F.col("value") / 1e18, 6).alias("value"))


@query("a4_sum_sectors", f"""WITH {_FLUX} SELECT time, lat, lon, round(sum(value), 2) AS value FROM f GROUP BY ALL""")
def _(spark, d):
    return rounded(aggregates.sum_sectors(_flux(spark, d)), "value", places=2)


@query("a8_ensemble", """WITH f AS (SELECT CAST(-85 + 10 * (o_orderkey % 18) AS DOUBLE) AS lat, o_orderstatus AS model, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT lat, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM f GROUP BY 1""")
def _(spark, d):
    f = table(spark, d, "orders").groupBy((-85 + 10 * (F.col("o_orderkey") % 18)).cast("double").alias("lat"), F.col("o_orderstatus").alias("model")).agg(F.sum("o_totalprice").alias("value"))
    return aggregates.ensemble(f, ["lat"]).select("lat", F.round("value", 4).alias("mean")).join(aggregates.ensemble(f, ["lat"], model="median").select("lat", F.round("value", 4).alias("median")), "lat")


@query("g5_clip", f"""WITH {_FLUX} SELECT time, lat, lon, sector, round(value, 2) AS value FROM f WHERE lon BETWEEN -125 AND -65 AND lat BETWEEN 25 AND 55""")
def _(spark, d):
    return rounded(grid.clip(_flux(spark, d), bbox=(-125, 25, -65, 55)), "value", places=2)


_NEW = """y AS (SELECT DISTINCT lat, lat - 5 AS lo, lat + 5 AS hi FROM f), x AS (SELECT DISTINCT lon, lon - 5 AS lo, lon + 5 AS hi FROM f),
 ny AS (SELECT CAST(unnest(range(-60, 61, 15)) AS DOUBLE) AS lat), nx AS (SELECT CAST(unnest(range(-150, 151, 15)) AS DOUBLE) AS lon),
 wy AS (SELECT y.lat, ny.lat AS nlat, sin(radians(least(hi, ny.lat + 7.5::DOUBLE))) - sin(radians(greatest(lo, ny.lat - 7.5::DOUBLE))) AS wy, sin(radians(ny.lat + 7.5::DOUBLE)) - sin(radians(ny.lat - 7.5::DOUBLE)) AS fy FROM y, ny WHERE least(hi, ny.lat + 7.5::DOUBLE) > greatest(lo, ny.lat - 7.5::DOUBLE)),
 wx AS (SELECT x.lon, nx.lon AS nlon, least(hi, nx.lon + 7.5::DOUBLE) - greatest(lo, nx.lon - 7.5::DOUBLE) AS wx FROM x, nx WHERE least(hi, nx.lon + 7.5::DOUBLE) > greatest(lo, nx.lon - 7.5::DOUBLE))"""


def _cells(spark):
    lat = spark.range(9).select((-60.0 + 15 * F.col("id")).alias("lat"))
    lon = spark.range(21).select((-150.0 + 15 * F.col("id")).alias("lon"))
    return tuple(d.select(c, (F.col(c) - 7.5).alias("lo"), (F.col(c) + 7.5).alias("hi")) for d, c in ((lat, "lat"), (lon, "lon")))


@query("g13_regrid_conservative", f"""WITH {_FLUX}, {_NEW}, g AS (SELECT lat, lon, sum(value) AS value FROM f GROUP BY ALL)
SELECT nlat AS lat, nlon AS lon, round(sum(value * wx * wy) / (any_value(fy) * 15), 4) AS value FROM g JOIN wy USING (lat) JOIN wx USING (lon) GROUP BY nlat, nlon""")
def _(spark, d):
    g = _flux(spark, d).groupBy("lat", "lon").agg(F.sum("value").alias("value"))
    return rounded(grid.regrid(g, *_cells(spark), "conservative", ()), "value", places=4)


@query("g13_regrid_normed", f"""WITH {_FLUX}, {_NEW}, g AS (SELECT lat, lon, sum(value) AS value FROM f WHERE sector < '3' GROUP BY ALL)
SELECT nlat AS lat, nlon AS lon, round(sum(value * wx * wy) / sum(wx * wy), 4) AS value FROM g JOIN wy USING (lat) JOIN wx USING (lon) GROUP BY nlat, nlon""")
def _(spark, d):
    g = _flux(spark, d).filter("sector < '3'").groupBy("lat", "lon").agg(F.sum("value").alias("value"))
    return rounded(grid.regrid(g, *_cells(spark), "conservative_normed", ()), "value", places=4)


@query("i2_scale_by_month", f"""WITH {_FLUX}, s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time, CAST(-85 + 10 * (o_orderkey % 18) AS DOUBLE) AS lat, CAST(-175 + 10 * (o_custkey % 36) AS DOUBLE) AS lon, o_orderpriority AS sector, count(*) / 10.0::DOUBLE AS factor FROM orders GROUP BY ALL)
SELECT s.time, s.lat, s.lon, s.sector, round(f.value * s.factor, 4) AS value FROM s ASOF JOIN f ON s.lat = f.lat AND s.lon = f.lon AND s.sector = f.sector AND s.time >= f.time""")
def _(spark, d):
    o = table(spark, d, "orders")
    s = o.groupBy(F.trunc("o_orderdate", "month").alias("time"), (-85 + 10 * (F.col("o_orderkey") % 18)).cast("double").alias("lat"), (-175 + 10 * (F.col("o_custkey") % 36)).cast("double").alias("lon"), F.col("o_orderpriority").alias("sector")).agg((F.count(F.lit(1)) / 10.0).alias("factor"))
    return rounded(grid.scale_by_month(_flux(spark, d), s), "value", places=4)


@query("i4_combine_first", f"""WITH {_FLUX}, a AS (SELECT time, lat, sum(value) AS value FROM f WHERE sector < '2' GROUP BY ALL), b AS (SELECT time, lat, sum(value) AS value FROM f WHERE sector >= '4' GROUP BY ALL)
SELECT time, lat, round(coalesce(a.value, b.value), 2) AS value FROM a FULL JOIN b USING (time, lat)""")
def _(spark, d):
    f = _flux(spark, d)
    part = lambda c: f.filter(c).groupBy("time", "lat").agg(F.sum("value").alias("value"))
    return rounded(grid.combine_first(part("sector < '2'"), part("sector >= '4'"), ["time", "lat"]), "value", places=2)


@query("i5_long_sectors", """SELECT o_orderkey, 'price' AS sector, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'days', CAST(day(o_orderdate) AS DOUBLE) FROM orders""")
def _(spark, d):
    wide = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.day("o_orderdate").cast("double").alias("days"))
    return grid.long_sectors(wide, ["o_orderkey"], ["price", "days"])


# ---------------------------------------------------------------- names, flags, sentinels

@query("s5_estimate_files", """
WITH f AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'AK' ELSE 'US' END || '.' || CASE WHEN p_size % 5 = 0 THEN 'total' ELSE 'onroad' END || '.' || CASE WHEN p_size % 2 = 0 THEN 'mn' ELSE 'lo' END || CASE WHEN p_size % 7 = 0 THEN '.2015.d001' ELSE '' END || '.nc4' AS file FROM part)
SELECT p_partkey, file FROM f WHERE file NOT LIKE '%total%' AND file LIKE '%US%' AND (file LIKE '%mn.nc4' OR file LIKE '%mn.2015.d001.nc4')""")
def _(spark, d):
    n = F.col("p_size")
    file = F.concat(F.when(n % 3 == 0, "AK").otherwise("US"), F.lit("."), F.when(n % 5 == 0, "total").otherwise("onroad"), F.lit("."), F.when(n % 2 == 0, "mn").otherwise("lo"), F.when(n % 7 == 0, ".2015.d001").otherwise(""), F.lit(".nc4"))
    return table(spark, d, "part").select("p_partkey", file.alias("file")).filter(names.estimate_file("file"))


@query("i7_standard_name", "SELECT p_partkey, lower(p_brand) || '_' || p_type || '_emissions' AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", names.standard_name("p_brand", "p_type").alias("name"))


@query("s9_without_sum", "SELECT o_orderkey, o_orderpriority AS sector FROM orders WHERE o_orderpriority <> '1-URGENT'")
def _(spark, d):
    return grid.without_sectors(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("sector")), ["1-URGENT"])


@query("g11_round_positions", "SELECT c_custkey, round_even(c_acctbal / 64 * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS lat, round_even(c_acctbal / 32 * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS lon FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 64).alias("lat"), (F.col("c_acctbal") / 32).alias("lon"))
    return grid.round_positions(c, 1, 2)


@query("i3_replicate_factors", """
WITH f AS (SELECT date_trunc('month', o_orderdate) AS time, o_orderpriority AS sector, count(*) AS factor FROM orders GROUP BY 1, 2),
 y AS (SELECT * FROM f WHERE year(time) = 1998)
SELECT CAST(time + to_years(CAST(n AS INTEGER)) AS TIMESTAMP) AS time, sector, factor FROM y, (SELECT unnest(range(0, 4)) AS n)""")
def _(spark, d):
    f = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time"), F.col("o_orderpriority").alias("sector")).agg(F.count(F.lit(1)).alias("factor"))
    return grid.replicate_factors(f, 1998, 2001)


@query("i6_names", r"""SELECT p_partkey, translate(regexp_replace(p_type || ' (a & b), c-d', '[\s(&-]', '_', 'g'), '),', '') AS sector,
 CAST(2000 + p_size AS BIGINT) AS year, 'v7_' || CAST(2000 + p_size AS VARCHAR) || '_ENE.0.1x0.1.nc' AS file FROM part""")
def _(spark, d):
    p = table(spark, d, "part").withColumn("file", F.concat(F.lit("v7_"), (2000 + F.col("p_size")).cast("string"), F.lit("_ENE.0.1x0.1.nc")))
    return p.select("p_partkey", names.sector_name(F.concat("p_type", F.lit(" (a & b), c-d"))).alias("sector"), names.flux_file_parts("file")[0].cast("bigint").alias("year"), "file")


@query("s30_addresses", """SELECT o_orderkey, 'sfc/' || strftime(o_orderdate, '%Y%m%d') || '/' || strftime(o_orderdate, '%Y%m%d_%H') || 'z_fcst.zarr/' || o_orderpriority || '/UGRD/' || o_orderpriority || '/UGRD/0.' || CAST(o_orderkey % 7 AS VARCHAR) || '.3' AS address FROM orders""")
def _(spark, d):
    chunk = F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(".3"))
    return table(spark, d, "orders").select("o_orderkey", names.zarr_address("o_orderdate", "sfc", "o_orderpriority", F.lit("UGRD"), "fcst", chunk).alias("address"))


@query("f1_flags", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 17 THEN l_quantity END AS l_quantity FROM lineitem WHERE l_returnflag IN ('...', 'A', 'R')")
def _(spark, d):
    return readers.quality_flags(table(spark, d, "lineitem"), ("A", "R"), "l_returnflag").select("l_orderkey", "l_linenumber", readers.sentinel("l_quantity", 17.0).alias("l_quantity"))


# ---------------------------------------------------------------- more grids and scalars

@query("a13_weighted_mean", f"""WITH {_FLUX} SELECT time, round(sum(cos(radians(lat)) * value) / sum(cos(radians(lat))), 4) AS value FROM f GROUP BY 1""")
def _(spark, d):
    return rounded(aggregates.weighted_mean(_flux(spark, d), "value", geo.cosine_weight("lat"), ["time"]), "value", places=4)


@query("a12_circularize", f"""WITH {_BINS}, a AS (SELECT round(s * radians(22.5::DOUBLE), 6) AS theta, count(*) AS n FROM b GROUP BY 1), ends AS (SELECT min(theta) AS lo, max(theta) AS hi, count(*) AS c FROM a)
SELECT theta, n FROM a UNION ALL SELECT round(hi + (hi - lo) / (c - 1), 6), n FROM a, ends WHERE theta = lo""")
def _(spark, d):
    sectors = polar.bin_polar(_wind(spark, d)).groupBy(F.round("radian", 6).alias("theta")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(aggregates.circularize(sectors.filter("theta IS NOT NULL")), "theta")


_ALL_CELLS = "g AS (SELECT lat, lon, sum(value) AS value FROM f GROUP BY ALL), ny AS (SELECT CAST(unnest(range(-60, 61, 15)) AS DOUBLE) AS nlat), nx AS (SELECT CAST(unnest(range(-150, 151, 15)) AS DOUBLE) AS nlon)"


def _all_cells(spark, d):
    return _flux(spark, d).groupBy("lat", "lon").agg(F.sum("value").alias("value"))


@query("g13_regrid_nearest", f"""WITH {_FLUX}, {_ALL_CELLS},
 y AS (SELECT nlat, lat FROM ny, (SELECT DISTINCT lat FROM f) QUALIFY row_number() OVER (PARTITION BY nlat ORDER BY abs(lat - nlat), lat) = 1),
 x AS (SELECT nlon, lon FROM nx, (SELECT DISTINCT lon FROM f) QUALIFY row_number() OVER (PARTITION BY nlon ORDER BY abs(lon - nlon), lon) = 1)
SELECT nlat AS lat, nlon AS lon, round(value, 2) AS value FROM g JOIN y USING (lat) JOIN x USING (lon)""")
def _(spark, d):
    return rounded(grid.regrid(_all_cells(spark, d), *_cells(spark), "nearest", ()), "value", places=2)


@query("g13_regrid_bilinear", f"""WITH {_FLUX}, {_ALL_CELLS},
 y AS (SELECT nlat, unnest([{{'c': lo, 'w': 1 - t}}, {{'c': lo + 10, 'w': t}}]) AS e FROM (SELECT nlat, floor((nlat + 85) / 10) * 10 - 85 AS lo, (nlat + 85) / 10 - floor((nlat + 85) / 10) AS t FROM ny)),
 x AS (SELECT nlon, unnest([{{'c': lo, 'w': 1 - t}}, {{'c': lo + 10, 'w': t}}]) AS e FROM (SELECT nlon, floor((nlon + 175) / 10) * 10 - 175 AS lo, (nlon + 175) / 10 - floor((nlon + 175) / 10) AS t FROM nx))
SELECT nlat AS lat, nlon AS lon, round(sum(y.e.w * x.e.w * value), 4) AS value FROM y, x, g WHERE g.lat = y.e.c AND g.lon = x.e.c AND y.e.w > 0 AND x.e.w > 0 GROUP BY 1, 2""")
def _(spark, d):
    return rounded(grid.regrid(_all_cells(spark, d), *_cells(spark), "bilinear", ()), "value", places=4)


@query("g14_resample", f"""WITH {_FLUX}, g AS (SELECT lat, lon, sum(value) AS value FROM f GROUP BY ALL),
 w AS (SELECT floor((lat + 90) / 20) * 20 - 80 AS nlat, floor((lon + 180) / 20) * 20 - 170 AS nlon, value, sin(radians(lat + 5)) - sin(radians(lat - 5)) AS w FROM g)
SELECT nlat AS lat, nlon AS lon, round(sum(value * w * 10) / ((sin(radians(nlat + 10)) - sin(radians(nlat - 10))) * 20), 4) AS value FROM w GROUP BY 1, 2""")
def _(spark, d):
    return rounded(grid.resample(_all_cells(spark, d), 20.0, "conservative", ()), "value", places=4)


@query("e15_levels", """SELECT l_orderkey, l_linenumber, round((l_extendedprice + l_discount * 90000) / 100, 6) AS hpa,
 CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL ELSE round(l_tax / sqrt(l_tax * l_tax + l_discount * l_discount), 6) END AS east FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(physics.hybrid_pressure("l_extendedprice", "l_discount", 90000.0), "hpa"), r6(physics.unit_vector("l_tax", "l_discount")[0], "east"))


@query("s11_variables", """SELECT p_partkey, '1B' || CAST(p_size AS VARCHAR) || 'a' AS code, p_brand_name AS name, 'e_' || CAST(p_size AS VARCHAR) AS factor
FROM (SELECT *, replace(p_brand, '#', '_') AS p_brand_name FROM part)""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")).alias("b"))
    v = p.withColumn("v", F.concat(F.lit("emi_ch4_Supp_1B"), "s", F.lit("a_"), "b"))
    code, name = names.inventory_variable("v")
    return v.select("p_partkey", code.alias("code"), name.alias("name"), names.factor_variable(F.concat(F.lit("a_b_c_d_e_"), "s")).alias("factor"))


@query("s27_sodar", """SELECT to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))::TIMESTAMP AS ts, event_id, CASE WHEN user_id % 7 <> 0 THEN round(value / 10, 6) END AS "WD" FROM events""")
def _(spark, d):
    raw = table(spark, d, "events").select(F.floor(timeops.micros("ts") / 1_000_000).alias("DATTIM"), "event_id", F.when(F.col("user_id") % 7 == 0, -9999.0).otherwise(F.col("value")).alias("WD"))
    scales = spark.range(1).select(F.lit("WD").alias("SHORTNAME"), F.lit(10.0).alias("MULT"))
    return rounded(readers.decode_sodar(raw, scales, ["WD"]), "WD")


@query("k1_sounding_dates", """SELECT t AS time FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-01 12:00:00', INTERVAL 12 HOUR)) AS t) WHERE month(t) IN (1, 12)""")
def _(spark, d):
    import datetime as dt

    return names.sounding_dates(spark, dt.datetime(2023, 12, 1), dt.datetime(2024, 3, 1, 12), (12, 1))

"""Scans by ranges and membership in intervals, against one ordered pass in Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aerolith.operators import intervals, ordered, series

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("down", [False, True])
def test_last_value_carried(spark, parts, down):
    rng = random.Random(parts)
    rows = [(x, n, None if rng.random() < 0.8 else x * 10) for n, x in enumerate([rng.choice([5, 5, 5, rng.randint(0, 90)]) for _ in range(200)])]
    df = spark.createDataFrame(rows, "x int, n int, v int").repartition(5)
    got = {r["n"]: r["c"] for r in ordered.carried_last(df, ["x", "n"], F.col("v"), "c", down, ordered.range_of(df, "x", parts)).collect()}
    last, want = None, {}
    for x, n, v in sorted(rows, key=lambda r: (-r[0] if down else r[0], r[1])):
        last = v if v is not None else last
        want[n] = last
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_runs_by_ranges(spark, seed):
    """Runs that fill several ranges, end at their borders, or stand in one."""
    rng = random.Random(seed)
    state, flags = False, []
    for _ in range(300):
        state = state if rng.random() < [0.97, 0.7, 0.5][seed] else not state
        flags.append(None if rng.random() < 0.02 else state)
    rows = [(T0 + dt.timedelta(hours=i), f) for i, f in enumerate(flags)]
    want, held = [], []
    for t, f in [*rows, (None, False)]:
        if f:
            held.append(t)
        else:
            if len(held) >= 3:
                want.append((held[0], held[-1] + dt.timedelta(seconds=43199)))
            held = []
    df = spark.createDataFrame(rows, "ts timestamp_ntz, f boolean").repartition(7)
    got = [tuple(r) for r in series.runs(df, F.col("f")).orderBy("event_id").collect()]
    assert got == [(i, *w) for i, w in enumerate(want)]
    keyed = [tuple(r)[1:] for r in series.runs(df.withColumn("k", F.lit(1)), F.col("f"), keys=["k"]).orderBy("event_id").collect()]
    assert keyed == got
    assert series.runs(df.limit(0), F.col("f")).count() == 0


def test_no_task_takes_the_whole_order(spark):
    """Windows over everything remain only over one row a range."""
    left = spark.range(2000).select((F.col("id") * 7 % 1999).cast("double").alias("x"), F.lit(1).alias("one"))
    right = spark.range(500).select((F.col("id") * 11 % 1993).cast("double").alias("y"), F.col("id").alias("k"))
    near = series.nearest_value(left, right, "x", "y", "k")
    ys = {}
    for r in right.collect():
        ys[r["y"]] = min(r["k"], ys.get(r["y"], r["k"]))
    for r in near.collect():
        y = min(ys, key=lambda v: (abs(v - r["x"]), ys[v]))
        assert (r["nearest_key"], r["nearest_value"], r["one"]) == (ys[y], y, 1)
    sizes = left.groupBy(ordered.range_of(left, "x", 10)).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 300


def test_lookups_of_odd_rows(spark):
    left = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 0.5)], "id int, x double")
    right = spark.createDataFrame([(1.0, "a"), (5.0, "b"), (None, "c")], "x double, v string")
    assert {r["id"]: r["v"] for r in series.asof(left, right, "x", ["v"]).collect()} == {1: "b", 2: None, 3: "b", 4: None}
    none = right.limit(0)
    assert {r["v"] for r in series.asof(left, none, "x", ["v"]).collect()} == {None}
    got = {r["id"]: r["nearest_key"] for r in series.nearest_value(left, right.withColumnRenamed("x", "y"), "x", "y", "v").collect()}
    assert got == {1: "b", 2: None, 3: "b", 4: "a"}


def test_row_numbers(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("x"))
    got = [(r["x"], r["n"]) for r in ordered.numbered(df, "x", "n").orderBy("x").collect()]
    assert [n for _, n in got] == list(range(500))


# ---------------------------------------------------------------- intervals

def test_membership_in_intervals_of_any_length(spark):
    """Points, microseconds, minutes, days and centuries; both ends included; copies, nulls and reversed bounds."""
    rng = random.Random(5)
    us = dt.timedelta(microseconds=1)
    spans = [(T0, T0), (T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=1) + us), (None, T0), (T0 + us, T0), (dt.datetime(1700, 3, 1, 1, 2, 3), dt.datetime(1890, 1, 1)), (dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 1, 0, 0, 59, 999_999))]
    for _ in range(40):
        a = T0 + dt.timedelta(seconds=rng.random() * 86_400 * 300)
        spans.append((a, a + dt.timedelta(seconds=10 ** rng.uniform(-3, 6.5))))
    spans += spans[-3:]
    times = [None, dt.datetime(1701, 1, 1), dt.datetime(1600, 1, 1), dt.datetime(1890, 1, 1, 0, 0, 0, 1)]
    for a, b in spans:
        times += [t + k * us for t in (a, b) if t is not None for k in (-1, 0, 1)]
    times += [T0 + dt.timedelta(seconds=rng.random() * 86_400 * 330) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(times)), "n int, ts timestamp_ntz").repartition(3)
    ev = spark.createDataFrame(spans, "start timestamp_ntz, end timestamp_ntz")
    want = {n for n, t in enumerate(times) if t is not None and any(a is not None and a <= t <= b for a, b in spans)}
    assert {r["n"] for r in series.filter_events(df, ev, keep="inside").collect()} == want
    outside = [r["n"] for r in series.filter_events(df, ev).collect()]
    assert sorted(outside) == sorted(set(range(len(times))) - want)
    assert series.filter_events(df, ev.limit(0)).count() == len(times) and series.filter_events(df, ev.limit(0), keep="inside").count() == 0


def test_pieces_grow_with_the_logarithm(spark):
    rows = []
    for days in (1, 100, 10_000):
        ev = spark.createDataFrame([(T0 + dt.timedelta(seconds=7), T0 + dt.timedelta(days=days, seconds=3))], "start timestamp_ntz, end timestamp_ntz")
        levels, ends = intervals.pieces(ev)
        assert ends.count() == 2
        rows.append(sum(p.count() for p in levels))
        covered = sum(p.count() * intervals.FINEST * intervals.WIDER**k for k, p in enumerate(levels))
        assert 0 <= (days * 86_400 - 4) * 10**6 + 1 - covered < 2 * intervals.FINEST  # pieces don't overlap
    assert rows[2] < 2 * intervals.WIDER * intervals.LEVELS and rows[2] - rows[1] <= 2 * intervals.WIDER

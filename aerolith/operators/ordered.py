"""Scans along one order without a key to partition by: ranges, a summary of each, and what is carried from one to the next.

A window over everything runs in one task. Here rows are dealt to at most `parts` ranges of the order (approximate
quantiles; equal values stay together), each range is scanned by itself, and what a scan needs from the ranges before is
found in a table with one row a range, which is small enough to be broadcast whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ranges, at most
PARTS = 256


def cuts_of(df: DataFrame, on: str, parts: int | None = None) -> list:
    """Where the ranges of `on` begin but the first, by approximate quantiles: one job, with a few values for the driver."""
    n = min(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), PARTS)
    shares = [(i + 1) / n for i in range(n - 1)]
    return sorted(set(df.agg(F.percentile_approx(on, shares, 100 * n).alias("s")).first()["s"] or [])) if shares else []


def range_by(cuts: list, on: str, kind: T.DataType) -> Column:
    """The range (0, 1, ...) of a value; nulls are in the first one."""
    return F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(on))) if cuts else F.lit(0)


def range_of(df: DataFrame, on: str, parts: int | None = None) -> Column:
    return range_by(cuts_of(df, on, parts), on, df.schema[on].dataType)


def carried_last(df: DataFrame, order: Sequence[str], value: Column, into: str, down: bool = False, at: Column | None = None) -> DataFrame:
    """df with the last non-null value at or before each row, in the order (or, with down, the reverse of its first
    column). at: the row's range, by `range_of` of the first column, if it is known already."""
    first, *rest = order
    part = at if at is not None else range_of(df, first)
    src = df.withColumn("_range", part).withColumn("_carry", value)
    ordering = [F.desc(first) if down else F.asc(first), *rest]
    local = Window.partitionBy("_range").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    last = F.min_by if down else F.max_by
    # of a range's rows that have a value, the last one in the scan's order (in reverse: the first column's least)
    named = F.struct(F.col(first), *[(-F.col(c) if down else F.col(c)) for c in rest])
    ends = src.filter(F.col("_carry").isNotNull()).groupBy("_range").agg(last("_carry", named).alias("_end"))
    # one row a range
    ranges = src.select("_range").distinct().join(ends, "_range", "left")
    before = Window.orderBy(F.desc("_range") if down else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    scanned = src.withColumn("_carry", F.last("_carry", ignorenulls=True).over(local))
    return scanned.join(F.broadcast(carry), "_range").select(*df.columns, F.coalesce("_carry", "_before").alias(into))


def numbered(df: DataFrame, order: str, into: str, at: Column | None = None) -> DataFrame:
    """df with row numbers from 0 in the order."""
    src = df.withColumn("_range", at if at is not None else range_of(df, order))
    local = src.withColumn("_no", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    # whole rows are asked for, so that both uses share one shuffle
    sizes = local.groupBy("_range").agg(F.max(F.struct("_no", *df.columns))["_no"].alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_before") + F.col("_no") - 1).cast("bigint").alias(into))


def flagged_runs(df: DataFrame, flag: Column, ts: str, cuts: list) -> DataFrame:
    """(n, start, last) of the runs of flagged rows in the order of ts; a null flag is false.

    Runs are found in each range. Only the first and last run of a range can go on in another one: these, two a range at
    most, are put together by one small scan.
    """
    src = df.select(F.col(ts).alias("_ts"), F.coalesce(flag, F.lit(False)).alias("_on"))
    src = src.withColumn("_range", range_by(cuts, "_ts", df.schema[ts].dataType))
    w = Window.partitionBy("_range").orderBy("_ts")
    turn = src.withColumn("_turn", F.coalesce((F.col("_on") != F.lag("_on").over(w)).cast("int"), F.lit(0)))
    numbered_runs = turn.withColumn("_run", F.sum("_turn").over(w))
    each = numbered_runs.groupBy("_range", "_run").agg(F.count(F.lit(1)).alias("n"), F.min("_ts").alias("start"), F.max("_ts").alias("last"), F.first("_on").alias("_on"))
    each = each.withColumn("_end", F.max("_run").over(Window.partitionBy("_range")))
    inner = each.filter("_run > 0 AND _run < _end AND _on").select("n", "start", "last")
    edges = each.filter("_run = 0 OR _run = _end")
    order = Window.orderBy("_range", "_run")
    joined = (F.col("_run") == 0) & F.col("_on") & F.coalesce(F.lag("_on").over(order), F.lit(False))
    groups = edges.withColumn("_new", (~joined).cast("int")).withColumn("_group", F.sum("_new").over(order)).filter("_on")
    outer = groups.groupBy("_group").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("last").alias("last")).drop("_group")
    return inner.unionByName(outer)

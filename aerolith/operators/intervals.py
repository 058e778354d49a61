"""Membership in intervals of any length: each is cut into pieces of a few fixed lengths, so that rows meet by equal keys.

An interval covers whole stretches of FINEST * WIDER^k; the largest that fit are its pieces (fewer than 2 * WIDER at each
level), and the two ends are pieces of the finest level with exact bounds. A row asks once at every level whether its
stretch is a piece. Long intervals aren't spread over days, and short ones don't share a day's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeops

#: microseconds of the finest stretch, how much wider each level is, and levels: the coarsest is some 30 years
FINEST, WIDER, LEVELS = 60_000_000, 64, 5


def pieces(intervals: DataFrame, start: str = "start", end: str = "end") -> tuple[list[DataFrame], DataFrame]:
    """([(stretch) of each level that an interval covers wholly], (stretch, lo, hi) of the ends), both ends included.

    Intervals with a null bound, or that end before they start, have no pieces. Exact up to the year 2255 (2^53 microseconds).
    """
    src = intervals.select(timeops.micros(start).alias("lo"), timeops.micros(end).alias("hi")).filter("hi >= lo").distinct()
    out = []
    for level in range(LEVELS):
        width = FINEST * WIDER**level
        first, stop = -F.floor(-F.col("lo") / width), F.floor((F.col("hi") + 1) / width)  # stretches covered: first..stop-1
        left, right = stop, stop
        if level + 1 < LEVELS:  # those under a covered stretch of the next level are left to it
            above = width * WIDER
            up, down = -F.floor(-F.col("lo") / above), F.floor((F.col("hi") + 1) / above)
            left, right = F.when(up < down, up * WIDER).otherwise(stop), F.when(up < down, down * WIDER).otherwise(stop)
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        covered = F.concat(run(first, F.least(stop, left)), run(F.greatest(first, right), stop))
        out.append(src.select(F.explode(covered).alias("stretch")))
    ends = src.select("lo", "hi", F.explode(F.array_distinct(F.array(F.floor(F.col("lo") / FINEST), F.floor(F.col("hi") / FINEST)))).alias("stretch"))
    return out, ends


def within(df: DataFrame, intervals: DataFrame, ts: str = "ts", inside: bool = True) -> DataFrame:
    """Rows of df whose time lies in an interval, or (inside=False) in none; rows without a time lie in none.

    One pass: every level is an existence join on equal keys, which Spark broadcasts where the pieces are few.
    """
    levels, ends = pieces(intervals)
    at = timeops.micros(ts)
    named = df.withColumn("_at", at)
    here = F.col("_at").outer()
    tests: list[Column] = [p.where(F.col("stretch") == F.floor(here / (FINEST * WIDER**k))).exists() for k, p in enumerate(levels)]
    tests.append(ends.where((F.col("stretch") == F.floor(here / FINEST)) & here.between(F.col("lo"), F.col("hi"))).exists())
    found = reduce(lambda a, b: a | b, tests)
    return named.where(found if inside else ~found).drop("_at")

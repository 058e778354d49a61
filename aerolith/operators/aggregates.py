"""Aggregations over time, sectors and models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeops

STATISTICS = {
    "mean": F.avg, "std": F.stddev_samp, "median": F.median, "min": F.min, "max": F.max, "count": F.count, "var": F.var_samp,
    "first": F.first, "last": F.last, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
}


def statistics(col: str, names: str | Sequence[str]) -> list[Column]:
    """One column a statistic, named col_statistic."""
    return [STATISTICS[n](F.col(col)).alias(f"{col}_{n}") for n in ([names] if isinstance(names, str) else names)]


def by_callable(df: DataFrame, keys: Sequence[str], value: str, statistic: Callable[[pd.Series], float], name: str) -> DataFrame:
    """Any function of a group's values (a pandas Series) to a number, as value_name.

    A group is held by one task: only for groups that are small by nature. Built-in statistics have no such bound.
    """

    @F.pandas_udf("double")
    def of(v: pd.Series) -> float:
        out = statistic(v)
        return None if out is None or pd.isna(out) else float(out)

    return df.groupBy(*keys).agg(of(F.col(value).cast("double")).alias(f"{value}_{name}"))


def diurnal(df: DataFrame, values: Sequence[str], ts: str = "ts", freq_us: int = 3_600_000_000, statistic: str | Sequence[str] = "mean", method: str = "floor", keys: Sequence[str] = (), min_count: int | None = None) -> DataFrame:
    """Statistics by time of day; with min_count, those of fewer values are null."""
    binned = df.withColumn("time", timeops.time_of_day(timeops.rounded_micros(ts, freq_us, method)))
    out = binned.groupBy(*keys, "time").agg(*[c for v in values for c in statistics(v, statistic)], *[F.count(v).alias(f"_{v}_n") for v in values])
    names = [statistic] if isinstance(statistic, str) else list(statistic)
    if min_count is not None:
        for v in values:
            for n in names:
                if n != "count":
                    out = out.withColumn(f"{v}_{n}", F.when(F.col(f"_{v}_n") >= min_count, F.col(f"{v}_{n}")))
    return out.drop(*[f"_{v}_n" for v in values])


def seasonal(df: DataFrame, values: Sequence[str], ts: str = "ts", statistic: str | Sequence[str] = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """Statistics by season and the year in which its quarter starts; empty quarters stay."""
    quarters = df.withColumn("quarter", timeops.quarter_start(ts))
    agg = quarters.groupBy(*keys, "quarter").agg(*[c for v in values for c in statistics(v, statistic)])
    out = timeops.spine(quarters, "quarter", "INTERVAL 3 MONTHS", list(keys)).join(agg, [*keys, "quarter"], "left")
    return out.select(*keys, timeops.season("quarter").alias("season"), F.year("quarter").alias("year"), *agg.columns[len(keys) + 1 :])


def seasonal_pivot(df: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    """Mean and deviation of each season as columns, a row for each year."""
    q = df.withColumn("quarter", timeops.quarter_start(ts)).withColumn("season", timeops.season("quarter")).withColumn("year", F.year("quarter"))
    return q.groupBy("year").pivot("season", ["DJF", "MAM", "JJA", "SON"]).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def well_mixed(df: DataFrame, value: str, ts: str = "ts", hours: Sequence[int] = timeops.AFTERNOON, keys: Sequence[str] = ()) -> DataFrame:
    """Daily means of the given hours; days without any stay."""
    some = df.filter(F.hour(ts).isin(*hours)).withColumn("day", F.to_date(ts))
    mean = some.groupBy(*keys, "day").agg(F.avg(value).alias(value))
    return timeops.spine(some, "day", "INTERVAL 1 DAY", list(keys)).join(mean, [*keys, "day"], "left")


def sum_sectors(grid: DataFrame, coords: Sequence[str] = ("time", "lat", "lon"), value: str = "value") -> DataFrame:
    return grid.groupBy(*coords).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def ensemble(grid: DataFrame, coords: Sequence[str], value: str = "value", model: str = "mean", model_col: str = "model") -> DataFrame:
    """Mean or median over the models, or one model."""
    if model in ("mean", "median"):
        return grid.groupBy(*coords).agg(STATISTICS[model](value).alias(value))
    return grid.filter(F.col(model_col) == model).select(*coords, value)


def weighted_mean(df: DataFrame, value: str, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    w = F.when(F.col(value).isNotNull(), weight)
    return df.groupBy(*keys).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias(value))


def circularize(df: DataFrame, theta: str = "theta") -> DataFrame:
    """The rows of the first angle once more, one mean step behind the last angle."""
    steps = df.select(theta).distinct().agg(F.min(theta).alias("_lo"), F.max(theta).alias("_hi"), F.count(theta).alias("_n"))
    again = df.crossJoin(F.broadcast(steps)).filter(F.col(theta) == F.col("_lo"))  # steps is one row
    return df.unionByName(again.withColumn(theta, F.col("_hi") + F.try_divide(F.col("_hi") - F.col("_lo"), F.col("_n") - 1)).drop("_lo", "_hi", "_n"))

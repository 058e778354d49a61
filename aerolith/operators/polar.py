"""Wind-rose binning and its aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTORS = 16
WIDTH = 360.0 / SECTORS


def direction_bin(wd: Column | str) -> Column:
    """Sector 0 (north) to 15, closed at the clockwise end; null outside (-0.1, 371.25]."""
    d = F.col(wd) if isinstance(wd, str) else wd
    k = F.ceil((d - WIDTH / 2) / WIDTH).cast("int")
    return F.when((d > -0.1) & (d <= 360 + WIDTH / 2), k % SECTORS)


def bin_polar(df: DataFrame, x: str = "ws", wd: str = "wd", n: int = 29, edges: Sequence[float] | None = None) -> DataFrame:
    """Adds `radian` (sector angle) and `x_bin` (right edge of one of n equal bins of x; the lowest value counts).

    With edges the bins are the given ones, closed on the right (the first one on both sides); values beyond have none."""
    value = F.col(x)
    if edges is not None:
        at = sorted(float(e) for e in edges)
        if len(set(at)) != len(at) or len(at) < 2:
            raise ValueError("give two or more different edges")
        within = value.isNotNull() & ~F.isnan(value.cast("double")) & value.between(at[0], at[-1])
        k = F.when(within, F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(e) for e in at]), lambda e: e < value))))
        right = F.get(F.array(*[F.lit(e) for e in at]), k)
        return df.withColumn("radian", direction_bin(wd) * math.radians(WIDTH)).withColumn("x_bin", right).withColumn("x_index", k)
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / n
    k = F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(F.try_divide(value - F.col("_lo"), step)).cast("int")))
    binned = df.crossJoin(F.broadcast(ends))  # ends is one row
    edge = F.when(value.isNotNull(), F.col("_lo") + step * k)
    return binned.withColumn("radian", direction_bin(wd) * math.radians(WIDTH)).withColumn("x_bin", edge).withColumn("x_index", F.when(value.isNotNull(), k)).drop("_lo", "_hi")


def polar_aggregate(binned: DataFrame, value: str, stat: Column, min_bin: int = 1, n: int = 29) -> DataFrame:
    """stat and count for each sector seen and every bin of x; stat is null unless count > min_bin."""
    agg = binned.filter(F.col("radian").isNotNull() & F.col("x_index").isNotNull()).groupBy("radian", "x_index").agg(stat.alias("stat"), F.count(value).alias("n"))
    spine = agg.select("radian").distinct().withColumn("x_index", F.explode(F.sequence(F.lit(1), F.lit(n))))
    full = spine.join(agg, ["radian", "x_index"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return full.select("radian", "x_index", F.when(F.col("n") > min_bin, F.col("stat")).alias("stat"), "n")


def polar_frequency(binned: DataFrame) -> DataFrame:
    """Share of all binned rows in per cent."""
    some = binned.filter(F.col("radian").isNotNull() & F.col("x_index").isNotNull()).groupBy("radian", "x_index").agg(F.count(F.lit(1)).alias("n"))
    total = some.agg(F.sum("n").alias("total"))
    return some.crossJoin(F.broadcast(total)).select("radian", "x_index", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # total is one row

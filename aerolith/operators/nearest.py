"""Nearest neighbours in a plane, exact, by squares: no ordering of everything and no pairs of all with all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: each coarser level has squares so many times as wide
WIDER = 4.0
#: what rounding may take from a distance
SLACK = 1 + 1e-9


def _square(c: Column | str, side) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / side).cast("bigint")


def _finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")))
    return df


def nearest_in_plane(left: DataFrame, right: DataFrame, x: str, y: str, right_x: str, right_y: str, key: str, into: tuple[str, str] = ("nearest_key", "distance")) -> DataFrame:
    """left with the key of the nearest row of right and its distance; ties to the smaller key.

    First every place gets an upper bound: the nearest of one representative of each of the nine squares around it, at the
    finest level at which one of them holds a row. Then the squares that a circle of that radius meets are searched. Both
    sides are searched as distinct places, so that copies cost nothing. Squares hold one row of right on average; a place
    far from everything searches a large square, with all that lies in it. Rows of left without a finite place, and all
    rows if right has none, get nulls. One job for the bounds of right runs when this is called.
    """
    sites = _finite(right, right_x, right_y).groupBy(F.col(right_x).cast("double").alias("sx"), F.col(right_y).cast("double").alias("sy")).agg(F.min(key).alias("k"))
    spots = _finite(left, x, y).select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct()
    ends = lambda d, a, b: d.agg(F.count(F.lit(1)).alias("n"), F.min(a).alias("x0"), F.max(a).alias("x1"), F.min(b).alias("y0"), F.max(b).alias("y1")).first()
    s, q = ends(sites, "sx", "sy"), ends(spots, "px", "py")
    names = [F.col(f"`{c}`") for c in left.columns]
    if not s["n"] or not q["n"]:
        return left.select(*names, F.lit(None).cast(right.schema[key].dataType).alias(into[0]), F.lit(None).cast("double").alias(into[1]))
    wide, high = s["x1"] - s["x0"], s["y1"] - s["y0"]
    extent = max(max(s["x1"], q["x1"]) - min(s["x0"], q["x0"]), max(s["y1"], q["y1"]) - min(s["y0"], q["y0"]), 1e-12)
    side = max(math.sqrt(wide * high / s["n"]), max(wide, high) / s["n"], extent / 2**30)
    sides = [side * WIDER**i for i in range(1 + max(1, math.ceil(math.log(extent / side, WIDER))) if extent > side else 2)]

    def keyed(df: DataFrame, a: str, b: str, levels: range, around: bool) -> DataFrame:
        steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)] if around else [(0, 0)]
        squares = [F.struct(F.lit(n).alias("level"), (_square(a, sides[n]) + i).alias("i"), (_square(b, sides[n]) + j).alias("j")) for n in levels for i, j in steps]
        return df.withColumn("sq", F.explode(F.array(*squares))).select("*", "sq.level", "sq.i", "sq.j").drop("sq")

    d2 = (F.col("px") - F.col("sx")) ** 2 + (F.col("py") - F.col("sy")) ** 2

    def bounded(of: DataFrame, levels: range) -> DataFrame:
        """(px, py, level, u2): the first level with a neighbour, and the squared distance to a representative there."""
        one = keyed(sites, "sx", "sy", levels, False).groupBy("level", "i", "j").agg(F.min_by(F.struct("sx", "sy"), F.struct("sx", "sy")).alias("s"))
        met = keyed(of, "px", "py", levels, True).join(one.select("level", "i", "j", "s.sx", "s.sy"), ["level", "i", "j"], "left")
        best = F.min(F.when(F.col("sx").isNotNull(), F.struct(F.col("level"), d2.alias("u2"))))
        return met.groupBy("px", "py").agg(best.alias("b")).select("px", "py", "b.level", "b.u2")

    def searched(of: DataFrame, levels: range) -> DataFrame:
        """The nearest site (u2, k) of each bounded place, in the squares of its level that the bound's circle meets."""
        r = F.sqrt("u2") * SLACK
        size = F.element_at(F.array(*[F.lit(v) for v in sides]), F.col("level") + 1)
        axis = lambda c: F.explode(F.sequence(_square(F.col(c) - r, size), _square(F.col(c) + r, size)))
        asked = of.withColumn("i", axis("px")).withColumn("j", axis("py"))
        met = asked.join(keyed(sites, "sx", "sy", levels, False), ["level", "i", "j"]).filter(d2 <= F.col("u2") * SLACK)
        return met.groupBy("px", "py").agg(F.min(F.struct(d2.alias("u2"), F.col("k"))).alias("b")).select("px", "py", F.sqrt("b.u2").alias("dist"), F.col("b.k").alias("k"))

    fine, coarse = range(1), range(1, len(sides))
    first = bounded(spots, fine)
    near = searched(first.filter("u2 IS NOT NULL"), fine)
    far = searched(bounded(first.filter("u2 IS NULL").select("px", "py"), coarse).filter("u2 IS NOT NULL"), coarse)
    at = (F.col(x).cast("double") == F.col("px")) & (F.col(y).cast("double") == F.col("py"))
    return left.join(near.unionByName(far), at, "left").select(*names, F.col("k").alias(into[0]), F.col("dist").alias(into[1]))

"""Networks of lines that cross: split at crossings, connected parts, and points along them that keep a distance.

Places are snapped to whole units (10 ** -places), so that ends that differ by less are one node and orders, equality and
products of differences below 2 ** 26 units are exact. A line is an array of structs x, y; vertices that are null or not
finite are passed over, and a line without any vertex, or null, gives nothing. A line of one place is a node. Repeated lines
count once. Networks, told apart by `keys` (nulls too are a value), don't meet.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Folder, connected_parts

SEGMENT = ["_k", "x0", "y0", "x1", "y1"]
#: squares with so many pieces aren't cut further
CALM = 16
#: the least side of a square, in units
LEAST_SIDE = 64.0


def _segments(lines: DataFrame, keys: list[str], line: str, places: int) -> DataFrame:
    """Distinct (_k, x0, y0, x1, y1) in whole units, smaller end first; lines of one place have equal ends."""
    scale = float(10**places)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    unit = lambda c: F.round(c.cast("double") * scale).cast("bigint")
    kept = F.filter(F.col(f"`{line}`"), lambda p: p.isNotNull() & finite(p["x"].cast("double")) & finite(p["y"].cast("double")))
    a = lines.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_k"), F.transform(kept, lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y"))).alias("a"))
    zipped = a.filter(F.size("a") > 0).withColumn("b", F.slice("a", 2, F.size("a")))
    steps = zipped.select("_k", (F.size("a") == 1).alias("one"), F.explode(F.arrays_zip("a", "b")).alias("s"))
    pairs = steps.filter("one OR s.b IS NOT NULL").select("_k", F.col("s.a").alias("a"), F.coalesce("s.b", "s.a").alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return pairs.select("_k", low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1")).distinct()


def _height(x: Column) -> Column:
    """y of the segment above x, from its nearer end, for segments that aren't vertical."""
    at = F.greatest(F.col("x0"), F.least(F.col("x1"), x))
    return F.col("y0") + (at - F.col("x0")) * ((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))


def _walk(segments: DataFrame, side: Column, within: bool) -> DataFrame:
    """segments with the squares (i, j) that they meet or come within a unit of; `within` keeps to the square (pi, pj) of `s` * `s` such squares."""
    whole = lambda c: F.floor(c / side).cast("bigint")

    def spread(df: DataFrame, name: str, low: Column, high: Column, parent: str) -> DataFrame:
        if within:
            low, high = F.greatest(low, F.col(parent) * F.col("s")), F.least(high, F.col(parent) * F.col("s") + F.col("s") - 1)
        return df.withColumn("_l", low).withColumn("_h", high).filter("_l <= _h").withColumn(name, F.explode(F.sequence("_l", "_h"))).drop("_l", "_h")

    columns = spread(segments, "i", whole(F.col("x0") - 1), whole(F.col("x1") + 1), "pi")
    upright = F.col("x0") == F.col("x1")
    left, right = _height(F.col("i") * side - 1), _height((F.col("i") + 1) * side + 1)
    low = F.when(upright, F.col("y0")).otherwise(F.least(left, right))
    high = F.when(upright, F.col("y1")).otherwise(F.greatest(left, right))
    return spread(columns, "j", whole(low - 2), whole(high + 2), "pj")


def _meetings(segments: DataFrame, side: float) -> DataFrame:
    """(_k, a, b): segments that share a square, a before b. Squares are as wide as a segment is long on average, so that
    there are a few pieces a segment; a square with c pieces is cut into about c smaller ones."""
    pieces = _walk(segments, F.lit(side), False).withColumnRenamed("i", "pi").withColumnRenamed("j", "pj")
    crowd = pieces.groupBy("_k", "pi", "pj").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")  # alone in its square: meets nothing there
    finest = F.lit(side / LEAST_SIDE)
    parts = F.when(F.col("c") > CALM, F.least(finest, F.pow(F.lit(2.0), F.floor(F.log2(F.sqrt("c")))))).otherwise(1.0)
    cut = pieces.join(crowd.select("_k", "pi", "pj", parts.cast("bigint").alias("s")), ["_k", "pi", "pj"])
    small = _walk(cut, F.lit(side) / F.col("s"), True).select("_k", "s", "i", "j", F.struct("x0", "y0", "x1", "y1").alias("a"))
    met = small.join(small.withColumnRenamed("a", "b"), ["_k", "s", "i", "j"]).filter("a < b")
    boxes = (F.col("a.x1") + 1 >= F.col("b.x0")) & (F.col("b.x1") + 1 >= F.col("a.x0"))
    low, high = (lambda c: F.least(f"{c}.y0", f"{c}.y1")), (lambda c: F.greatest(f"{c}.y0", f"{c}.y1"))
    return met.filter(boxes & (high("a") + 1 >= low("b")) & (high("b") + 1 >= low("a"))).select("_k", "a", "b")


def _near(x: Column, y: Column, s: str) -> Column:
    """The place lies within a unit of segment s."""
    dx, dy = F.col(f"{s}.x1") - F.col(f"{s}.x0"), F.col(f"{s}.y1") - F.col(f"{s}.y0")
    across = (x - F.col(f"{s}.x0")).cast("double") * dy - (y - F.col(f"{s}.y0")).cast("double") * dx
    low, high = F.least(f"{s}.y0", f"{s}.y1") - 1, F.greatest(f"{s}.y0", f"{s}.y1") + 1
    return x.between(F.col(f"{s}.x0") - 1, F.col(f"{s}.x1") + 1) & y.between(low, high) & (across * across <= dx.cast("double") * dx + dy.cast("double") * dy)


def _cuts(met: DataFrame) -> DataFrame:
    """(_k, x0, y0, x1, y1, x, y): where segments are to be cut, from the pairs that share a square."""
    d = lambda c: F.col(c).cast("double")
    rx, ry, sx, sy = d("a.x1") - d("a.x0"), d("a.y1") - d("a.y0"), d("b.x1") - d("b.x0"), d("b.y1") - d("b.y0")
    qx, qy = d("b.x0") - d("a.x0"), d("b.y0") - d("a.y0")
    across = F.nullif(rx * sy - ry * sx, F.lit(0.0))  # null: parallel
    solved = met.withColumn("t", (qx * sy - qy * sx) / across).withColumn("u", (qx * ry - qy * rx) / across)
    inner = F.col("t").between(0, 1) & F.col("u").between(0, 1)
    place = lambda x, y: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    cross = F.when(inner, place(F.round(d("a.x0") + F.col("t") * rx), F.round(d("a.y0") + F.col("t") * ry)))
    end = lambda of, n, on: F.when(_near(F.col(f"{of}.x{n}"), F.col(f"{of}.y{n}"), on), place(F.col(f"{of}.x{n}"), F.col(f"{of}.y{n}")))
    of = lambda s, p: F.struct(F.col(s).alias("s"), p.alias("p"))
    every = [of("a", F.col("c")), of("b", F.col("c")), *[of(s, end(o, n, s)) for s, o in (("a", "b"), ("b", "a")) for n in (0, 1)]]
    rows = solved.withColumn("c", cross).select("_k", F.explode(F.array(*every)).alias("e")).filter("e.p IS NOT NULL")
    return rows.select("_k", "e.s.*", "e.p.*").distinct()


def _split(lines: DataFrame, keys: list[str], line: str, places: int, keep: Folder) -> DataFrame:
    from pyspark.sql import Window

    segments = keep.save(_segments(lines, keys, line, places))
    mean = segments.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.abs(F.col("y1") - F.col("y0"))))).first()[0]
    side = max(LEAST_SIDE, 2.0 ** math.ceil(math.log2(max(mean or 1, 1))))
    ends = [segments.select(*SEGMENT, F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y")) for n in (0, 1)]
    stops = _cuts(_meetings(segments, side)).unionByName(ends[0]).unionByName(ends[1]).distinct()
    along = (F.col("x") - F.col("x0")).cast("double") * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")).cast("double") * (F.col("y1") - F.col("y0"))
    order = Window.partitionBy(*SEGMENT).orderBy(along, "x", "y")
    p, q = F.struct("x", "y"), F.lead(F.struct("x", "y")).over(order)
    steps = stops.select("_k", p.alias("p"), q.alias("q"), (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")))
    steps = steps.toDF("_k", "p", "q", "one").filter("q IS NOT NULL OR one").select("_k", "p", F.coalesce("q", "p").alias("q"))
    low, high = F.least("p", "q"), F.greatest("p", "q")
    return keep.save(steps.select("_k", low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1")).distinct())


def _out(df: DataFrame, keys: list[str], places: int, *cols: str) -> DataFrame:
    named = [F.col("_k").getField(k).alias(k) for k in keys]
    return df.select(*named, *[(F.col(c) / float(10**places)).alias(c) for c in cols])


def split_lines(lines: DataFrame, keys: list[str], line: str = "line", places: int = 5) -> DataFrame:
    """keys, x0, y0, x1, y1: the distinct straight edges between nodes, which are ends, bends and all places where lines cross,
    touch within a unit or run upon each other. A line of one place has equal ends.

    Segments meet by squares that they pass, never all with all; many crossings upon one segment are ordered by a window that
    spills. A crossing is snapped, so an edge may be moved by up to a unit; what it newly crosses by that isn't cut again.
    The edges lie in the shared folder; one job for the squares' width runs when this is called.
    """
    return _out(_split(lines, keys, line, places, Folder(lines.sparkSession, "network")), keys, places, "x0", "y0", "x1", "y1")


def network_parts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, part_x, part_y: every node of split_lines with the smallest node (x, then y) of its connected part."""
    k = F.struct(*[F.col(f"`{c}`") for c in keys])
    node = lambda n: F.struct(k.alias("k"), F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"))
    found = connected_parts(edges.select(node(0).alias("a"), node(1).alias("b")))
    named = [F.col("node.k").getField(c).alias(c) for c in keys]
    return found.select(*named, "node.x", "node.y", F.col("part.x").alias("part_x"), F.col("part.y").alias("part_y"))


def _pick(candidates: pa.Table, kept: pa.Table, gap: float) -> pa.Table:
    """The candidates, in order of o, that lie no nearer than gap to those kept already or to one another."""
    t = candidates.sort_by("o")
    taken: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    square = lambda p: (math.floor(p[0] / gap), math.floor(p[1] / gap))
    for p in zip(kept["x"].to_pylist(), kept["y"].to_pylist(), strict=True):
        taken[square(p)].append(p)
    out = []
    for n, p in enumerate(zip(t["x"].to_pylist(), t["y"].to_pylist(), strict=True)):
        i, j = square(p)
        around = (q for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for q in taken.get((a, b), ()))
        if all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 >= gap * gap for q in around):
            taken[i, j].append(p)
            out.append(n)
    return t.select(["_k", "x", "y"]).take(pa.array(np.array(out, np.int64)))


def points_along_network(lines: DataFrame, keys: list[str], spacing: float, factor: float = 0.1, line: str = "line", places: int = 5, block: int = 32) -> DataFrame:
    """keys, x, y: nodes along the split lines, spacing * factor apart at most, chosen so that no two of a network are nearer
    than spacing and every node lies within spacing of a chosen one.

    The plane is cut into blocks of `block` spacings in four colours, of which equal ones never touch. One colour after the
    other, each block's nodes are chosen along its edges, given what the blocks before chose around it: four rounds whatever the
    size, and a task holds the nodes of a block, not a network's. The result lies in the shared folder.
    """
    scale = float(10**places)
    gap, step = spacing * scale, max(1.0, spacing * factor * scale)
    wide = gap * block
    spark = lines.sparkSession
    work, result = Folder(spark, "network"), Folder(spark, "points")
    edges = _split(lines, keys, line, places, work)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx.cast("double") * dx + dy.cast("double") * dy) / step))
    steps = edges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint"))))
    at = lambda a, d: F.round(F.col(a) + d * (F.col("i") / F.col("n"))).cast("bigint")
    nodes = steps.select("_k", at("x0", dx).alias("x"), at("y0", dy).alias("y"), F.struct("x0", "y0", "x1", "y1", "i").alias("o"))
    nodes = nodes.groupBy("_k", "x", "y").agg(F.min("o").alias("o"))
    home = lambda c: F.floor(c / wide).cast("bigint")
    colour = lambda: F.pmod("bi", F.lit(2)) * 2 + F.pmod("bj", F.lit(2))
    # the order in a block as one number a node, so that Arrow can sort by it
    from pyspark.sql import Window

    placed = nodes.withColumn("bi", home(F.col("x"))).withColumn("bj", home(F.col("y")))
    placed = work.save(placed.withColumn("o", F.row_number().over(Window.partitionBy("_k", "bi", "bj").orderBy("o"))))
    chosen = result.save(placed.select("_k", "x", "y").limit(0))
    for c in range(4):
        reach = lambda p: F.explode(F.sequence(home(F.col(p) - gap), home(F.col(p) + gap)))
        around = chosen.withColumn("bi", reach("x")).withColumn("bj", reach("y")).filter(colour() == c)
        mine = placed.filter(colour() == c)
        run = lambda a, b: _pick(a, b, gap)
        more = mine.groupBy("_k", "bi", "bj").cogroup(around.groupBy("_k", "bi", "bj")).applyInArrow(run, chosen.schema)
        more = result.save(more)
        chosen = chosen.unionByName(more)
    work.clear()
    return _out(chosen, keys, places, "x", "y")

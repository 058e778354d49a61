"""Connected parts of a graph given as a table of edges, in rounds of joins and aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


class Folder:
    """Tables written for one job below the shared folder; `clear` deletes them."""

    def __init__(self, spark, tag: str):
        self.spark, self.path, self.n = spark, f"{shared.shared_dir(spark)}/aerolith/{tag}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        system, at = shared.opened(self.path)
        system.delete_dir(at)


def connected_parts(edges: DataFrame) -> DataFrame:
    """(node, part) of every end of an edge, from edges (a, b) of any type that has an order; part is the smallest node that
    can be reached. Loops make a node of their own; edges with a null end are left out.

    Every round moves each node's larger neighbours to its smallest one, then all but that one, so that depths halve; it ends
    when a round changes nothing. A hub's edges are shuffled by their other end too, and its minimum is found by partial
    aggregates. Rounds are written to the shared folder; the last one stays there, as it is the result.
    """
    spark = edges.sparkSession
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    lonely = ends.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("part"))
    rounds, before = [], None
    now = ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        rounds.append(Folder(spark, "parts"))
        now = rounds[-1].save(now)
        for old in rounds[:-1]:
            old.clear()
        rounds = rounds[-1:]
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        up = rounds[-1].save(up)
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        rest = up.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("part")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("part")))
    return found.unionByName(lonely).groupBy("node").agg(F.min("part").alias("part"))

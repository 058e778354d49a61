import itertools
import math

from aerolith.functions import timeops
from aerolith.operators.lines import points_along_lines
from pyspark.sql import functions as F


def test_points_keep_their_distance(spark):
    rows = [
        ("a", [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}]),
        ("a", [{"x": 5.0, "y": -5.0}, {"x": 5.0, "y": 5.0}]),  # crosses
        ("a", [{"x": 0.0, "y": 0.3}, {"x": 0.1, "y": 0.3}]),  # nearer than the spacing
        ("b", [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 1.0}]),
    ]
    out = points_along_lines(spark.createDataFrame(rows, "network_id string, line array<struct<x:double,y:double>>"), 1.0).toPandas()
    for _, p in out.groupby("network_id"):
        pts = list(zip(p["x"], p["y"], strict=True))
        assert all(math.dist(a, b) >= 1 for a, b in itertools.combinations(pts, 2))
    assert len(out[out["network_id"] == "a"]) >= 15 and len(out[out["network_id"] == "b"]) == 1


def test_bin_edges(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-03-01', interval 1 month)) AS t")
    edges = [str(r[0]) for r in timeops.bin_edges(df, "t", "monthly").orderBy("t").collect()]
    assert edges == ["2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00", "2024-03-31 23:59:59.999999"]
    assert df.filter(F.month("t") == 2).count() == 1

"""Line networks: crossings, parts and spaced points against brute force."""

import itertools
import math
import random
from fractions import Fraction

import pytest

from aerolith.operators import network
from aerolith.operators.components import connected_parts

SCHEMA = "net int, line array<struct<x:double,y:double>>, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if p is None else {"x": float(p[0]), "y": float(p[1])} for p in v], "e") for k, v in rows], SCHEMA)


def parts_of(spark, rows, places=0):
    edges = network.split_lines(frame(spark, rows), ["net"], places=places)
    return edges, {(r["net"], r["x"], r["y"]): (r["part_x"], r["part_y"]) for r in network.network_parts(edges, ["net"]).collect()}


def test_crossing_lines_are_one_part(spark):
    edges, parts = parts_of(spark, [(1, [(0, 0), (10, 0)]), (1, [(5, -5), (5, 5)]), (1, [(20, 20), (30, 20)]), (2, [(5, 0), (5, 9)])])
    got = {tuple(r) for r in edges.collect()}
    assert {e[1:] for e in got if e[0] == 1} == {(0, 0, 5, 0), (5, 0, 10, 0), (5, -5, 5, 0), (5, 0, 5, 5), (20, 20, 30, 20)}
    assert {v for k, v in parts.items() if k[0] == 1} == {(0, 0), (20, 20)}
    assert {v for k, v in parts.items() if k[0] == 2} == {(5, 0)}  # networks don't meet


def test_touching_overlapping_and_odd_lines(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (None, [(0, 0), (10, 0)]), (None, [(4, 0), (16, 0)]), (None, [(4, 0), (16, 0)]),  # upon each other, repeated
        (None, [(8, 0), (8, 7)]), (None, [(12, 0)]),  # an end and a lone place on a line
        (3, [(100, 100), (100, 100)]), (3, None), (3, []), (3, [None, (nan, 1), (inf, 2)]),
        (4, [(0, 0), None, (4, 0)]),
    ]
    edges, parts = parts_of(spark, rows)
    got = {tuple(r) for r in edges.collect()}
    assert {e[1:] for e in got if e[0] is None and e[1:3] != e[3:5]} == {(0, 0, 4, 0), (4, 0, 8, 0), (8, 0, 10, 0), (10, 0, 12, 0), (12, 0, 16, 0), (8, 0, 8, 7)}
    assert {v for k, v in parts.items() if k[0] is None} == {(0, 0)}
    assert {e for e in got if e[0] == 3} == {(3, 100, 100, 100, 100)} and {e for e in got if e[0] == 4} == {(4, 0, 0, 4, 0)}
    empty = frame(spark, [(1, None)])
    assert not network.split_lines(empty, ["net"]).collect() and not network.points_along_network(empty, ["net"], 1.0).collect()


def brute_edges(segments):
    """Edges of one network whose crossings are whole numbers."""
    cut = {s: {s[0], s[1]} for s in segments}
    for (a, b), (c, d) in itertools.permutations(segments, 2):
        r, s, q = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1]), (c[0] - a[0], c[1] - a[1])
        across = r[0] * s[1] - r[1] * s[0]
        if across:
            t, u = Fraction(q[0] * s[1] - q[1] * s[0], across), Fraction(q[0] * r[1] - q[1] * r[0], across)
            if 0 <= t <= 1 and 0 <= u <= 1:
                cut[a, b].add((int(a[0] + t * r[0]), int(a[1] + t * r[1])))
        else:
            for p in (c, d):
                if (p[0] - a[0]) * r[1] == (p[1] - a[1]) * r[0] and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
                    cut[a, b].add(p)
    return {e for points in cut.values() for e in itertools.pairwise(sorted(points))}


@pytest.mark.parametrize("crowded", [False, True])
def test_split_equals_all_pairs(spark, crowded):
    """Straight and diagonal segments on every fourth place; all crossings are whole. Long ones and crowded squares too."""
    rnd = random.Random(5)
    wide = 100 if crowded else 3000
    rows, segments = [], set()
    for n in range(300):
        x, y, d = 4 * rnd.randrange(-wide, wide), 4 * rnd.randrange(-wide, wide), rnd.choice([(1, 0), (0, 1), (1, 1), (1, -1), (-1, 0)])
        size = 4 * rnd.randrange(1, 40) if n % 30 else 4 * 4000
        p = (x + d[0] * size, y + d[1] * size)
        rows.append((1, [(x, y), p]))
        segments.add((min((x, y), p), max((x, y), p)))
    edges, parts = parts_of(spark, rows)
    want = brute_edges(segments)
    assert {((r["x0"], r["y0"]), (r["x1"], r["y1"])) for r in edges.collect()} == want
    root = {p: p for e in want for p in e}
    changed = True
    while changed:
        changed = False
        for a, b in want:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert {k[1:]: v for k, v in parts.items()} == root


def test_points_keep_distance_and_cover(spark):
    rnd = random.Random(3)
    rows = [(n % 2, [(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(3)]) for n in range(12)] + [(7, [(1.0, 1.0)])]
    lines = frame(spark, rows)
    out = network.points_along_network(lines, ["net"], 1.0, block=2).collect()
    again = network.points_along_network(lines.repartition(5), ["net"], 1.0, block=2).collect()
    assert sorted(out) == sorted(again)
    for net in (0, 1, 7):
        points = [(r["x"], r["y"]) for r in out if r["net"] == net]
        assert all(math.dist(a, b) >= 1 - 1e-9 for a, b in itertools.combinations(points, 2))
        for line in (v for k, v in rows if k == net):
            for a, b in itertools.pairwise(line):
                for i in range(51):
                    p = (a[0] + (b[0] - a[0]) * i / 50, a[1] + (b[1] - a[1]) * i / 50)
                    assert min(math.dist(p, q) for q in points) < 1.06
    assert [r for r in out if r["net"] == 7] == [(7, 1.0, 1.0)]


def test_parts_of_a_long_chain_and_a_hub(spark):
    chain = [(n, n + 1) for n in range(400)] + [(1000, n) for n in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    random.Random(1).shuffle(chain)
    got = dict(map(tuple, connected_parts(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {n: 0 for n in range(401)} | {n: 1000 for n in range(1000, 1300)} | {5000: 5000}

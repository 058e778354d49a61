"""Points along line networks, at least a spacing apart."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

POINTS = "network_id string, x double, y double"


def _densify(line: np.ndarray, step: float) -> list[tuple[float, float]]:
    out = [tuple(line[0])]
    for a, b in zip(line[:-1], line[1:], strict=True):
        n = max(1, int(np.ceil(np.hypot(*(b - a)) / step)))
        out += [tuple(a + (b - a) * i / n) for i in range(1, n + 1)]
    return [(round(float(x), 5), round(float(y), 5)) for x, y in out]


def spaced_points(lines: list[np.ndarray], spacing: float, factor: float = 0.1) -> list[tuple[float, float]]:
    """Walk each connected part breadth first from its smallest node; keep nodes no nearer than spacing to a kept one."""
    near: dict[tuple[float, float], set] = defaultdict(set)
    for line in lines:
        nodes = _densify(np.asarray(line, float), spacing * factor)
        near[nodes[0]]  # a line of one place is a node too
        for a, b in zip(nodes[:-1], nodes[1:], strict=True):
            if a != b:
                near[a].add(b)
                near[b].add(a)
    kept: dict[tuple[int, int], list[tuple[float, float]]] = defaultdict(list)  # by squares of the spacing
    out, seen = [], set()
    for start in sorted(near):
        queue = deque([start] if start not in seen else [])
        seen.add(start)
        while queue:
            p = queue.popleft()
            i, j = int(np.floor(p[0] / spacing)), int(np.floor(p[1] / spacing))
            around = (q for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for q in kept.get((a, b), ()))
            if all(np.hypot(p[0] - q[0], p[1] - q[1]) >= spacing for q in around):
                kept[i, j].append(p)
                out.append(p)
            for q in sorted(near[p] - seen):
                seen.add(q)
                queue.append(q)
    return out


def points_along_lines(lines: DataFrame, spacing: float, factor: float = 0.1) -> DataFrame:
    """(network_id, x, y) from (network_id, line: array of x, y structs). The rule spans a whole network, so each network
    is one group; networks are spread over tasks."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = spaced_points([np.array([(q["x"], q["y"]) for q in line]) for line in p["line"]], spacing, factor)
        return pd.DataFrame([(p["network_id"].iat[0], *xy) for xy in found], columns=["network_id", "x", "y"])

    return lines.groupBy("network_id").applyInPandas(run, POINTS)

"""Runs in a stream: any cut into micro-batches gives those of the whole."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aerolith.streaming import runs

T0 = dt.datetime(2024, 1, 1)


def by_hand(rows, until, gap, least=3):
    out = []
    for k in {r[0] for r in rows}:
        run = None
        for t, on in sorted((t, bool(on)) for key, t, on in rows if key == k and t is not None and t <= until):
            if run and (not on or t - run[1] > gap):
                out.append((k, *run))
                run = None
            if on:
                run = (run[0], t, run[2] + 1) if run else (t, t, 1)
        if run and until - run[1] > gap:
            out.append((k, *run))
    return sorted(r for r in out if r[3] >= least)


@pytest.mark.parametrize("cuts", [1, 4])
def test_runs_of_a_stream(spark, tmp_path, cuts):
    rng = random.Random(2)
    rows, state = [], {"a": False, "b": True, None: True}
    for i in range(240):
        k = rng.choice(["a", "a", "b", None])
        state[k] = state[k] if rng.random() < 0.8 else not state[k]
        rows.append((k, T0 + dt.timedelta(minutes=10 * i, microseconds=rng.randint(0, 999)), state[k] if rng.random() > 0.05 else None))
    rows.insert(60, ("b", None, True))
    rows.append(("z", T0 + dt.timedelta(days=3), False))  # moves the watermark on, so that all runs are closed by timers
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.PROVIDER)
    try:
        size = -(-len(rows) // cuts)
        for c in range(cuts):
            part = rows[c * size : (c + 1) * size]
            for a in range(0, len(part) - 5, 5):  # out of order, by less than the allowed lateness
                part[a : a + 5] = rng.sample(part[a : a + 5], 5)
            spark.createDataFrame(part, "k string, ts timestamp_ntz, v boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"{c:03d}"))
        stream = spark.readStream.schema("k string, ts timestamp_ntz, v boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = runs.stream_runs(stream, F.col("v"), ["k"], gap="2 hours", late="2 hours", tail="INTERVAL 1 SECOND")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["k"] or "", r["start"], r["end"] - dt.timedelta(seconds=1), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = by_hand([(k or "", t, on) for k, t, on in rows], T0 + dt.timedelta(days=2, hours=22), dt.timedelta(hours=2))
    assert got == want and len(want) > 5

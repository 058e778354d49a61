"""The result cache: reads, recomputes on changed input or arguments, survives failed and simultaneous writers."""

import datetime as dt
import os
import threading

import pytest

from aerolith.sources import cache as rc


@pytest.fixture
def setting(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    calls = []

    def make(least, scale=1):
        calls.append((least, scale))
        return spark.read.parquet(src).filter(f"id >= {least}").selectExpr(f"id * {scale} AS v")

    return rc.ResultCache(spark, "file:" + str(tmp_path / "results")), make, calls, src


def test_results_are_kept(spark, setting):
    cache, make, calls, src = setting
    values = lambda **how: sorted(r["v"] for r in cache.get("f", make, inputs=[src], **how).collect())
    assert values(args={"least": 8}) == values(args={"least": 8}) == [8, 9] and len(calls) == 1
    assert values(args={"least": 8, "scale": 2}) == [16, 18] and len(calls) == 2
    assert values(args={"scale": 2, "least": 8}) == [16, 18] and len(calls) == 2  # the order of arguments says nothing
    assert values(args={"least": 8}, reload=True) == [8, 9] and len(calls) == 3
    spark.range(100, 101).write.mode("append").parquet(src)
    assert values(args={"least": 8}) == [8, 9, 100] and len(calls) == 4
    again = rc.ResultCache(spark, cache.root)
    assert again.get("f", make, {"least": 8}, [src]).count() == 3 and len(calls) == 4
    assert cache.forget("f", keep=[rc.result_key("f", {"least": 8}, [src])]) == 2 and cache.forget("none") == 0
    assert values(args={"least": 8}) == [8, 9, 100] and len(calls) == 4


def test_unfinished_runs_are_not_read(spark, setting):
    cache, make, calls, src = setting
    key = rc.result_key("f", {"least": 9}, [src])
    broken = cache._folder("f", key).removeprefix("file:") + "/run-0"
    os.makedirs(broken)
    spark.range(3).write.parquet(broken + "/x")
    os.remove(broken + "/x/_SUCCESS")
    os.rename(broken + "/x", broken + "-part")
    assert [r["v"] for r in cache.get("f", make, {"least": 9}, [src]).collect()] == [9] and len(calls) == 1

    def fails():
        return spark.range(1).selectExpr("raise_error('no') AS v")

    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            cache.get("g", fails)
    assert cache.runs("g", rc.result_key("g", {})) == []


def test_empty_results_and_writers_at_once(spark, setting):
    cache, make, calls, src = setting
    assert cache.get("f", make, {"least": 99}, [src]).count() == cache.get("f", make, {"least": 99}, [src]).count() == 0 and len(calls) == 1
    got = []
    ts = [threading.Thread(target=lambda: got.append(cache.get("f", make, {"least": 5}, [src]).count())) for _ in range(3)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert got == [5, 5, 5] and cache.get("f", make, {"least": 5}, [src]).count() == 5


def test_keys(tmp_path):
    key = lambda a: rc.result_key("f", {"a": a})
    different = [1, "1", 1.5, None, True, [1], {1}, {"x": 1}, dt.datetime(2020, 1, 1), dt.date(2020, 1, 1), dt.timedelta(1)]
    assert len({key(a) for a in different}) == len(different)
    assert key({3, 1, 2}) == key({2, 3, 1}) and key((1, 2)) == key([1, 2]) and key({"a": 1, "b": 2}) == key({"b": 2, "a": 1})
    with pytest.raises(TypeError):
        key(object())
    with pytest.raises(FileNotFoundError):
        rc.result_key("f", {}, [str(tmp_path / "none")])

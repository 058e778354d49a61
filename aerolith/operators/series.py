"""Baselines, runs, as-of, nearest and interval joins, profiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import physics, timeops
from . import intervals, ordered


def rolling_baseline_keyed(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts", window_us: int = 86_400_000_000, q: float = 0.01, min_periods: int = 1, center: bool = True) -> DataFrame:
    """Quantile and then mean over (t - w/2, t + w/2] (centred) or (t - w, t] of each key, as windows.

    NaN and infinite values count as missing, here as in `rolling_baseline`."""
    us = df.withColumn("_us", timeops.micros(ts)).withColumn("_finite", _finite(value))
    lo, hi = (-(window_us // 2 - 1), window_us // 2) if center else (-(window_us - 1), 0)
    w = Window.partitionBy(*keys).orderBy("_us").rangeBetween(lo, hi)
    at = lambda c, agg: F.when(F.count(c).over(w) >= min_periods, agg)
    low = us.withColumn("_low", at("_finite", F.percentile("_finite", F.lit(q)).over(w)))
    return low.withColumn("baseline", at("_low", F.avg("_low").over(w))).drop("_us", "_low", "_finite")


def _finite(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


#: windows whose quantiles are found at once
WINDOWS = 1 << 15


def _kth(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of values[lo:hi], for many windows: bit by bit of the values' ranks, whose rows are parted
    by each bit in turn, the windows along with them."""
    ranks, code = np.unique(values, return_inverse=True)
    code = code.astype(np.int32)
    lo, hi, k, found = lo.astype(np.int32), hi.astype(np.int32), k.astype(np.int32), np.zeros(len(k), np.int32)
    for bit in range(max(len(ranks) - 1, 0).bit_length() - 1, -1, -1):
        low = (code >> bit) & 1 == 0
        before = np.zeros(len(code) + 1, np.int32)
        np.cumsum(low, out=before[1:])
        a, b = before[lo], before[hi]
        right = k >= b - a
        found[right] |= 1 << bit
        k = np.where(right, k - (b - a), k)
        lo, hi = np.where(right, before[-1] + lo - a, a), np.where(right, before[-1] + hi - b, b)
        code = np.concatenate([code[low], code[~low]])
    return ranks[found]


def _quantiles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
    """The quantile, between two values by their distance, of each values[lo:hi]; NaN if that is empty. lo and hi don't fall."""
    out = np.full(len(lo), np.nan)
    for i in range(0, len(lo), WINDOWS):
        some = np.flatnonzero(hi[i : i + WINDOWS] > lo[i : i + WINDOWS]) + i
        if not len(some):
            continue
        first, last = lo[some[0]], hi[some[-1]]
        a, b = lo[some] - first, hi[some] - first
        place = q * (b - a - 1)
        k = place.astype(np.int64)
        top = np.minimum(k + 1, b - a - 1)
        held = values[first:last]
        # a window lacks so many of the held values at most: its k-th one is among these ranks of them
        least, most = int(k.min()), int((top + len(held) - (b - a)).max())
        ends = np.partition(held, [least, most])[[least, most]]
        below, kept = held < ends[0], (held >= ends[0]) & (held <= ends[1])
        under, place_of = (np.concatenate([[0], np.cumsum(x)]) for x in (below, kept))
        gone = under[b] - under[a]
        a, b = np.tile(place_of[a], 2), np.tile(place_of[b], 2)
        low, high = np.split(_kth(held[kept], a, b, np.concatenate([k - gone, top - gone])), 2)
        out[some] = low + (high - low) * (place - k)
    return out


def _by_halo(df: DataFrame, size: int, back: int, ahead: int, run: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], value: str, into: str) -> DataFrame:
    """df without `value`, with a double `into`: run(values, their order by _us, _us, the places of the bucket's own rows in that
    order) for each bucket of _us, which comes with the rows that the windows (t - back, t + ahead] of its rows hold."""
    kept = [c for c in df.columns if c != value]
    home = F.floor(F.col("_us") / size)
    spread = F.sequence(F.floor((F.col("_us") - ahead) / size), F.floor((F.col("_us") + back) / size))
    # rows of the halo bring their time and value only
    dealt = df.filter("_us IS NOT NULL").withColumn("_home", home).withColumn("_bucket", F.explode(spread))
    here = F.col("_home") == F.col("_bucket")
    rows = dealt.select("_bucket", here.alias("_here"), "_us", value, *[F.when(here, F.col(c)).alias(c) for c in kept if c not in ("_us", value)])
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(into, T.DoubleType())])

    def each(p: pa.Table) -> pa.Table:
        t = p["_us"].to_numpy()
        here = p["_here"].to_numpy()
        order = np.argsort(t, kind="stable")
        mine = order[here[order]]
        got = run(p[value].to_numpy(), order, t, mine)
        out = p.select(kept).take(pa.array(mine))
        return out.append_column(into, pa.array(got, pa.float64(), mask=np.isnan(got)))

    return rows.groupBy("_bucket").applyInArrow(each, schema)


def rolling_baseline(df: DataFrame, value: str = "value", ts: str = "ts", window_us: int = 86_400_000_000, q: float = 0.01, min_periods: int = 1, bucket_us: int | None = None, center: bool = True) -> DataFrame:
    """(ts, value, baseline) of one long series: quantile and then mean over (t - w/2, t + w/2] or, not centred, (t - w, t].

    Quantiles first, then means of these, by buckets of time with a halo of what the windows of their rows hold: a task has the
    times and values of a bucket (a window long by default) and of a window, whatever the series' length.
    """
    size = bucket_us or window_us
    back, ahead = (window_us // 2, window_us // 2) if center else (window_us, 0)
    if size < 1:
        raise ValueError("a bucket has a length")
    least = max(1, min_periods)

    def bounds(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(t, at - back, side="right"), np.searchsorted(t, at + ahead, side="right")

    def quantile(v: np.ndarray, order: np.ndarray, t: np.ndarray, mine: np.ndarray) -> np.ndarray:
        order = order[np.isfinite(v[order])]
        lo, hi = bounds(t[order], t[mine])
        hi = np.where(hi - lo >= least, hi, lo)
        return _quantiles(v[order], lo, hi, q)

    def mean(v: np.ndarray, order: np.ndarray, t: np.ndarray, mine: np.ndarray) -> np.ndarray:
        order = order[~np.isnan(v[order])]
        lo, hi = bounds(t[order], t[mine])
        # sums from the start would lose the last digits of a window's
        total = np.concatenate([np.zeros(1, np.longdouble), np.cumsum(v[order], dtype=np.longdouble)])
        return np.where(hi - lo >= least, (total[hi] - total[lo]) / np.maximum(hi - lo, 1), np.nan).astype(np.float64)

    v = F.col(value).cast("double")
    us = df.select(F.col(ts), F.when(~F.isnan(v), v).alias(value), timeops.micros(ts).alias("_us"))
    low = _by_halo(us.withColumn("_finite", _finite(value)), size, back, ahead, quantile, "_finite", "_low")
    return _by_halo(low, size, back, ahead, mean, "_low", "baseline").select(ts, value, "baseline")


def phase_shift_baseline(df: DataFrame, value: str = "value", ts: str = "ts", n: int = 3600, q: float = 0.01) -> DataFrame:
    """Baseline of each day on a 1 Hz grid: trailing and leading quantiles, their running maxima, Blackman-weighted mean.

    A time that occurs more than once counts with its mean; null times and times between whole seconds take no part.
    """
    n += 1 - n % 2

    def run(p: pd.DataFrame) -> pd.DataFrame:
        s = p.groupby(ts)[value].mean()
        grid = pd.date_range(s.index.min().floor("s"), s.index.max().floor("s"), freq="1s")
        v = s.reindex(grid)
        trail = v.rolling(n, min_periods=1).quantile(q)
        lead = v[::-1].rolling(n, min_periods=1).quantile(q)[::-1]
        a, b = lead.rolling(n, min_periods=1).max(), trail[::-1].rolling(n, min_periods=1).max()[::-1]
        top = np.fmax(a.to_numpy(), b.to_numpy())
        w, ok = np.array(physics.blackman(n)), ~np.isnan(top)
        num, den = np.convolve(np.where(ok, top, 0), w, "same"), np.convolve(ok.astype(float), w, "same")
        if len(top) < n:
            h = n // 2
            num, den = np.convolve(np.where(ok, top, 0), w)[h : h + len(top)], np.convolve(ok.astype(float), w)[h : h + len(top)]
        return pd.DataFrame({ts: grid, "baseline": np.where(den > 1e-12, num / np.maximum(den, 1e-12), np.nan)})

    day = df.select(ts, F.col(value).cast("double").alias(value), F.to_date(ts).alias("_day")).filter(F.col(ts).isNotNull())
    return day.groupBy("_day").applyInPandas(lambda p: run(p.drop(columns="_day")), f"{ts} timestamp_ntz, baseline double")


def thoning(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts", poly: int = 3, harmonics: int = 4, cutoff_days: float = 80.0, step_days: float = 1.0) -> DataFrame:
    """Smooth curve at the original times after Thoning et al. (1989): polynomial and harmonics by least squares, then the
    residuals on an even grid through the low-pass filter exp(-ln 2 (f / fc)^6)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_x")
        some = p[p[value].notna()]
        if len(some) <= poly + 1 + 2 * harmonics:
            return p.assign(smooth=np.nan)[[*keys, ts, "smooth"]]
        x0 = some["_x"].iat[0]

        def design(x: np.ndarray) -> np.ndarray:
            d = x - x0
            return np.column_stack([*(d**i for i in range(poly + 1)), *(f(2 * np.pi * k * x) for k in range(1, harmonics + 1) for f in (np.sin, np.cos))])

        x, y = some["_x"].to_numpy(), some[value].to_numpy()
        coef, *_ = np.linalg.lstsq(design(x), y, rcond=None)
        grid = np.arange(x[0], x[-1] + step_days / 365.25, step_days / 365.25)
        res = np.interp(grid, x, y - design(x) @ coef)
        pad = len(res)
        f = np.fft.rfftfreq(2 * pad, step_days / 365.25)
        low = np.exp(-math.log(2) * (f * cutoff_days / 365.25) ** 6)
        smooth = np.fft.irfft(np.fft.rfft(np.concatenate([res, res[::-1]])) * low, 2 * pad)[: len(res)]
        at = p["_x"].to_numpy()
        return p.assign(smooth=design(at) @ coef + np.interp(at, grid, smooth))[[*keys, ts, "smooth"]]

    src = df.select(*keys, ts, F.col(value).cast("double").alias(value), timeops.decimal_year(ts).alias("_x"))
    fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    return src.groupBy(*keys).applyInPandas(run, ", ".join([*fields, f"{ts} timestamp_ntz", "smooth double"]))


def runs(df: DataFrame, flag: Column, ts: str = "ts", keys: Sequence[str] = (), min_periods: int = 3, tail: str = "INTERVAL '11:59:59' HOUR TO SECOND") -> DataFrame:
    """(event_id, start, end) of at least min_periods flagged rows in a row; a null flag is false. Without keys the series
    is scanned by ranges of time."""
    if not keys:
        cuts = ordered.cuts_of(df, ts)
        long = ordered.flagged_runs(df, flag, ts, cuts).filter(F.col("n") >= min_periods)
        at = ordered.range_by(cuts, "start", df.schema[ts].dataType)
        found = ordered.numbered(long.select("start", (F.col("last") + F.expr(tail)).alias("end")), "start", "event_id", at)
        return found.select("event_id", "start", "end")
    w = Window.partitionBy(*keys).orderBy(ts)
    on = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    turn = on.withColumn("_turn", F.coalesce((F.col("_on") != F.lag("_on").over(w)).cast("int"), F.lit(0)))
    run = turn.withColumn("_run", F.sum("_turn").over(w)).filter("_on")
    found = run.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("start"), (F.max(ts) + F.expr(tail)).alias("end")).filter(F.col("_n") >= min_periods)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1
    return found.select(*keys, number.cast("bigint").alias("event_id"), "start", "end")


def filter_events(df: DataFrame, events: DataFrame, ts: str = "ts", keep: str = "outside") -> DataFrame:
    """Rows outside (or inside) all [start, end], whatever their lengths; rows without a time lie outside."""
    return intervals.within(df, events, ts, {"outside": False, "inside": True}[keep])


def asof(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """left with the latest values of right at or before `on` (of each key): one union and one window.

    Without keys distinct places of left are looked up by ranges; rows without a place get nulls."""
    if not keys:
        spots = left.select(F.col(on).alias("_at")).filter("_at IS NOT NULL").distinct().withColumn("_side", F.lit(1))
        known = right.filter(F.col(on).isNotNull()).select(F.col(on).alias("_at"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
        both = spots.unionByName(known, allowMissingColumns=True)
        got = ordered.carried_last(both, ["_at", "_side"], F.col("_v"), "_found").filter("_side = 1").select("_at", "_found")
        return left.join(got, F.col(on) == F.col("_at"), "left").select(*[left[c] for c in left.columns], *[F.col(f"_found.{v}").alias(v) for v in values])
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*keys, on, F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def nearest_value(left: DataFrame, right: DataFrame, on: str, right_on: str, right_key: str) -> DataFrame:
    """left with the key and value of right that is nearest along one axis (ties to the smaller key).

    The nearest below and above come from two ordered scans by ranges over the distinct places of both, not from all
    pairs. Rows without a place get nulls, and so do all if right has none.
    """
    a = left.select(F.col(on).alias("_x")).filter("_x IS NOT NULL").distinct().withColumn("_side", F.lit(1))
    b = right.filter(F.col(right_on).isNotNull()).groupBy(F.col(right_on).alias("_x")).agg(F.min(right_key).alias("_k")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    pair = F.when(F.col("_side") == 0, F.struct(F.col("_x").alias("x"), F.col("_k").alias("k")))
    at = ordered.range_of(both, "_x")
    seen = ordered.carried_last(both, ["_x", "_side"], pair, "_lo", at=at)
    seen = ordered.carried_last(seen, ["_x", "_side"], pair, "_hi", down=True, at=at)
    dist = lambda c: F.abs(F.col(f"{c}.x") - F.col("_x"))
    low = F.col("_hi").isNull() | (dist("_lo") < dist("_hi")) | ((dist("_lo") == dist("_hi")) & (F.col("_lo.k") <= F.col("_hi.k")))
    best = F.when(F.col("_lo").isNotNull() & low, F.col("_lo")).otherwise(F.col("_hi"))
    found = seen.filter("_side = 1").select("_x", best.alias("_b"))
    return left.join(found, F.col(on) == F.col("_x"), "left").select(*[left[c] for c in left.columns], F.col("_b.k").alias("nearest_key"), F.col("_b.x").alias("nearest_value"))


def interpolate_profiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], height: str = "height", start: float = 1289, stop: float = 5000, interval: float = 10) -> DataFrame:
    """Each value at regular heights: linear between its own samples, null below the first, the last one carried above."""
    steps = F.transform(F.expr(f"sequence(0, {math.ceil((stop - start) / interval) - 1})"), lambda i: i * float(interval) + float(start))
    grid = df.select(*keys).distinct().withColumn(height, F.explode(steps))
    raw = df.withColumn(height, F.col(height).cast("double")).withColumn("_kind", F.lit(0))
    both = raw.select(*keys, height, *values, "_kind").unionByName(grid.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    below = Window.partitionBy(*keys).orderBy(height, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys).orderBy(F.desc(height), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        at = F.when(F.col(v).isNotNull(), F.struct(F.col(height).alias("h"), F.col(v).alias("v")))
        both = both.withColumn(f"_{v}_lo", F.last(at, True).over(below)).withColumn(f"_{v}_hi", F.last(at, True).over(above))
    out = [*keys, height]
    for v in values:
        lo, hi = F.col(f"_{v}_lo"), F.col(f"_{v}_hi")
        line = lo["v"] + (hi["v"] - lo["v"]) * F.try_divide(F.col(height) - lo["h"], hi["h"] - lo["h"])
        out.append(F.when(lo.isNull(), None).when(hi.isNull() | (lo["h"] == hi["h"]) | (lo["h"] == F.col(height)), lo["v"]).otherwise(line).alias(v))
    return both.filter("_kind = 1").select(*out)


def trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: Column | str) -> DataFrame:
    """The integral of y over x for each key; null if a y is null."""
    w = Window.partitionBy(*keys).orderBy(x)
    f = df.withColumn("_y", F.col(y) if isinstance(y, str) else y)
    piece = f.withColumn("_p", (F.col("_y") + F.lag("_y").over(w)) / 2 * (F.col(x) - F.lag(x).over(w)))
    return piece.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == F.count("_y"), F.sum("_p")).alias("integral"))


def valley_heat_deficit(df: DataFrame, keys: Sequence[str] = ("station", "time"), top: float = 2200.0, interval: float = 10.0) -> DataFrame:
    """MJ m-2 from regular profiles with height, temperature (degC), pressure (hPa) and elevation.

    Levels that are null at all times are left out; a null at one time makes that time null. A profile is gathered once, as an
    array of its levels; which levels count is a small table beside it, asked only for profiles with a null.
    """
    level = F.struct("height", physics.potential_temperature("_t", "_p").alias("theta"), F.col("_p").alias("p"))
    d = df.filter(F.col("height").between(F.col("elevation"), F.lit(top))).withColumn("_t", F.col("temperature") + 273.15).withColumn("_p", F.col("pressure") * 100)
    d = d.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("_a"))
    a, z = F.col("_a"), F.col("_z")
    layer = lambda i: F.lit(interval * physics.G / physics.RD) / F.ln(F.get(a, i)["p"] / F.get(a, i + 1)["p"])
    deficit = lambda x, i: F.lit(physics.CP) * x["p"] / (physics.RD * (layer(i) + layer(i - 1)) / 2) * (F.get(a, F.size(a) - 1)["theta"] - x["theta"])
    d = d.select(*keys, F.transform(a, lambda x, i: F.struct(x["height"].alias("h"), deficit(x, i).alias("f"))).alias("_z"))
    some, none = F.filter(z, lambda x: x["f"].isNotNull()), F.filter(z, lambda x: x["f"].isNull())
    used = d.select(F.explode(some).alias("x")).select(F.col("x.h").alias("_h")).distinct()
    holes = d.select(*keys, F.explode(F.transform(none, lambda x: x["h"])).alias("_h")).join(used, "_h", "left_semi")
    sums = F.aggregate(some, F.struct(F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("s")), lambda s, x: F.struct(x["h"].cast("double").alias("h"), x["f"].alias("f"), F.when(s["h"].isNull(), s["s"]).otherwise(F.coalesce(s["s"], F.lit(0.0)) + (x["f"] + s["f"]) / 2 * (x["h"] - s["h"])).alias("s")))["s"]
    whole = d.filter(F.size(some) > 0).select(*keys, sums.alias("_s"), F.lit(False).alias("_hole"))
    both = whole.unionByName(holes.select(*keys, F.lit(None).cast("double").alias("_s"), F.lit(True).alias("_hole")))
    return both.groupBy(*keys).agg((F.when(~F.max("_hole"), F.max("_s")) / 1e6).alias("VHD_MJ_m2"))


def difference_pairs(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", decay_s: float | None = None, absolute: bool = True, within_us: int | None = None) -> DataFrame:
    """(keys, i, j, seconds or decay weight) for all pairs of times of a key: the output itself is a square matrix.

    With within_us only pairs that lie no further apart; they meet by stretches of that length.
    """
    a = df.select(*keys, F.col(ts).alias("i"), timeops.micros(ts).alias("_i"))
    b = df.select(*keys, F.col(ts).alias("j"), timeops.micros(ts).alias("_j"))
    if within_us:
        stretch = F.floor(F.col("_i") / within_us)
        a = a.withColumn("_s", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
        both = a.join(b.withColumn("_s", F.floor(F.col("_j") / within_us)), [*keys, "_s"]).filter(F.abs(F.col("_j") - F.col("_i")) <= within_us)
    else:
        both = a.join(b, list(keys)) if keys else a.crossJoin(b)
    d = (F.col("_j") - F.col("_i")) / 1e6
    out = F.exp(-F.abs(d) / decay_s).alias("weight") if decay_s else (F.abs(d) if absolute else d).alias("seconds")
    return both.select(*keys, "i", "j", out)

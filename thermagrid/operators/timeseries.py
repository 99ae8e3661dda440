"""Per-pixel series: gap filling and smoothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radiometry import valid_ndvi

#: Savitzky-Golay weights for window 11, order 2 and window 5, order 3.
WIDE = [x / 429 for x in (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)]
NARROW = [x / 35 for x in (-3, 12, 17, 12, -3)]


def savgol(values: Column, weights: list[float]) -> Column:
    """Array filtered with fixed weights; the ends repeat the first and last element."""
    half, last = len(weights) // 2, F.size(values) - 1

    def at(i: Column) -> Column:
        total = F.lit(0.0)
        for k, w in enumerate(weights):
            total = total + F.get(values, F.greatest(F.least(i + (k - half), last), F.lit(0))) * w
        return total

    return F.transform(F.sequence(F.lit(0), last), at)


def series(df: DataFrame, value: str, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """(keys, s): each pixel's values as an array of (d, v) in order of day."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", F.col(value).alias("v")))).alias("s"))


def smoothed(df: DataFrame, value: str, envelope: bool = False, rounds: int = 3) -> DataFrame:
    """Wide filter once, then the narrow one ``rounds`` times, over gap-free series; stays in the JVM.

    envelope replaces each value below its original by it, between rounds; off by default, as the step has no effect
    in the method as published."""
    rows = series(df, value).withColumn("x", F.transform("s", lambda e: e["v"]))
    rows = rows.withColumn("y", savgol(F.col("x"), WIDE))
    for _ in range(rounds):
        if envelope:
            rows = rows.withColumn("y", F.zip_with("y", "x", lambda a, b: F.greatest(a, b)))
        rows = rows.withColumn("y", savgol(F.col("y"), NARROW))
    pairs = F.zip_with("s", "y", lambda e, y: F.struct(e["d"].alias("d"), y.alias("v")))
    return rows.select("r", "c", F.inline(pairs)).select("d", "r", "c", F.col("v").alias(value))


def ends_held(df: DataFrame, value: str) -> DataFrame:
    """NULLs before the first and after the last valid day take its value; gaps inside stay."""
    w = Window.partitionBy("r", "c").orderBy("d")
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    held = F.when(before.isNull(), after).when(after.isNull(), before).otherwise(F.col(value))
    return df.select("d", "r", "c", held.alias(value))


def linear_filled(df: DataFrame, value: str) -> DataFrame:
    """Gaps inside filled on a straight line over days; ends stay."""
    w = Window.partitionBy("r", "c").orderBy("d")
    known = F.when(F.col(value).isNotNull(), F.struct("d", F.col(value).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = F.datediff(b["d"], a["d"])
    line = a["v"] + (b["v"] - a["v"]) * F.datediff(F.col("d"), a["d"]) / F.when(gap > 0, gap)
    return df.select("d", "r", "c", F.coalesce(value, line).alias(value))


def quadratic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating splines of degree 2, one for each row of x (ascending sites) and y, at the points of at.

    Knots lie midway between sites but for the outermost two gaps' ends."""
    n, degree = x.shape[1], 2
    middle = (x[:, 1:] + x[:, :-1]) / 2
    knots = np.concatenate([np.repeat(x[:, :1], degree + 1, 1), middle[:, 1:-1], np.repeat(x[:, -1:], degree + 1, 1)], 1)

    def basis(points: np.ndarray) -> np.ndarray:
        inside = np.clip((knots[:, None, :] <= points[:, :, None]).sum(2) - 1, degree, n - 1)
        b = (inside[:, :, None] == np.arange(knots.shape[1] - 1)).astype(float)
        for p in range(1, degree + 1):
            width = knots[:, p:] - knots[:, :-p]
            inverse = np.where(width > 0, 1 / np.where(width > 0, width, 1), 0.0)[:, None, :]
            rising = (points[:, :, None] - knots[:, None, :-p]) * inverse
            falling = (knots[:, None, p:] - points[:, :, None]) * inverse
            b = rising[:, :, :-1] * b[:, :, :-1] + falling[:, :, 1:] * b[:, :, 1:]
        return b

    return (basis(at) @ np.linalg.solve(basis(x), y[:, :, None]))[:, :, 0]


#: Numbers that one array of a batched kernel has at most.
HELD = 1 << 22


def _batched(df: DataFrame, value: str, fill: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(d, r, c, value) with the value of whole series from fill(days, values): rows are pixels, NaN is missing.

    Pixels travel as one array of days each; those of one length are solved together."""
    rows = series(df.select("d", "r", "c", F.col(value).cast("double").alias(value)), value)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("s")
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            d, v = flat.field(0).cast(pa.int32()).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False).astype(float)
            out, length = np.full(len(v), np.nan), np.diff(cuts)
            for n in np.unique(length[length > 0]).tolist():
                same = np.flatnonzero(length == n)
                step = max(1, HELD // (n * n))
                for a in range(0, len(same), step):
                    at = cuts[same[a : a + step], None] + np.arange(n)
                    days = (d[at] - d[at[:, :1]]).astype(float)
                    out[at] = fill(days, v[at])
            filled = pa.StructArray.from_arrays([flat.field(0), pa.array(out, mask=~np.isfinite(out))], ["d", "v"])
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("c"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), filled)], ["r", "c", "s"])

    done = rows.mapInArrow(apply, rows.schema)
    return done.select("r", "c", F.inline("s")).select("d", "r", "c", F.col("v").alias(value))


def spline_filled(df: DataFrame, value: str, least: int = 4, else_missing: bool = False) -> DataFrame:
    """Gaps by quadratic spline over day numbers and ends held, for pixels with ``least`` valid days; others unchanged,
    or NULL on all days if ``else_missing``.  A pixel whose spline is not finite is NULL on all days."""

    def fill(day: np.ndarray, v: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(v)
        out, count = v.copy(), ok.sum(1)
        if else_missing:
            out[count < least] = np.nan
        for n in np.unique(count[count >= least]).tolist():
            some = np.flatnonzero(count == n)
            there = ok[some]
            x, y = day[some][there].reshape(-1, n), v[some][there].reshape(-1, n)
            smooth = quadratic_spline(x, y, np.clip(day[some], x[:, :1], x[:, -1:]))
            held = np.where(day[some] < x[:, :1], y[:, :1], np.where(day[some] > x[:, -1:], y[:, -1:], smooth))
            whole = np.where(there, v[some], held)
            whole[~np.isfinite(whole).all(1)] = np.nan
            out[some] = whole
        return out

    return _batched(df, value, fill)


def ssa(v: np.ndarray, window: int, rank: int, rounds: int = 10) -> np.ndarray:
    """Singular spectrum reconstruction of each row: trajectory matrix, its part in the leading singular vectors and
    diagonal averages, repeated with the missing entries replaced by the reconstruction until they stay."""
    ok = ~np.isnan(v)
    x = np.where(ok, v, (np.where(ok, v, 0).sum(1) / ok.sum(1))[:, None])
    n = v.shape[1]
    k = n - window + 1
    index = np.arange(window)[:, None] + np.arange(k)
    weight = np.bincount(index.ravel(), minlength=n)
    y, todo = x.copy(), np.arange(len(v))
    for _ in range(rounds):
        path = x[todo][:, index]
        _, vectors = np.linalg.eigh(path @ path.transpose(0, 2, 1))
        lead = vectors[:, :, -rank:]
        near = lead @ (lead.transpose(0, 2, 1) @ path)
        total = np.zeros((len(todo), n))
        for i in range(window):
            total[:, i : i + k] += near[:, i]
        y[todo] = total / weight
        new = np.where(ok[todo], v[todo], y[todo])
        moved = np.abs(new - x[todo]).max(1) >= 1e-9
        x[todo] = new
        todo = todo[moved]
        if not len(todo):
            break
    return y


def ssa_filled(df: DataFrame, value: str, window: int = 10, rank: int = 3, least: int = 5) -> DataFrame:
    """Values that are missing or not positive come from the reconstruction.  A pixel with no positive value becomes
    NULL; one with fewer than ``least``, or with less than two windows of days, stays as it is."""

    def fill(day: np.ndarray, v: np.ndarray) -> np.ndarray:
        ok = v > 0
        count = ok.sum(1)
        out = np.where((count > 0)[:, None], v, np.nan)
        some = np.flatnonzero(count >= max(1, least)) if v.shape[1] >= 2 * window else []
        if len(some):
            out[some] = np.where(ok[some], v[some], ssa(np.where(ok[some], v[some], np.nan), window, rank))
        return out

    return _batched(df, value, fill)


def vegetation_smoothed(df: DataFrame, value: str, roi: DataFrame, envelope: bool = False, least: int = 4) -> DataFrame:
    """The vegetation chain over df (d, r, c, value) inside roi (r, c, roi = 1): values outside [-1, 1] are missing, gaps
    are filled by spline with the ends held, then smoothed.

    A pixel with fewer than ``least`` valid days is NULL on all of them; one outside the ROI gives no row."""
    inside = df.join(roi.where("roi = 1").select("r", "c"), ["r", "c"])
    valid = inside.select("d", "r", "c", valid_ndvi(F.col(value)).alias(value))
    return smoothed(spline_filled(valid, value, least, else_missing=True), value, envelope)


def usable(df: DataFrame, value: str, least: int) -> DataFrame:
    """Number of valid days of each pixel that has at least ``least``."""
    return df.groupBy("r", "c").agg(F.count(value).alias("n")).where(F.col("n") >= least)



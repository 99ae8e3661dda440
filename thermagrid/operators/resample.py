"""Resampling between grids: area weights and separable kernels as equi-joins with small axis tables, and hole filling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """One axis of a grid: where its first cell begins, the signed size of a cell, and the number of cells."""

    origin: float
    step: float
    cells: int

    def end(self) -> float:
        return self.origin + self.step * self.cells


@dataclass(frozen=True)
class Grid:
    """A north-up grid: rows run from max_y down, columns from min_x to the right."""

    rows: Axis
    cols: Axis

    @classmethod
    def of(cls, min_x: float, max_y: float, dx: float, dy: float, rows: int, cols: int) -> Grid:
        return cls(Axis(max_y, -dy, rows), Axis(min_x, dx, cols))

    @classmethod
    def index(cls, shape: tuple[int, int]) -> Grid:
        """A grid without a place: the unit square in shape[0] x shape[1] cells."""
        return cls(Axis(0.0, 1 / shape[0], shape[0]), Axis(0.0, 1 / shape[1], shape[1]))


def keys_cubic(d: Column, a: float = -0.75) -> Column:
    d = F.abs(d)
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def cubic_bspline(d: Column) -> Column:
    d = F.abs(d)
    return F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)


def linear(d: Column) -> Column:
    return F.greatest(1 - F.abs(d), F.lit(0.0))


def lanczos(d: Column, a: int = 3) -> Column:
    x = F.abs(d) * math.pi
    return F.when(F.abs(d) < 1e-12, 1.0).when(F.abs(d) < a, a * F.sin(x) * F.sin(x / a) / (x * x)).otherwise(0.0)


#: method: (offset of the first tap, offset of the last, weight)
KERNELS = {"bilinear": (0, 1, linear), "cubic": (-1, 2, keys_cubic), "bspline": (-1, 2, cubic_bspline), "lanczos": (-2, 3, lanczos)}
METHODS = ("average", "nearest", *KERNELS)


def _taps(spark, source: Axis, target: Axis, method: str) -> DataFrame:
    """(to, at, w): the source cells that each target cell of an axis is made of.

    One row for each target cell and tap, so a few for each row or column of a grid: it is broadcast.  Kernels have
    half-pixel centres and repeat the border cell; a target cell whose centre is outside the source has no taps."""
    cells = spark.range(target.cells).select(F.col("id").cast("int").alias("to"))
    if method == "average":
        # edges in source cells, ascending
        ends = sorted(((target.origin - source.origin) / source.step, (target.end() - source.origin) / source.step))
        width = (ends[1] - ends[0]) / target.cells
        low = F.col("to") * width + ends[0]
        first, last = F.floor(low + 1e-9), F.ceil(low + width - 1e-9) - 1
        cells = cells.select("to", low.alias("low"), F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(F.least(last, F.lit(source.cells - 1)), F.greatest(first, F.lit(0))))).alias("at"))
        share = F.least(F.col("low") + width, F.col("at") + 1) - F.greatest(F.col("low"), F.col("at"))
        return cells.select("to", F.col("at").cast("int").alias("at"), share.alias("w")).where(f"w > 1e-9 and at < {source.cells}")
    scale, offset = target.step / source.step, (target.origin - source.origin) / source.step
    if method == "nearest":
        at = F.floor(F.col("to") * scale + offset + 1e-9) if offset == 0 else F.floor((F.col("to") + 0.5) * scale + offset)
        cells = cells.select("to", at.cast("int").alias("at"), F.lit(1.0).alias("w"))
        return cells.where(f"at between 0 and {source.cells - 1}")
    if method not in KERNELS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    first, last, weight = KERNELS[method]
    spot = (F.col("to") + 0.5) * scale + offset - 0.5
    cells = cells.select("to", spot.alias("s")).where(F.col("s").between(-0.5 - 1e-9, source.cells - 0.5 + 1e-9))
    cells = cells.select("to", "s", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("k"))
    at = F.floor("s") + F.col("k")
    held = F.least(F.greatest(at, F.lit(0)), F.lit(source.cells - 1)).cast("int")
    return cells.select("to", held.alias("at"), weight(F.col("s") - at).alias("w"))


def warp(df: DataFrame, value: str, source: Grid, target: Grid, method: str, keys: tuple[str, ...] = ("d",), whole: bool = False) -> DataFrame:
    """df (keys, r, c, value) of the source grid on the target grid: average, nearest, bilinear, cubic, bspline or lanczos.

    Weights are separable, so columns are resampled first and rows then: each source pixel meets the few taps of its
    column in a broadcast table of the axis, and partial sums shrink or grow one axis at a time.  Missing source cells
    are left out and the weights of the others count in full; with ``whole``, one missing cell makes the target cell
    NULL.  A target cell that no source cell reaches gives no row, one whose cells are all missing NULL."""
    spark = df.sparkSession
    columns, rows = (F.broadcast(_taps(spark, a, b, method)) for a, b in ((source.cols, target.cols), (source.rows, target.rows)))
    held = df.select(*keys, "r", "c", F.col(value).alias("__v"))
    if method == "nearest":
        across = held.join(columns, F.col("c") == F.col("at")).select(*keys, "r", F.col("to").alias("c"), "__v")
        return across.join(rows, F.col("r") == F.col("at")).select(*keys, F.col("to").alias("r"), "c", F.col("__v").alias(value))
    taps = 0 if method == "average" else KERNELS[method][1] - KERNELS[method][0] + 1
    there = F.when(F.col("__v").isNotNull(), F.col("w"))
    across = held.join(columns, F.col("c") == F.col("at")).groupBy(*keys, "r", F.col("to").alias("c")).agg(
        F.sum(F.col("w") * F.col("__v")).alias("__s"), F.sum(there).alias("__w"), F.count("__v").alias("__n")
    )
    if whole and taps:
        across = across.where(F.col("__n") == taps)
    done = across.join(rows, F.col("r") == F.col("at")).groupBy(*keys, F.col("to").alias("r"), "c").agg(
        F.sum(F.col("w") * F.col("__s")).alias("__s"), F.sum(F.col("w") * F.col("__w")).alias("__w"), F.count("__s").alias("__n")
    )
    out = F.col("__s") if whole and taps else F.col("__s") / F.when(F.abs("__w") > 1e-12, F.col("__w"))
    out = F.when(F.col("__n") == taps, out) if whole and taps else out
    return done.select(*keys, "r", "c", out.alias(value))


def area_average(df: DataFrame, value: str, ratio: int, keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """Mean of the valid fine cells of each coarse cell, where a whole number of them fits: one aggregate."""
    return df.groupBy(*keys, F.expr(f"cast(r div {ratio} as int)").alias("r"), F.expr(f"cast(c div {ratio} as int)").alias("c")).agg(F.avg(value).alias(value))


def area_resized(df: DataFrame, value: str, high: tuple[int, int], low: tuple[int, int], keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """Mean of the valid fine cells of each coarse cell, weighted by the share of them inside it, for any ratio."""
    if high[0] % low[0] == 0 and high[1] % low[1] == 0 and high[0] // low[0] == high[1] // low[1]:
        return area_average(df, value, high[0] // low[0], keys)
    return warp(df, value, Grid.index(high), Grid.index(low), "average", keys)


def resize(coarse: DataFrame, fine: DataFrame | None, value: str, low: tuple[int, int], high: tuple[int, int], method: str, keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """coarse (keys, r, c, value) in ``high`` instead of ``low`` cells, at the cells of fine (r, c) or at all.

    Index space: grids share their outline.  A NULL or absent tap makes the cell NULL or absent, so holes are filled
    first."""
    done = warp(coarse, value, Grid.index(low), Grid.index(high), method, keys, whole=True)
    return done if fine is None else done.join(fine.select("r", "c"), ["r", "c"], "left_semi").select(*keys, "r", "c", value)


def nearest_filled(df: DataFrame, value: str, keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """df (keys, r, c, value), with a row for each cell of the grid, and each NULL taken from the nearest valid cell of
    its key; ties: smallest row, then column.  A key without a valid cell keeps its NULLs.

    The distance is separable: down each column, the nearest valid cell of every cell by two windows; then along each
    row, the best of its columns' cells, for all holes of the row at once, outwards until none can be nearer.  No task
    holds more than one column or one row of one key."""
    names = [*keys, "r", "c"]
    down = "partition by {} order by r rows between".format(", ".join(f"`{k}`" for k in (*keys, "c")))
    spot = f"case when `{value}` is not null then struct(r, cast(`{value}` as double) as v) end"
    cells = df.select(
        *names,
        F.expr(f"last({spot}, true) over ({down} unbounded preceding and current row)").alias("above"),
        F.expr(f"first({spot}, true) over ({down} current row and unbounded following)").alias("below"),
    )
    best = F.when(F.col("below").isNull() | (F.col("r") - F.col("above.r") <= F.col("below.r") - F.col("r")), F.col("above")).otherwise(F.col("below"))
    cells = cells.select(*names, best.alias("b")).select(*names, F.col("b.r").alias("vr"), F.col("b.v").alias("v"))
    rows = cells.groupBy(*keys, "r").agg(F.array_sort(F.collect_list(F.struct("c", "vr", "v"))).alias("cells"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("cells")
            cuts = lists.offsets.to_numpy()
            flat = lists.flatten()
            c, vr, v = (flat.field(k) for k in range(3))
            c, v = c.to_numpy(), v.to_numpy(zero_copy_only=False).astype(float)
            there = vr.is_valid().to_numpy(zero_copy_only=False)
            vr = vr.fill_null(-1).to_numpy().astype(np.int64)
            out = np.full(len(c), np.nan)
            for row, x, y in zip(b.column("r").to_pylist(), cuts, cuts[1:], strict=False):
                out[x - cuts[0] : y - cuts[0]] = _along(row, *(z[x - cuts[0] : y - cuts[0]] for z in (c, vr, v, there)))
            filled = pa.array(out, mask=np.isnan(out))
            both = pa.StructArray.from_arrays([pa.array(c, pa.int32()), filled], ["c", "v"])
            part = pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), both)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (*keys, "r")), part], [*keys, "r", "cells"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "cells")
    done = rows.mapInArrow(fill, f"{kinds}, cells array<struct<c: int, v: double>>")
    return done.select(*keys, "r", F.inline("cells")).select(*keys, "r", "c", F.col("v").alias(value))


def _along(row: int, c: np.ndarray, vr: np.ndarray, v: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Values of one row's cells at columns c (ascending), from the nearest valid cells (vr, c) of their columns."""
    if not there.any():
        return np.full(len(c), np.nan)
    wide = int(c[-1] - c[0]) + 1
    far = 1 << 62
    down = np.full(wide, far)
    at, rows, values = np.full(wide, -1), np.zeros(wide, np.int64), np.full(wide, np.nan)
    at[c - c[0]] = np.arange(len(c))
    down[c - c[0]] = np.where(there, (vr - row) ** 2, far)
    rows[c - c[0]], values[c - c[0]] = vr, v
    hole = np.flatnonzero((at >= 0) & (down > 0))
    best, from_row, from_col = down[hole].copy(), rows[hole].copy(), hole.copy()
    todo = np.arange(len(hole))
    for k in range(1, wide):
        todo = todo[best[todo] >= k * k]
        if not len(todo):
            break
        for side in (-k, k):
            spot = hole[todo] + side
            inside = (spot >= 0) & (spot < wide)
            some, spot = todo[inside], spot[inside]
            d2 = np.where(down[spot] < far, down[spot] + k * k, far)
            nearer = (d2 < best[some]) | (
                (d2 == best[some]) & (d2 < far) & ((rows[spot] < from_row[some]) | ((rows[spot] == from_row[some]) & (spot < from_col[some])))
            )
            some, spot = some[nearer], spot[nearer]
            best[some], from_row[some], from_col[some] = d2[nearer], rows[spot], spot
    out = values.copy()
    out[hole] = np.where(best < far, values[from_col], np.nan)
    return out[c - c[0]]

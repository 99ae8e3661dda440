"""Regression downscaling: a plane over vegetation and elevation for each day, and the resampled residual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import Grid, area_resized, nearest_filled, resize, warp


def plane(samples: DataFrame, y: str = "lst", x1: str = "ndvi", x2: str = "dem") -> DataFrame:
    """(d, a, b, k): least squares y = a * x1 + b * x2 + k for each day, from centred moments in one aggregate.

    A constant x1 has coefficient 0, as the least-norm solution of an absent, all-zero layer."""
    m = samples.groupBy("d").agg(
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    flat1, flat2 = F.col("s11") == 0, F.col("s22") == 0
    a = F.when(flat1, 0.0).when(flat2, F.col("s1y") / F.col("s11")).otherwise((F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det)
    b = F.when(flat2, 0.0).when(flat1, F.col("s2y") / F.col("s22")).otherwise((F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det)
    return m.withColumn("a", a).withColumn("b", b).select("d", "a", "b", (F.col("my") - F.col("a") * F.col("m1") - F.col("b") * F.col("m2")).alias("k"))


def downscaled(coarse: DataFrame, coarse_static: DataFrame, fine_static: DataFrame, low: tuple[int, int], high: tuple[int, int], method: str = "cubic") -> DataFrame:
    """(d, r, c, lst) at the fine cells: the day's plane there plus its coarse residual, resampled.

    coarse (d, r, c, lst) has no holes; the static layers (r, c, ndvi, dem) are on the two grids."""
    samples = coarse.join(coarse_static, ["r", "c"])
    fit = plane(samples)
    trend = F.col("a") * F.col("ndvi") + F.col("b") * F.col("dem") + F.col("k")
    # a plane is three numbers a day
    residual = samples.join(F.broadcast(fit), "d").select("d", "r", "c", (F.col("lst") - trend).alias("residual"))
    spread = resize(residual, None, "residual", low, high, method)
    return spread.join(fine_static, ["r", "c"]).join(F.broadcast(fit), "d").select("d", "r", "c", (trend + F.col("residual")).alias("lst"))


def regression_samples(coarse: DataFrame, fine_static: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """(d, r, c, lst, ndvi, dem): what each day's plane is fitted to, holes of every layer filled from the nearest cell
    and the fine layers averaged to the coarse grid, whatever the ratio."""
    full = nearest_filled(coarse, "lst")
    return full.join(_means(fine_static, low, high), ["r", "c"]).select("d", "r", "c", "lst", "ndvi", "dem")


def _means(fine_static: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    layers = [area_resized(nearest_filled(fine_static.select("r", "c", x), x, keys=()), x, high, low, keys=()) for x in ("ndvi", "dem")]
    return layers[0].join(layers[1], ["r", "c"])


def filled_downscaled(coarse: DataFrame, fine_static: DataFrame, low: tuple[int, int], high: tuple[int, int], method: str = "cubic") -> DataFrame:
    """downscaled() of a grid with holes: coarse (d, r, c, lst, NULL in holes) and the static layers are filled from the
    nearest cell, the layers averaged to the coarse grid, and what output_mask() does not allow left out."""
    full = nearest_filled(coarse, "lst")
    layers = [nearest_filled(fine_static.select("r", "c", x), x, keys=()) for x in ("ndvi", "dem")]
    done = downscaled(full, _means(fine_static, low, high), layers[0].join(layers[1], ["r", "c"]), low, high, method)
    return done.join(output_mask(coarse, fine_static, low, high), ["d", "r", "c"], "left_semi")


def output_mask(coarse: DataFrame, fine_static: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """(d, r, c) of the fine cells whose nearest coarse cell has a value that day and whose elevation is known."""
    there = coarse.select("d", "r", "c", F.col("lst").isNotNull().cast("double").alias("there"))
    near = warp(there, "there", Grid.index(low), Grid.index(high), "nearest").where("there > 0.5")
    return near.join(fine_static.where("dem is not null").select("r", "c"), ["r", "c"], "left_semi").select("d", "r", "c")

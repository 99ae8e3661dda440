"""Mosaics of overlapping scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("max", "min", "mean", "first", "last")


def mosaic(df: DataFrame, method: str, keys: tuple[str, ...] = ("d", "r", "c"), value: str = "v", order: str = "scene") -> DataFrame:
    """One value for each pixel from all scenes that have one: max, min, mean, or first or last by ``order``.

    NULL is skipped, so a pixel without any valid value is NULL.  A single hash aggregate with partial sums."""
    v = F.col(value)
    by = F.when(v.isNotNull(), F.col(order))
    how = {"max": F.max(v), "min": F.min(v), "mean": F.avg(v), "first": F.min_by(v, by), "last": F.max_by(v, by)}
    if method not in how:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    return df.groupBy(*keys).agg(how[method].alias(value))


def shifted(df: DataFrame, x0: str, y0: str, min_x: float, max_y: float, dx: float, dy: float) -> DataFrame:
    """Scene rows and columns in the union grid of all scenes; offsets within 1e-6 of a cell are rounded to it."""

    def cells(offset):
        near = F.round(offset)
        return F.when(F.abs(offset - near) < 1e-6, near).otherwise(F.floor(offset)).cast("int")

    return df.withColumn("c", F.col("c") + cells((F.col(x0) - min_x) / dx)).withColumn("r", F.col("r") + cells((max_y - F.col(y0)) / dy))


def overlaps(extents: DataFrame, tile: int) -> DataFrame:
    """(keys, tile_r, tile_c, r0, r1, c0, c1): the tiles that each extent (keys, min_r, max_r, min_c, max_c) touches,
    and the rows and columns of it, ends included, that lie in the tile.

    An extent is exploded into its own tiles, so scenes and tiles meet by equality and not by a range join."""
    rows, cols = (F.sequence(F.floor(F.col(f"min_{x}") / tile), F.floor(F.col(f"max_{x}") / tile)) for x in "rc")
    spread = extents.withColumn("tile_r", F.explode(rows)).withColumn("tile_c", F.explode(cols))
    for x in "rc":
        first = F.col(f"tile_{x}") * tile
        spread = spread.withColumn(f"{x}0", F.greatest(F.col(f"min_{x}"), first).cast("int")).withColumn(f"{x}1", F.least(F.col(f"max_{x}"), first + tile - 1).cast("int"))
        spread = spread.withColumn(f"tile_{x}", F.col(f"tile_{x}").cast("int"))
    return spread.drop("min_r", "max_r", "min_c", "max_c")

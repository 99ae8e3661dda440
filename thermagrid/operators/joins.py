"""Calendar and availability joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spined(spine: DataFrame, found: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Every day of the spine with its pixel count and status: ok, missing, or error where ``failed`` (d) names it.

    Missing days stay in; found has a row for each pixel."""
    counts = found.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    rows = spine.join(counts, "d", "left")
    status = F.when(F.col("n").isNull(), "missing").otherwise("ok")
    if failed is not None:
        rows = rows.join(failed.select("d").distinct().withColumn("__bad", F.lit(True)), "d", "left")
        status = F.when(F.col("__bad").isNotNull(), "error").otherwise(status)
    return rows.select("d", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def run_status(spine: DataFrame, stages: dict[str, DataFrame], value: str = "lst") -> DataFrame:
    """(d, stage, n, status): for every day and stage how many pixels have a value, and whether the day is ``ok``,
    ``empty`` (pixels, but no value) or ``missing``; so no day vanishes unseen.  One aggregate over all stages."""
    rows = reduce(DataFrame.unionByName, [df.select("d", F.lit(name).alias("stage"), F.col(value).cast("double").alias("v")) for name, df in stages.items()])
    counts = rows.groupBy("d", "stage").agg(F.count("v").alias("n"))
    wanted = spine.select("d", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "empty").otherwise("ok")
    return wanted.join(counts, ["d", "stage"], "left").select("d", "stage", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def first_valid(df: DataFrame, value: str, order: str = "d", keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """The first value by ``order`` that isn't missing, and where it is, for each key."""
    there = F.when(F.col(value).isNotNull(), F.col(order))
    return df.groupBy(*keys).agg(F.min(there).alias(order), F.min_by(value, there).alias(value))


def pending(wanted: DataFrame, done: DataFrame, on: str = "d") -> DataFrame:
    """What is wanted and not done yet: reruns go on where they stopped."""
    return wanted.select(on).distinct().join(done.select(on).distinct(), on, "left_anti")


def complete(*layers: DataFrame, on: str = "d") -> DataFrame:
    """Keys that all layers have."""
    return reduce(lambda a, b: a.join(b.select(on).distinct(), on, "left_semi"), layers[1:], layers[0].select(on).distinct())


def registered(*layers: DataFrame, on: tuple[str, ...] = ("d", "r", "c"), how: str = "inner") -> DataFrame:
    """Co-registered layers side by side."""
    return reduce(lambda a, b: a.join(b, list(on), how), layers)


def layer_or_zero(left: DataFrame, layer: DataFrame, value: str, on: tuple[str, ...], layer_key: str) -> DataFrame:
    """left with the layer's value, 0 only where the whole layer of a key is absent."""
    there = layer.select(layer_key).distinct().withColumn("__there", F.lit(True))
    rows = left.join(layer, list(on), "left").join(there, layer_key, "left")
    return rows.withColumn(value, F.when(F.col("__there").isNull(), F.lit(0.0)).otherwise(F.col(value))).drop("__there")

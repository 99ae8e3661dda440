"""The daily chain from gaps to fused temperatures, as one plan, and its runs that go on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdf, downscale, joins, models
from ..sources import grids

Score = Callable[[DataFrame], DataFrame]


@dataclass
class Layers:
    """What a run reads: the days wanted (d); microwave, thermal and reanalysis layers (d, r, c, lst or t) and static ones
    (r, c, ndvi, dem, roi) on the coarse grid of ``low`` cells; thermal (d, r, c, virr) and static layers on the fine
    grid of ``high`` cells."""

    spine: DataFrame
    pmw: DataFrame
    virr: DataFrame
    era5: DataFrame
    static: DataFrame
    fine_virr: DataFrame
    fine_static: DataFrame
    low: tuple[int, int]
    high: tuple[int, int]


def products(x: Layers, impute: Score, fuse: Score, keep: Callable[[str, DataFrame], DataFrame], least: int = 1000, n_quantiles: int = 12) -> dict[str, DataFrame]:
    """(d, r, c, lst) of each stage by name, in order: imputed, matched, fine, fused.

    ``impute`` and ``fuse`` add ``predicted`` to rows with the features (t, ndvi, dem) and (pmw, ndvi, dem): models of
    each dekad, or anything else that does.  ``keep(name, df)`` writes a stage and returns it as read again, so that a
    later stage, which needs it more than once, starts from what is stored."""
    days = F.broadcast(x.spine.select("d").distinct())
    cells = x.era5.join(days, "d", "left_semi").join(x.pmw, ["d", "r", "c"], "left").join(x.static, ["r", "c"])
    filled = F.coalesce("lst", F.when(F.col("roi") == 1, F.col("predicted")))
    imputed = keep("imputed", impute(cells).select("d", "r", "c", filled.alias("lst")))
    matched = keep("matched", cdf.corrected(imputed, x.era5, x.static, least=least, n_quantiles=n_quantiles))
    whole = imputed.select("d", "r", "c").join(matched, ["d", "r", "c"], "left")
    fine = keep("fine", downscale.filled_downscaled(whole, x.fine_static.select("r", "c", "ndvi", "dem"), x.low, x.high))
    layers = matched.withColumnRenamed("lst", "pmw").join(x.static, ["r", "c"]).join(x.virr.withColumnRenamed("lst", "virr"), ["d", "r", "c"], "left")
    rows = fine.withColumnRenamed("lst", "pmw").join(x.fine_static, ["r", "c"]).join(x.fine_virr, ["d", "r", "c"], "left")
    fused = keep("fused", models.fused_fine(fuse(rows), models.coarse_residual(fuse(layers)), x.low, x.high))
    return {"imputed": imputed, "matched": matched, "fine": fine, "fused": fused}


def run(spark: SparkSession, x: Layers, folder: str, impute: Score, fuse: Score, **how) -> DataFrame:
    """Write the stages of all wanted days that are not in folder yet, one table by day for each stage, and return the
    status of every day and stage: ok, empty, or missing where a layer that it needs was.

    A day is done when the last stage has it; a day written in part is written again whole.  The folder must be one that
    all executors share."""

    def written(stage: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{stage}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.parquet(f"{folder}/{stage}") if there else None

    done = written("fused")
    wanted = x.spine.select("d").distinct() if done is None else joins.pending(x.spine, done)
    wanted = spark.createDataFrame(wanted.collect(), "d date")  # a run's days

    def keep(stage: str, df: DataFrame) -> DataFrame:
        grids.write_daily(df, f"{folder}/{stage}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{stage}").join(F.broadcast(wanted), "d", "left_semi").select("d", "r", "c", "lst")

    if not wanted.isEmpty():
        products(Layers(**{**x.__dict__, "spine": wanted}), impute, fuse, keep, **how)
    stages = {stage: df for stage in ("imputed", "matched", "fine", "fused") if (df := written(stage)) is not None}
    return joins.run_status(x.spine, stages)


def report(stages: dict[str, DataFrame]) -> DataFrame:
    """(d, stage, n, mean, least, most) of every day and stage that has pixels."""
    rows = reduce(DataFrame.unionByName, [df.select("d", F.lit(k).alias("stage"), "lst") for k, df in stages.items()])
    return rows.groupBy("d", "stage").agg(F.count("lst").alias("n"), F.avg("lst").alias("mean"), F.min("lst").alias("least"), F.max("lst").alias("most"))

"""Boosted trees by dekad: imputation of missing pixels and fusion of two sensors."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import dekad_num
from ..functions.radiometry import clamped, cloud_free, within
from . import boosting
from .boosting import Boosted
from .metrics import regression
from .resample import Grid, warp

#: Ranges that random search draws from.
IMPUTE_SPACE = {"trees": (100, 500), "depth": (5, 12), "step": (0.01, 0.11), "rows": (0.8, 1.0), "columns": (0.8, 1.0), "gain": (0.0, 5.0), "weight": (1, 5)}
FUSION_SPACE = {"trees": (200, 550), "depth": (6, 12), "step": (0.02, 0.12), "rows": (0.7, 1.0), "columns": (0.7, 1.0), "gain": (0.0, 3.0), "weight": (1, 5)}
#: Rows that one model is fitted to at most; of more, a fixed part is taken by hash.
FIT_ROWS = 1 << 17


def is_training(share: int = 7):
    """A fixed bucket of pixels and days, the same on any cluster."""
    return (F.col("r") * 31 + F.col("c") * 17 + F.dayofmonth("d")) % 10 < share


def fitted(
    samples: DataFrame, features: list[str], label: str, weight: str | None = None, space: dict | None = None, tries: int = 25, folds: int = 5, metric: str = "r2", most: int = FIT_ROWS, **fixed
) -> Boosted:
    """Best model of a random search with cross-validation, or one fit with ``fixed`` parameters if no space is given.

    Rows with a missing feature, label or weight are left out; at least one must stay."""
    rows = samples.dropna(subset=[*features, label, *([weight] if weight else [])])
    if space:
        return boosting.searched(rows, features, label, weight, space, tries, folds, metric, most)[0]
    one = {k: (v, v + 1 if isinstance(v, int) else v) for k, v in fixed.items()}
    return boosting.searched(rows, features, label, weight, one, 1, 2, metric, most)[0]


def predicted(model: Boosted, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with ``predicted``, NULL where a feature is missing; no row moves."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "predicted double"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features], 1) if b.num_rows else np.zeros((0, len(features)))
            full = np.isfinite(x).all(1)
            out = np.full(b.num_rows, np.nan)
            out[full] = shared.value.predict(x[full])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~full)], [*b.schema.names, "predicted"])

    return rows.mapInArrow(apply, schema)


def imputed(pixels: DataFrame, features: list[str], least: int = 0, **how) -> DataFrame:
    """pixels (d, r, c, lst, roi, features) with lst filled by a model of each dekad where it is missing in the ROI.

    Out-of-range values stay out of training and pass unchanged.  The driver loops over dekads, at most 36 a year."""
    rows = pixels.withColumn("dekad", dekad_num(F.col("d")))
    out = None
    for (dekad,) in sorted(rows.select("dekad").distinct().collect()):
        mine = rows.where(F.col("dekad") == dekad)
        train = mine.where(within(F.col("lst"), "impute_train") & (F.col("roi") == 1) & is_training())
        if train.limit(max(1, least)).count() < max(1, least):
            done = mine.withColumn("predicted", F.lit(None).cast("double"))
        else:
            done = predicted(fitted(train, features, "lst", **how), mine, features)
        filled = F.coalesce("lst", F.when(F.col("roi") == 1, F.col("predicted")))
        done = done.select("d", "r", "c", filled.alias("lst"), "predicted")
        out = done if out is None else out.unionByName(done)
    return out


def fused(pixels: DataFrame, features: list[str], **how) -> DataFrame:
    """pixels (d, r, c, virr, pmw, ndvi, dem, roi, w) of either sensor as (d, r, c, lst): the cloud-free thermal value, or
    else the model's with its clamped residual, 0 without a thermal value, kept in range.

    Trained on in-range pairs in the ROI that have a weight; a pixel that lacks a feature has no prediction."""
    train = pixels.where(is_training() & (F.col("roi") == 1) & within(F.col("virr"), "model") & F.col("w").isNotNull())
    done = predicted(fitted(train, features, "virr", weight="w", **how), pixels, features)
    residual = clamped(_clear() - F.col("predicted"))
    return done.select("d", "r", "c", _whole(F.col("predicted") + residual).alias("lst"))


def _clear():
    return cloud_free(F.col("virr"), F.col("pmw"), F.col("dem"), F.col("ndvi"))


def _whole(value):
    return F.coalesce(_clear(), F.when(within(value, "fused"), value))


def coarse_residual(scored: DataFrame) -> DataFrame:
    """scored (d, r, c, virr, pmw, ndvi, dem, predicted) on the coarse grid as (d, r, c, residual): the cloud-free thermal
    value less the prediction, clamped, and 0 where either is missing."""
    return scored.select("d", "r", "c", clamped(_clear() - F.col("predicted")).alias("residual"))


def fused_fine(scored: DataFrame, residual: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """scored (d, r, c, virr, pmw, ndvi, dem, predicted) on the fine grid and the coarse residual (d, r, c, residual) as
    (d, r, c, lst): the residual is spread by cubic B-splines, 0 where there is none, and added to the prediction; kept
    in range, it stands where the cloud-free thermal value is missing."""
    spread = warp(residual, "residual", Grid.index(low), Grid.index(high), "bspline")
    both = scored.join(spread, ["d", "r", "c"], "left")
    return both.select("d", "r", "c", _whole(F.col("predicted") + F.coalesce("residual", F.lit(0.0))).alias("lst"))


def saved(spark: SparkSession, model: Boosted, path: str) -> None:
    spark.createDataFrame([(bytearray(pickle.dumps(model, protocol=5)), json.dumps(asdict(model.params)))], "model binary, parameters string").coalesce(1).write.mode("overwrite").parquet(path)


def loaded(spark: SparkSession, path: str) -> Boosted:
    """A model that saved() wrote; like any pickle, only from a folder that is trusted."""
    return pickle.loads(bytes(spark.read.parquet(path).first()["model"]))


def held_out(model: Boosted, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row of agreement on rows that were not trained on."""
    return regression(predicted(model, rows.where(~is_training()), features), "predicted", label)


def logged(path: str, name: str, model: Boosted, scores: DataFrame) -> None:
    """Append one row of a training log: the model's name, its chosen parameters as JSON, and its scores."""
    row = scores.select(F.lit(name).alias("model"), F.lit(json.dumps(asdict(model.params))).alias("parameters"), "*")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)

"""Agreement of two columns, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cdf import medians


def daily(df: DataFrame, predicted: str, truth: str, least: int = 100) -> DataFrame:
    """bias, rmse, r_squared and valid_pixels of each day with at least ``least`` pairs."""
    p, t = F.col(predicted), F.col(truth)
    both = df.where(p.isNotNull() & t.isNotNull())
    e = p - t
    return both.groupBy("d").agg(
        F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.pow(F.corr(p, t), 2).alias("r_squared"), F.count(F.lit(1)).alias("valid_pixels")
    ).where(F.col("valid_pixels") >= least)


#: Bins that all errors together are ranked in.
WHOLE_BINS = 4096


def regression(df: DataFrame, predicted: str, truth: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """r2, explained_variance, max_error, mae, mse and median_ae; the median by ranks, so no task holds all errors.

    No pairs: no row."""
    p, t = F.col(predicted), F.col(truth)
    by = keys or ("__all",)
    both = df.where(p.isNotNull() & t.isNotNull()).select(*keys, p.alias("__p"), t.alias("__t"), F.lit(0).alias("__all")).withColumn("__e", F.col("__t") - F.col("__p"))
    e, n = F.col("__e"), F.count(F.lit(1))
    rest = both.groupBy(*by).agg(
        (1 - F.sum(e * e) / (F.var_pop("__t") * n)).alias("r2"),
        (1 - F.var_pop(e) / F.var_pop("__t")).alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
    )
    middle = medians(both.select(*by, F.abs(e).alias("__a")), "__a", by, WHOLE_BINS).withColumnRenamed("median", "median_ae")
    return rest.join(middle, list(by)).drop("__all")


def confident(df: DataFrame, predicted: str, truth: str, weight: Column, bar: float = 0.8) -> DataFrame:
    """r2, rmse, mae and n where the weight is above the bar."""
    return regression(df.where(weight > bar), predicted, truth).select("r2", F.sqrt("mse").alias("rmse"), "mae")


def summary(df: DataFrame, value: str, keys: tuple[str, ...] = ("d",)) -> DataFrame:
    v = F.col(value)
    rest = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")
    )
    return rest.join(medians(df, value, keys), list(keys)).select(*keys, "mean", "std", "min", "max", "median", "n")

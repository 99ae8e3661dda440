"""Grids derived from the star-schema tables: 15 cells wide, cell id = row * 15 + col."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 15
FIRST, LAST = "2024-01-01", "2024-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(user: str) -> list:
    return [F.expr(f"cast({user} div {WIDTH} as int)").alias("r"), F.expr(f"cast({user} % {WIDTH} as int)").alias("c")]


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.to_date("ts").alias("d"), F.col("event_type").alias("scene"), *_cell("user_id")).agg((F.lit(215.0) + 0.3 * F.max("value")).cast("double").alias("v"))


def _layer(spark: SparkSession, sf_dir: str, scenes: tuple[str, ...]) -> DataFrame:
    return scene(spark, sf_dir).where(F.col("scene").isin(*scenes)).groupBy("d", "r", "c").agg(F.max("v").alias("lst"))


def pmw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir, ("click", "view", "error"))


def virr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir, ("purchase", "signup"))


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        *_cell("p_partkey"),
        ((F.col("p_size") - 5) / 50.0).cast("double").alias("ndvi"),
        ((F.col("p_retailprice") - 900) * 50).cast("double").alias("dem"),
        F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(1).alias("roi"),
    )


def era5(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(*_cell("user_id")).distinct()
    t = F.lit(250.0) + (F.col("r") * 7 + F.col("c") * 3 + F.dayofmonth("d") * 5) % 60
    every = F.expr(f"explode(sequence(date'{FIRST}', date'{LAST}'))")
    return users.select("r", "c", every.alias("d")).select("d", "r", "c", t.cast("double").alias("t"))

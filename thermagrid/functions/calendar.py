"""Dekads (days 1-10, 11-20, 21 to the end of the month) and dates in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dekad_num(d: Column) -> Column:
    """1 to 36."""
    return ((F.month(d) - 1) * 3 + F.least(F.floor((F.dayofmonth(d) - 1) / 10), F.lit(2)) + 1).cast("int")


def dekad_end(d: Column) -> Column:
    day = F.dayofmonth(d)
    return (
        F.when(day <= 10, F.make_date(F.year(d), F.month(d), F.lit(10)))
        .when(day <= 20, F.make_date(F.year(d), F.month(d), F.lit(20)))
        .otherwise(F.last_day(d))
    )


def file_date(path: Column) -> Column:
    """The 8-digit date in a file's name, null where there is none or it isn't a date."""
    return F.try_to_timestamp(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def days(spark: SparkSession, begin: str, end: str) -> DataFrame:
    """d: every day from begin to end, both included."""
    return spark.sql(f"select explode(sequence(date'{begin}', date'{end}')) as d")


def ordinal(d: Column, first: Column) -> Column:
    return F.datediff(d, first)

"""Column builders and storage helpers that the corpus operators share."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch

#: The white space of the contracts, as a regular expression class.
SPACE = "[\\x20\\x09-\\x0D]"


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, f"{SPACE}+"))
    edges = text.rlike(f"^{SPACE}").cast("int") + text.rlike(f"{SPACE}\\z").cast("int")
    return F.when(text == "", F.lit(0)).otherwise(pieces - edges).cast("long")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Rows and bytes of one Arrow batch: what a Python worker and its JVM hold at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, however long its texts are.

    Spark reads these settings when a plan runs, after an operator has returned, so they stay; they are only ever
    lowered."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: What stored() wrote, and which of it small_side() found small.
_small: weakref.WeakSet[DataFrame] = weakref.WeakSet()
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[kept] = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Remove what stored() wrote for these, once no plan that has still to run reads it."""
    for df in kept:
        path = _folders.pop(df, None)
        if path:
            drop(df.sparkSession, path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove scratch folders that no later step reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table, and bytes of its long columns, up to which it is broadcast: a few dozen MB.
SMALL_ROWS, SMALL_BYTES = 1 << 20, 32 << 20


def small_side(df: DataFrame, *long: str) -> DataFrame:
    """df, written, with a broadcast hint if it has at most SMALL_ROWS rows and SMALL_BYTES in its binary columns
    ``long``; else Spark joins it by shuffle.

    For a few narrow columns that meet a table of texts or sets, which then need not move."""
    kept = stored(df, "side")
    held = kept.agg(F.count(F.lit(1)), F.sum(sum((F.octet_length(c) for c in long), F.lit(0)))).first()
    if held[0] > SMALL_ROWS or (held[1] or 0) > SMALL_BYTES:
        return kept
    hinted = F.broadcast(kept)
    _folders[hinted] = _folders.pop(kept)
    _small.add(hinted)
    return hinted


def is_small(df: DataFrame) -> bool:
    """Whether small_side() gave df a broadcast hint."""
    return df in _small


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    held, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        found.append(name)
    return found


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """df with a column of gapless ranks from 0 within each key, ordered by order; a key may hold any share of the rows.

    df should be narrow and cheap to read, as it is written once.  Rows are range-partitioned by key and order, ranked
    inside their partition, and shifted by what earlier partitions hold of their key: no task sees a whole key.
    The shifts come from one row for each key and partition.
    """
    from pyspark.sql import Window

    part, count, shift = "__part", "__count", "__shift"
    dealt = stored(
        df.repartitionByRange(*[F.col(f"`{c}`") for c in [*keys, *order]]).withColumn(part, F.spark_partition_id()),
        "ranked",
    )
    counts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(f"`{k}`").alias(f"__{k}") for k in keys],
        F.col(part).alias("__at"),
        F.coalesce(F.sum(count).over(before), F.lit(0)).alias(shift),
    )
    local = Window.partitionBy(*keys, part).orderBy(*order)
    dealt = dealt.withColumn(rank, F.row_number().over(local).cast("long") - 1)
    on = F.col(part) == F.col("__at")
    for key in keys:
        on = on & F.col(f"`{key}`").eqNullSafe(F.col(f"`__{key}`"))
    return dealt.join(shifts, on).select(*df.columns, (F.col(rank) + F.col(shift)).alias(rank))

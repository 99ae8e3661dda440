"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stored, word_count

#: No source contributes more than this many times its own size.
MOST_COPIES = 3
SEED = 20240
_STEP = 1 << 20


def targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh 1, 2, 3, repeating.  Together they share the sum of all sizes; a
    target stops at ``most`` times its source's size and the excess is shared again by weight.  The fixed point gives
    each source min(most * size, level * weight).  Sources fill up in order of size / weight; taking any prefix of that
    order as full, right or wrong, gives a level no higher than the true one, which is therefore the maximum over all
    prefixes.  One row for each source, so one task is enough.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    light = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - full) / light
    s = s.withColumn("level", level).withColumn("water", F.max("level").over(everything))
    target = F.least("cap", F.col("water") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of docs (doc_id, text, source).

    A document is expected target / source_size times.  Within a source, documents in order of size and id carry the
    running sum of that expectation plus one offset from 0 to 1, drawn from the seed and the source's name; a copy is
    taken for each whole number the sum crosses.  As the order is by size, words taken differ from the target by about
    the largest document at most.  The rank comes from a distributed prefix sum, so a source may hold any share of
    the rows, and reruns agree.

    Null or empty text: size 0.  Null source: a source of its own.  Repeated rows: each is a document.  Other columns
    are ignored.  No rows: no rows.
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix")
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    ranks = ranked(sized, ["source"], ["size", "doc_id"])
    per = per.withColumnRenamed("source", "__source")
    rows = ranks.join(per, F.col("source").eqNullSafe(F.col("__source")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    offset = F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("double") / F.lit(float(_STEP))
    crossed = F.floor((F.col("rank") + 1) * expected + offset) - F.floor(F.col("rank") * expected + offset)
    copies = F.least(crossed, F.lit(most).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

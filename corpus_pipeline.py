"""The corpus pipeline: language, near duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again before the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from thermagrid.llm import decontam, language, mixing, setjoin, sharding
from thermagrid.llm.common import drop, fresh, scratch, small_side, stored, table, word_count

#: Posterior below which a language is not accepted.
LEAST_SCORE = 0.5
#: Words of a shingle and percent of similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 80
SHARDS = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or a clear language, each row by its own text.

    Null and empty texts have no letter.  Repeated rows and null ids need no exception; other columns stay as they are.
    Where no row has a language to learn from, an empty table included, a document is rejected only for having no
    letter."""
    model = language.train(docs.select("text", "lang"))
    if not model["langs"]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    lang, score = fresh(docs, "__lang", "__score")
    said = language.predict(docs, model, keep_text=True, named=(lang, score))
    return said.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of linked documents, and one of the rows that share it.

    Rows without doc_id stay, as do texts without words, which link with nothing.  An empty table stays empty."""
    return setjoin.deduplicated(docs, SHINGLE, SIMILARITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in whose text a benchmark item is found, whatever their doc_id; null and empty texts stay.

    Without items, or without rows, nothing changes."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says; copies are repeated rows.

    Rows alike in doc_id (null included), source and number of words share the copies of all of them evenly, in order
    of their texts.  A text without words is taken as often as its source's share says, too.  An empty table stays
    empty; other columns are repeated with their row."""
    words, doc, source, size, total, n, copy = fresh(docs, "__words", "__doc", "__source", "__size", "__total", "__n", "__copy")
    alike = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies"), F.count(F.lit(1))).toDF(doc, source, size, total, n)
    alike = stored(alike.where(F.col(total) > 0), "mixed")
    sized = docs.withColumn(words, word_count(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    # the same join at every size: texts and copies meet by key
    every = sized.join(alike.where(F.col(n) == 1).hint("merge"), on).withColumn(copy, F.col(total))
    several = small_side(alike.where(F.col(n) > 1))
    if not several.isEmpty():
        k = F.row_number().over(Window.partitionBy(doc, source, size).orderBy("text"))
        share = F.floor(k * F.col(total) / F.col(n)) - F.floor((k - 1) * F.col(total) / F.col(n))
        every = every.union(sized.join(several, on).withColumn(copy, share))
    taken = every.where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix; rows of equal texts share a shard, and null ids and texts have one, too.

    Returns the columns of sharding.shard.  An empty table gives no rows."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix_sources),
    ("shards", assign_shards),
]

#: Language models, signatures and differencing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.  A stage's result is removed when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

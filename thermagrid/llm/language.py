"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Orders of the n-grams, number of hash buckets and additive smoothing.
ORDERS = (2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
#: Code points scored at once.
BLOCK = 1 << 19
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)

_tables: dict[str, np.ndarray] = {}


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter, or a space for what is no letter, of every code point; and which are letters."""
    if not _tables:
        fold = np.full(0x110000, 32, np.uint32)
        letter = np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                fold[i] = ord(low) if len(low) == 1 else i
        _tables["fold"], _tables["letter"] = fold, letter
    return _tables["fold"], _tables["letter"]


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bucket of each n-gram, letters of each row) of consecutive blocks; a long text spans several.

    Runs of what is no letter fold to one space, and each text stands between spaces."""
    fold, letter = _fold()
    rows: list[np.ndarray] = []
    points: list[np.ndarray] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, code = np.concatenate(rows), np.concatenate(points)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
        row, code = row[keep], code[keep]
        at, grams = [], []
        for n in ORDERS:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ code[i : i + len(h)]) * _A
                h ^= h >> np.uint32(15)
            same = row[: len(h)] == row[n - 1 :]
            at.append(row[: len(h)][same])
            grams.append(((h * _B) >> np.uint32(17))[same])
        letters = np.bincount(row[code != 32], minlength=len(texts))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), letters
        return np.concatenate(at), np.concatenate(grams), letters

    for k, text in enumerate(texts):
        if not text:
            continue
        code = fold[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)]
        for a in range(0, len(code), BLOCK):
            piece = code[a : a + BLOCK + max(ORDERS) - 1]
            rows.append(np.full(len(piece), k, np.int64))
            points.append(piece)
            held += len(piece)
            if held >= BLOCK:
                yield flush()
                rows, points, held = [], [], 0
    if held:
        yield flush()


def train(docs: DataFrame) -> dict:
    """A model from every row of docs (text, lang) with a language: {"langs": [...], "log_p": buckets x langs}.

    Each task adds up one count array for each language; Spark sums them by language.  What reaches the driver is one
    array of BUCKETS counts for each language.  Null text or language: not used.  No usable row: no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted({x for x in langs if x is not None})
            index = {x: i for i, x in enumerate(names)}
            which = np.array([index.get(x, -1) for x in langs])
            for row, gram, _ in _blocks(texts):
                lang = which[row]
                flat = np.bincount(lang * BUCKETS + gram, minlength=len(names) * BUCKETS)
                for i, x in enumerate(names):
                    totals[x] = totals.get(x, 0) + flat[i * BUCKETS : (i + 1) * BUCKETS]
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.string()), pa.array([v.astype(np.int64).tobytes() for v in totals.values()], pa.binary())], ["lang", "counts"]
            )

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"lang": [key[0].as_py()], "counts": [total.tobytes()]})

    bounded_batches(docs.sparkSession)
    used = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    parts = used.mapInArrow(count, "lang string, counts binary")
    # few rows of one fixed size for each task and language: one more level keeps a language's sum from one task
    parts = parts.withColumn("salt", F.spark_partition_id() % 16).groupBy("lang", "salt").applyInArrow(add, "lang string, counts binary")
    sums = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in parts.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()}
    langs = sorted(sums)
    if not langs:
        return {"langs": [], "log_p": np.zeros((BUCKETS, 0), np.float32)}
    counts = np.stack([sums[x] for x in langs], 1).astype(np.float64) + SMOOTHING
    return {"langs": langs, "log_p": np.log(counts / counts.sum(0)).astype(np.float32)}


def predict(docs: DataFrame, model: dict, keep_text: bool = False, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (text and any others) with lang_pred and score, or as named; the text itself only if keep_text.
    A column of docs with one of these names is replaced.

    The model is broadcast: BUCKETS numbers for each language.  score is the posterior of the language named, at equal
    priors, from the mean log-likelihood of an n-gram times min(number of n-grams, 64): longer texts say no more.
    Null text, a text without a letter, or a model without languages: ``und`` with score 0.  Empty and very long texts
    need no exception: a long one is scored block by block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if (keep_text or c != "text") and c not in named]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p = shared.value["langs"], shared.value["log_p"]
        columns = [np.ascontiguousarray(log_p[:, i]) for i in range(len(langs))]
        for batch in batches:
            n = batch.num_rows
            total = np.zeros((n, max(1, len(langs))))
            letters, grams = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, gram, more in _blocks(batch.column("text").to_pylist()):
                letters += more
                grams += np.bincount(row, minlength=n)
                for i, column in enumerate(columns):
                    total[:, i] += np.bincount(row, weights=column[gram], minlength=n)
            mean = total / np.maximum(grams, 1)[:, None] * np.minimum(grams, 64)[:, None]
            odds = np.exp(mean - mean.max(1, keepdims=True))
            best = mean.argmax(1)
            known = (letters > 0) & bool(langs)
            said = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            sure = np.where(known, odds.max(1) / odds.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(said, pa.string()), pa.array(sure)],
                [*names, *named],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.mapInArrow(score, ", ".join(x for x in (kept, f"`{named[0]}` string, `{named[1]}` double") if x))

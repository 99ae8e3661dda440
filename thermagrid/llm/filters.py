"""A bounded bitmap of integers: every member passes, and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import mix

#: Bits for each member, and at most.
RATIO, MOST_BITS = 16, 1 << 25
_U = np.uint64


def passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    slot = mix(names.astype(np.int64).view(np.uint64)) % _U(len(bits) * 8)
    return (bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1


def members_filter(members: DataFrame, column: str, most: int | None = None, whole: bool = False) -> np.ndarray | None:
    """Bytes of the bitmap.  Too many members for ``most`` bits: None, or with ``whole`` one of that size, which more
    others pass.  The driver sees at most ``most`` bits, MOST_BITS if not given."""
    most = MOST_BITS if most is None else most
    size = 1 << max(10, (RATIO * members.count()).bit_length())
    if size > most:
        if not whole:
            return None
        size = most

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[(mix(b.column(0).to_numpy().view(np.uint64)) % _U(size)).astype(np.int64)] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full])], ["word", "bits"])

    out = np.zeros(size // 64, np.int64)
    for r in members.select(column).mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def passing(df: DataFrame, column: str, bits: np.ndarray, inside: bool) -> DataFrame:
    """The rows of df whose integer in ``column`` passes, or those whose doesn't; null doesn't."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(column)
            there = names.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((there & passes(shared.value, names.fill_null(0).to_numpy())) == inside))

    return df.mapInArrow(keep, df.schema)

"""Packed exchange: many small records of one route travel as one binary row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

ROUTED = "route int, docs binary, gaps binary, data binary"


def routes_for(df: DataFrame, each: int = 4) -> int:
    """Routes, ``each`` for a shuffle partition: a task holds one route at a time, that part of what it reads."""
    return max(64, each * partitions(df))


def dealt(sent: DataFrame) -> DataFrame:
    """Rows of ROUTED with their routes dealt evenly over the shuffle partitions, sorted by route."""
    n = partitions(sent)
    return sent.repartitionById(n, F.pmod(F.col("route"), F.lit(n))).sortWithinPartitions("route")


def first_turn() -> int:
    """Where a task begins when it deals out rows in turn: another place in each task, so that no route is every task's first."""
    context = TaskContext.get()
    return 7919 * context.partitionId() if context else 0


def route_of(hashes: np.ndarray, routes: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(routes)) >> np.uint64(32)).astype(np.int32)


def split(routes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(route, positions in their order) for each route that occurs."""
    order = np.argsort(routes.astype(np.uint16) if most <= 1 << 16 else routes, kind="stable")
    bounds = np.searchsorted(routes[order], np.arange(most + 1))
    for route in range(most):
        if bounds[route + 1] > bounds[route]:
            yield route, order[bounds[route] : bounds[route + 1]]


def shortened(hashes: np.ndarray, width: int) -> bytes:
    """The low bytes of each hash; the route stands for the high ones."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def lengthened(raw: bytes, width: int) -> np.ndarray:
    full = np.zeros((len(raw) // width, 8), np.uint8)
    full[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return full.view(np.uint64).ravel()


def narrow(values: np.ndarray) -> bytes:
    """Integers in the narrowest of 1, 2, 4 or 8 bytes that holds them all, after one byte that tells which."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def ids(names: np.ndarray) -> bytes:
    """64-bit integers: the first, and the narrow steps from each to the next."""
    return names[:1].astype("<i8").tobytes() + narrow(np.diff(names))


def named(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<i8", 1), widened(raw[8:])]))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    route, docs, gaps, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(route, pa.int32()), pa.array(docs, pa.binary()), pa.array(gaps, pa.binary()), pa.array(data, pa.binary())], ["route", "docs", "gaps", "data"]
    )


def keyed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of equal keys in a stream of batches that is sorted by them; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[x].item() if hasattr(c[x], "item") else c[x] for c in columns)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield last, pa.Table.from_batches(held)

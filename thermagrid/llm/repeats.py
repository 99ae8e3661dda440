"""Substring dedup: Rabin-Karp hashes of all windows of a fixed number of words, and removal of repeated ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import bounded_batches, is_small, small_side
from .filters import members_filter, passing
from .textkit import EXACT, Spans, chunks, mix, words

WINDOW = 20
#: Windows that a task holds before it sends them.
HELD = 1 << 20
#: Bits of the bitmap of marked documents where they are too many to be broadcast.
BITMAP_BITS = 1 << 28
#: Bytes of a hash that travel; with the route they are 2**63 values or more.
SENT = 7
_BASE = np.uint64(0xD1342543DE82EF95)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp: hash of each run of n word hashes from prefix sums of hash * base**i, modulo 2**64."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up = np.full(len(hashes), _BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(len(hashes) - n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down)


def _later(docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the occurrences of each hash that are later, by document and start, than its first one."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    many = np.zeros(len(h), bool)
    many[:-1] = ~first[1:]
    many |= ~first
    order = order[many]
    order = order[np.lexsort((starts[order], docs[order], hashes[order]))]
    h = hashes[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
    return order[(docs[order] != docs[head]) | (starts[order] != starts[head])]


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal intervals that intervals (begin, end) cover together."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > reach[:-1]
    begin = np.flatnonzero(fresh)
    return np.stack([spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]], 1)


#: A document's identity: its doc_id, and 0 or, where the doc_id repeats, a hash of the text.
MARKS = "doc_id long, variant long, spans binary"


def _marks(docs: np.ndarray, variants: np.ndarray, starts: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of MARKS, one for each document: the intervals of words that its windows cover."""
    order = np.lexsort((starts, variants, docs))
    d, v, s = docs[order], variants[order], starts[order].astype(np.int32)
    # a window that begins beyond the one before it begins an interval
    own = np.ones(len(d), bool)
    own[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    fresh = own.copy()
    fresh[1:] |= s[1:] - s[:-1] > window
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(d))[: len(begin)] - 1
    spans = np.stack([s[begin], s[last] + np.int32(window)], 1) if len(begin) else np.zeros((0, 2), np.int32)
    head = np.flatnonzero(own[begin])
    tail = np.append(head[1:], len(begin))[: len(head)]
    for a in range(0, len(head), 1 << 15):
        some = slice(a, a + (1 << 15))
        at = begin[head[some]]
        packed = [spans[x:y].tobytes() for x, y in zip(head[some].tolist(), tail[some].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(v[at]), pa.array(packed, pa.binary())], ["doc_id", "variant", "spans"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans of a document (doc_id, variant, all) as maximal intervals."""
    for b in batches:
        whole = [merged(np.frombuffer(b"".join(x), np.int32).reshape(-1, 2)).tobytes() for x in b.column("all").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("variant"), pa.array(whole, pa.binary())], ["doc_id", "variant", "spans"])


def _marked(docs: DataFrame, window: int) -> DataFrame:
    """MARKS of the windows of docs (doc_id, variant, text) whose words also start earlier, in any number of rows.

    Window hashes go by ranges of hash to the tasks that count them.  Of a window that repeats inside what one task
    holds, only the first occurrence is sent to be counted; the others are known to be later and travel as marks, dealt
    over all tasks.  So a passage that a third of all documents hold arrives once for each task that read it."""
    routes = blobs.routes_for(docs, 2)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count, turn = 0, blobs.first_turn()

        def flush() -> pa.RecordBatch:
            nonlocal held, count, turn
            names, variants = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            base = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            of = np.concatenate([x[2] + b for x, b in zip(held, base, strict=True)])
            starts, hashes = (np.concatenate([x[k] for x in held]) for k in (3, 4))
            held, count = [], 0
            rows = []
            later = _later(names[of], starts, hashes)
            if len(later):
                packed = np.stack([names[of[later]], variants[of[later]], starts[later]], 1)
                for a in range(0, len(packed), 1 << 14):
                    turn += 1
                    rows.append((-1 - turn % routes, None, None, packed[a : a + (1 << 14)].tobytes()))
            keep = np.ones(len(of), bool)
            keep[later] = False
            of, starts, hashes = of[keep], starts[keep], hashes[keep]
            for route, at in blobs.split(blobs.route_of(hashes, routes), routes):
                who, which = np.unique(of[at], return_inverse=True)
                step = np.diff(which, prepend=0)
                start = starts[at]
                start[1:] -= np.where(step[1:] == 0, start[:-1].copy(), 0)  # from the start before, in the same document
                data = blobs.shortened(hashes[at], SENT) + blobs.narrow(start)
                more = variants[who].tobytes() if variants[who].any() else b""
                rows.append((route, blobs.ids(names[who]), blobs.narrow(step), data + more))
            return blobs.batch(rows)

        for b in batches:
            ids, variant = b.column("doc_id").to_numpy(), b.column("variant").to_numpy()
            for first, end, data, offsets in chunks(b.column("text")):
                begin, stop, at = words(data, offsets)
                roll = rolling(Spans(data, EXACT).hash(begin, stop), window)
                # windows that start in a row and end in it
                per = np.maximum(np.diff(at) - window + 1, 0)
                of = np.repeat(np.arange(end - first), per)
                start = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
                held.append((ids[first:end], variant[first:end], of, start, roll[np.repeat(at[:-1], per) + start]))
                count += len(of)
                if count >= HELD:
                    yield flush()
        if count:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (route,), group in blobs.keyed(batches, ["route"]):
            if route < 0:
                for part in group.column("data"):
                    rows = np.frombuffer(part.as_buffer(), np.int64).reshape(-1, 3)
                    yield from _marks(rows[:, 0], rows[:, 1], rows[:, 2], window)
                continue
            ids, variants, starts, hashes = [], [], [], []
            for who, place, data in zip(*(group.column(c).to_pylist() for c in ("docs", "gaps", "data")), strict=True):
                step = blobs.widened(place)
                n, at = len(step), np.cumsum(step)
                end = SENT * n + 1 + data[SENT * n] * n
                hashes.append(blobs.lengthened(data[: SENT * n], SENT))
                start = np.cumsum(blobs.widened(data[SENT * n : end]))
                # each document counts from 0 again
                head = np.flatnonzero(step > 0)
                base = np.zeros(n, np.int64)
                base[head] = np.diff(start[head - 1], prepend=0)
                starts.append(start - np.cumsum(base))
                ids.append(blobs.named(who)[at])
                variants.append(np.frombuffer(data[end:], np.int64)[at] if end < len(data) else np.zeros(n, np.int64))
            ids, variants, starts = (np.concatenate(x) for x in (ids, variants, starts))
            later = _later(ids, starts, np.concatenate(hashes))
            yield from _marks(ids[later], variants[later], starts[later], window)

    return blobs.dealt(docs.mapInArrow(send, blobs.ROUTED)).mapInArrow(meet, MARKS)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space) and removed (maximal intervals of words, end
    exclusive) of every row of docs (doc_id, text).

    Removes each word covered by a window of consecutive words whose sequence also starts earlier: in a smaller
    doc_id, or earlier in the same document.  Windows are judged on the input, by hashes of 63 bits or more, and their
    words are not compared again.  A null or empty text, or one with fewer words than the window, loses nothing.  A row
    without doc_id is kept whole and counts for no other.  Rows that share a doc_id are one document for the order:
    windows at one start of it tie, so rows that are repeated whole lose nothing to each other; each row is otherwise
    judged by its own text.  A text is held whole, with some 40 bytes for each of its own.  Other columns are ignored.
    No rows: no rows.

    Marks are merged to a few intervals for each document and are broadcast where small_side allows it, so that texts
    need not move.  Beyond that, only texts that pass a bounded bitmap of the marked documents meet them in a shuffle."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = small_side(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        named = docs.withColumn("variant", F.lit(0).cast("long"))
    else:
        named = docs.join(again, F.col("doc_id") == F.col("__again"), "left")
        named = named.select("doc_id", "text", F.when(F.col("__again").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long").alias("variant"))
    pieces = _marked(named.where(F.col("doc_id").isNotNull()), window).groupBy("doc_id", "variant").agg(F.collect_list("spans").alias("all"))
    marks = small_side(pieces.mapInArrow(_joined, MARKS).toDF("__doc", "__variant", "spans"), "spans")
    on = (F.col("doc_id") == F.col("__doc")) & (F.col("variant") == F.col("__variant"))
    if is_small(marks):
        joined = named.join(marks, on, "left").select("doc_id", "text", "spans")
    else:
        bits = members_filter(marks, "__doc", BITMAP_BITS, whole=True)
        met = passing(named, "doc_id", bits, True).join(marks, on, "left").select("doc_id", "text", "spans")
        joined = met.union(passing(named, "doc_id", bits, False).select("doc_id", "text", F.lit(None).cast("binary").alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            ids = b.column("doc_id")
            for first, end, data, offsets in chunks(b.column("text")):
                begin, stop, at = words(data, offsets)
                raw = data.tobytes()
                n_words, n_removed, kept, removed = [], [], [], []
                for row in range(end - first):
                    x, y = begin[at[row] : at[row + 1]], stop[at[row] : at[row + 1]]
                    gone = np.frombuffer(spans[first + row] or b"", np.int32).reshape(-1, 2)
                    stay = np.ones(len(x), bool)
                    for p, q in gone.tolist():
                        stay[p:q] = False
                    removed.append(gone.tolist())
                    n_words.append(len(x))
                    n_removed.append(len(x) - int(stay.sum()))
                    kept.append(b" ".join([raw[p:q] for p, q in zip(x[stay].tolist(), y[stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, pa.list_(pa.list_(pa.int64()))),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept", "removed"],
                )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, removed array<array<long>>")

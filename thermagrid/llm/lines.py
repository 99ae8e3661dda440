"""Line dedup over a sharded minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import bounded_batches, drop, scratch
from .textkit import FOLDED, IS_SPACE, Spans, chunks, mix

MIN_LENGTH = 40
MIN_DOCS = 5
#: Keys of a shard, bytes of all shards up to which every task loads them, and copies of a shard beyond that.
SHARD_KEYS = 1 << 16
LOADED_BYTES = 128 << 20
SALTS = 8
#: The place of a null doc_id among others: before all.
NONE = -(1 << 63)
_U = np.uint64


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by levels of bit arrays (Limasset et al., 2017).

    A level sets the bits that exactly one remaining key hashes to; a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.rank = [np.cumsum(x, dtype=np.uint32) for x in levels]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U(level * 0x9E3779B9 + 1)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = 2 * len(keys) + 64
            at = cls.place(keys, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key that was built in; some slot, or -1, of any other."""
        slot = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[todo], level, len(bits))
            hit = bits[at]
            slot[todo[hit]] = self.base[level] + self.rank[level][at[hit]] - 1
            todo = todo[~hit]
        return slot

    def pack(self) -> bytes:
        sizes = np.array([len(self.levels), *(len(x) for x in self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            width = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at))[:size].astype(bool))
            at += width
        return cls(levels)


class Shard:
    """Fingerprint, number of documents and largest doc_id by slot."""

    def __init__(self, row: dict):
        self.hash = PerfectHash.unpack(row["hash"])
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.last = np.frombuffer(row["last"], np.int64)

    def drops(self, keys: np.ndarray, docs: np.ndarray, min_docs: int) -> np.ndarray:
        slot = self.hash.slots(keys)
        known = (slot >= 0) & (self.fingerprints[slot] == keys)
        return known & (self.counts[slot] >= min_docs) & (self.last[slot] != docs)


_held: list = ["", {}]


def _shards(path: str) -> dict[int, Shard]:
    """The shards of an index; a worker keeps the last one it read for its next tasks."""
    if _held[0] != path:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        _held[:] = [path, {r["shard"]: Shard(r) for r in pq.read_table(folder, filesystem=store).to_pylist()}]
    return _held[1]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each row, and the index of each row's first line (one more than rows)."""
    breaks = np.flatnonzero(data == 10)
    at = np.searchsorted(breaks, offsets)
    n = len(offsets) - 1
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.diff(at) + 1, out=first[1:])
    head = np.zeros(first[-1], bool)
    head[first[:-1]] = True
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    tail = np.zeros(first[-1], bool)
    tail[first[1:] - 1] = True
    ends[tail], ends[~tail] = offsets[1:], breaks
    return starts, ends, first


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and code points of each line's key: white space stripped at both ends, A-Z folded."""
    solid = np.flatnonzero(~IS_SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    padded = np.append(solid, len(data))
    x = np.where(full, padded[a], starts)
    y = np.where(full, padded[b - 1] + 1, starts)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return Spans(data, FOLDED).hash(x, y), points[y] - points[x]


def _shard_column(shards: int) -> Column:
    """The shard of a key, from its high bits; the same as blobs.route_of."""
    return F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(shards).cast("long"), 32).cast("int")


def _long_lines(batch: pa.RecordBatch, least: int) -> Iterator[tuple]:
    ids = batch.column("doc_id").to_pylist()
    for first, end, data, offsets in chunks(batch.column("text")):
        starts, ends, at = split(data, offsets)
        keys, points = keys_of(data, starts, ends)
        row = np.repeat(np.arange(end - first), np.diff(at))
        yield first, ids[first:end], data, starts, ends, at, row, keys, np.flatnonzero(points >= least)


def index(docs: DataFrame, least: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> tuple[str, int, int]:
    """Build the shards in the shared folder: (path, number of shards, bytes).

    Lines are counted by hash in Spark, each task sending a hash once for what it holds; hashes in fewer documents
    leave before anything is built."""
    spark = docs.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, names = [], []
            for _, ids, _, _, _, _, row, key, long in _long_lines(b, least):
                named = np.array([NONE if i is None else i for i in ids], np.int64)
                order = np.lexsort((key[long], row[long]))
                k, r = key[long][order], row[long][order]
                fresh = np.ones(len(k), bool)
                fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                keys.append(k[fresh])
                names.append(named[r[fresh]])
            if not keys:
                continue
            k, n = np.concatenate(keys), np.concatenate(names)
            order = np.lexsort((n, k))
            k, n = k[order], n[order]
            ends = np.flatnonzero(np.append(k[1:] != k[:-1], True)) if len(k) else np.zeros(0, np.int64)
            count = np.diff(ends, prepend=-1)
            yield pa.RecordBatch.from_arrays([pa.array(k[ends].view(np.int64)), pa.array(count, pa.int64()), pa.array(n[ends])], ["key", "n", "last"])

    counted = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(tally, "key long, n long, last long")
        .groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)
    )
    kept = scratch(spark, "lines")
    counted.write.parquet(kept)
    counted = spark.read.schema("key long, n long, last long").parquet(kept)
    total = counted.count()
    shards = max(1, -(-total // SHARD_KEYS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), group in blobs.keyed(batches, ["shard"]):
            keys = group.column("key").to_numpy().view(np.uint64)
            hashed = PerfectHash.build(keys)
            slot = hashed.slots(keys)
            arrays = []
            for values, kind in ((keys, np.uint64), (group.column("n").to_numpy(), np.uint32), (group.column("last").to_numpy(), np.int64)):
                array = np.empty(len(keys), kind)
                array[slot] = np.minimum(values, np.iinfo(kind).max) if kind is np.uint32 else values
                arrays.append(array.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([hashed.pack()], pa.binary()), *(pa.array([x], pa.binary()) for x in arrays)],
                ["shard", "hash", "fingerprints", "counts", "last"],
            )

    path = scratch(spark, "line-index")
    sharded = counted.withColumn("shard", _shard_column(shards))
    (
        sharded.repartition("shard").sortWithinPartitions("shard")
        .mapInArrow(build, "shard int, hash binary, fingerprints binary, counts binary, last binary").write.parquet(path)
    )
    drop(spark, kept)
    return path, shards, 24 * total


def deduplicate(docs: DataFrame, least: int = MIN_LENGTH, min_docs: int = MIN_DOCS, loaded: int = LOADED_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (text left) of every row of docs (doc_id, text).

    Lines are split at \\n; a null or empty text is one empty line.  A line's key is the line without white space at
    both ends and with A-Z folded.  A key of at least ``least`` code points found in at least ``min_docs`` documents
    loses all its lines except in the largest doc_id that holds it.  Each row counts as one document, so five rows of one
    doc_id are five; rows that repeat the largest doc_id all keep the line.  A null doc_id comes before any other.  Other columns are ignored.
    No rows: no rows.

    Distinct repeated keys are indexed by a minimal perfect hash in shards of about SHARD_KEYS keys, with arrays of
    fingerprints, counts and largest ids.  Up to ``loaded`` bytes of arrays each task reads the shards from the shared
    folder and probes them in place; beyond that, hashes and line numbers go to the shard, dealt over SALTS copies of
    it, and only the lines to drop come back.  A fingerprint has the key's 64 bits: fewer would, over trillions of
    probes, drop clean lines.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path, shards, size = index(docs, least, min_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(ids: list, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        raw = data.tobytes()
        dropped = np.add.reduceat(gone, at[:-1]).astype(np.int64)
        kept = []
        for i in range(len(ids)):
            a, b = at[i], at[i + 1]
            if not dropped[i]:
                kept.append(raw[starts[a] : ends[b - 1]])
            else:
                stay = np.flatnonzero(~gone[a:b]) + a
                kept.append(b"\n".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(at)), pa.array(dropped), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept"],
        )

    schema = "doc_id long, n_lines long, n_dropped long, kept string"

    if size <= loaded:

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _shards(path)
            for b in batches:
                for _, ids, data, starts, ends, at, row, keys, long in _long_lines(b, least):
                    named = np.array([NONE if i is None else i for i in ids], np.int64)
                    gone = np.zeros(len(keys), bool)
                    for shard, at_ in blobs.split(blobs.route_of(keys[long], shards), shards):
                        if shard in found:
                            mine = long[at_]
                            gone[mine] = found[shard].drops(keys[mine], named[row[mine]], min_docs)
                    yield cut(ids, data, starts, ends, at, gone)

        return rows.mapInArrow(probe, schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column("mark").to_numpy()
            for first, ids, _, _, _, at, row, keys, long in _long_lines(b, least):
                named = np.array([NONE if i is None else i for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (keys[long].view(np.int64), named[row[long]], marks[first + row[long]], long - at[row[long]])],
                    ["key", "doc_id", "mark", "line"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        for b in batches:
            names = b.column("shard").to_numpy().astype(np.int64) * SALTS + b.column("salt").to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y == x:
                    continue
                part = b.slice(x, y - x)
                if names[x] != current:
                    current, shard = names[x], None
                is_index = part.column("hash").is_valid().to_numpy(zero_copy_only=False)
                if is_index.any():
                    shard = Shard(part.slice(0, 1).to_pylist()[0])
                    part = part.slice(int(is_index.sum()))
                if shard is None or not part.num_rows:
                    continue
                drops = shard.drops(part.column("key").to_numpy().view(np.uint64), part.column("doc_id").to_numpy(), min_docs)
                yield part.select(["doc_id", "mark", "line"]).filter(pa.array(drops))

    marked = rows.withColumn("mark", F.xxhash64("text"))
    asked = marked.mapInArrow(ask, "key long, doc_id long, mark long, line long")
    none = [F.lit(None).cast("binary").alias(c) for c in ("hash", "fingerprints", "counts", "last")]
    salt = F.pmod(F.xxhash64("doc_id", "line"), F.lit(SALTS)).cast("int")
    asked = asked.select(_shard_column(shards).alias("shard"), salt.alias("salt"), "key", "doc_id", "mark", "line", *none)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    blank = [F.lit(None).cast("long").alias(c) for c in ("key", "doc_id", "mark", "line")]
    filed = spark.read.parquet(path).select("shard", salts, *blank, "hash", "fingerprints", "counts", "last")
    both = filed.union(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("hash").isNull())
    gone = (
        both.mapInArrow(answer, "doc_id long, mark long, line long")
        .groupBy("doc_id", "mark").agg(F.collect_set("line").alias("lines")).toDF("__doc", "__mark", "lines")
    )
    joined = marked.join(gone, (F.coalesce("doc_id", F.lit(NONE)) == F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column("lines").to_pylist()
            for first, ids, data, starts, ends, at, _, keys, _ in _long_lines(b, least):
                out = np.zeros(len(keys), bool)
                for i in range(len(ids)):
                    if lines[first + i]:
                        out[at[i] + np.array(lines[first + i])] = True
                yield cut(ids, data, starts, ends, at, out)

    return joined.select("doc_id", "text", "lines").mapInArrow(finish, schema)

"""WARC archives: a writer with revisit records and a splittable reader of gzip members."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, is_small, small_side
from .filters import members_filter, passing

#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of an archive that one reading task owns.
SPLIT_BYTES = 16 << 20
#: The WARC version, and the revisit profile of equal payloads.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 18
#: Bytes inflated at once before the header is whole.
_HEADER = 1 << 16
RECORDS = (
    "record_id string, record_type string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary, "
    "path string, at long, member_bytes long"
)
#: Bits of the bitmap of repeated digests where they are too many to be broadcast.
BITMAP_BITS = 1 << 28


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def planned(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload, digest, keeper: keeper is the page_id whose record holds the
    payload where another row repeats it, else null.

    Digests are counted by a narrow aggregation of their own, and what repeats is broadcast where small_side allows it, so
    that payloads need not move.  Beyond that, only payloads whose digest passes a bounded bitmap of the repeated ones
    meet them in a shuffle, where Spark splits the hot ones."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= least)
    again = long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")).where("n > 1")
    again = small_side(again.select(F.col("digest").alias("__digest"), "keeper", F.xxhash64("digest").alias("__key")))
    on = F.col("digest") == F.col("__digest")
    if is_small(again):
        return rows.join(again, on, "left").drop("__digest", "__key")
    bits = members_filter(again, "__key", BITMAP_BITS, whole=True)
    keyed = rows.withColumn("__of", F.when(F.octet_length("payload") >= least, F.xxhash64("digest")))
    met = passing(keyed, "__of", bits, True).join(again, on, "left").drop("__digest", "__key", "__of")
    return met.union(passing(keyed, "__of", bits, False).drop("__of").withColumn("keeper", F.lit(None).cast("long")))


def _named(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None) -> bytes:
    """One WARC record, uncompressed.  A revisit has the HTTP header, with the payload's length, and no payload."""
    revisit = keeper is not None and keeper != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_named(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_named(keeper)}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> list[tuple[str, int]]:
    """Write one archive for each task into folder, which all executors share: [(path, bytes)].

    Each record is a gzip member of its own.  A file is written under a name of the attempt and then moved, so a
    repeated task replaces it whole.  The list has a row for each file, not for each page."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():05d}.warc.gz"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        size = 0
        with store.open_output_stream(draft, compression=None) as out:
            for b in batches:
                for i in range(b.num_rows):
                    page_id, url, payload, digest, keeper = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "keeper"))
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, digest, keeper)) + packer.flush()
                    out.write(member)
                    size += len(member)
        if size:
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["name", "bytes"])
        else:
            store.delete_file(draft)

    bounded_batches(pages.sparkSession)
    rows = planned(pages, least).select("page_id", "url", "payload", "digest", "keeper").mapInArrow(save, "name string, bytes long").collect()
    return sorted((f"{folder}/{r['name']}", r["bytes"]) for r in rows)


class _Window:
    """Bytes of a file from a place on, in blocks; what was consumed is forgotten."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        block = self.file.read(_BLOCK)
        self.held += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n


def _headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """WARC headers and where the block starts, if raw begins with a whole WARC header."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    return (head, end + 4) if head.get("Content-Length", "").isdigit() and "WARC-Type" in head else None


def _member(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, compressed bytes) of the gzip member at the window's start, if it is a WARC record.

    What only looks like a member is given up as soon as its bytes don't inflate to the start of a WARC header.  The header
    may be of any length, as it has the whole URL; only the member's end bounds it."""
    inflate, out, used, head = zlib.decompressobj(31), [], 0, None
    start = tail = b""
    while True:
        fresh = window.held[used:]
        if not fresh:
            if not window.more():
                return None
            continue
        try:
            piece = inflate.decompress(fresh, _HEADER if head is None else _BLOCK * 16)
        except zlib.error:
            return None
        # at the end, what is left may be in both
        used += len(fresh) - len(inflate.unused_data if inflate.eof else inflate.unconsumed_tail)
        out.append(piece)
        if head is None:
            start, tail = (start + piece)[:5], tail[-3:] + piece
            if b"\r\n\r\n" in tail:
                head = _headers(b"".join(out))
                if head is None:
                    return None
            elif inflate.eof or not b"WARC/".startswith(start):
                return None
        if inflate.eof:
            raw = b"".join(out)
            length = int(head[0]["Content-Length"])
            block = raw[head[1] : head[1] + length]
            return (head[0], block, used) if len(block) == length else None


def scan(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, place and bytes of the member) of records whose member starts in [start, end).  Looks for gzip magic, tries each find as a record, and after a
    record goes on where it ended; the last record may end beyond the range."""
    window = _Window(file, start)
    while window.at < end:
        at = window.held.find(_MAGIC)
        if at < 0:
            keep = min(len(window.held), len(_MAGIC) - 1)
            window.drop(len(window.held) - keep)
            if window.at >= end or not window.more():
                return
            continue
        window.drop(at)
        if window.at >= end:
            return
        found = _member(window)
        if found is None:
            window.drop(1)
            continue
        yield found[0], found[1], window.at, found[2]
        window.drop(found[2])


def read(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> DataFrame:
    """Records of WARC files [(path, bytes)] as RECORDS, by tasks that each own a byte range of one file.

    payload is the HTTP body (null for a revisit); payload_bytes its length, for a revisit as its HTTP header says;
    payload_digest bare lower-case hex, of a response computed from the bytes read.  path, at and member_bytes say where
    the record was.  Damaged members are skipped: unread() tells how much of a file that is.
    """
    counts = [-(-size // split) for _, size in files]
    total = sum(counts)
    firsts = [0, *itertools.accumulate(counts)]
    table = spark.createDataFrame([(path, size, first) for (path, size), first in zip(files, firsts, strict=False)], "path string, size long, first long")
    steps = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))
    starts = table.where("size > 0").select("path", "size", F.posexplode(steps).alias("k", "start"), "first")
    ranges = starts.select("path", "start", F.least(F.col("start") + split, F.col("size")).alias("end"), (F.col("first") + F.col("k")).cast("int").alias("part"))
    ranges = ranges.repartitionById(max(1, total), "part").select("path", "start", "end")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            columns = zip(*rows, strict=True)
            kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in RECORDS.split(", ")]
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for part in b.to_pylist():
                store, path = opened(part["path"])
                with store.open_input_file(path) as file:
                    for head, block, at, used in scan(file, part["start"], part["end"]):
                        http, _, body = block.partition(b"\r\n\r\n")
                        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        revisit = head["WARC-Type"] == "revisit"
                        digest = head.get("WARC-Payload-Digest", "").rpartition(":")[2] if revisit else hashlib.sha1(body).hexdigest()
                        size = int(said[1]) if revisit and said else len(body)
                        names = [head.get(f"WARC-{x}") for x in ("Record-ID", "Type", "Refers-To", "Target-URI")]
                        rows.append((*names, digest, size, None if revisit else body, part["path"], at, used))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield flush()
        if rows:
            yield flush()

    return ranges.mapInArrow(records, RECORDS)


def unread(records: DataFrame, files: list[tuple[str, int]]) -> DataFrame:
    """(path, bytes, records, unread): how many bytes of each file belong to no record that read() found."""
    table = records.sparkSession.createDataFrame(files, "path string, bytes long")
    found = records.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.sum("member_bytes").alias("n"))
    none = F.lit(0).cast("long")
    left = F.col("bytes") - F.coalesce("n", none)
    return table.join(found, "path", "left").select("path", "bytes", F.coalesce("records", none).alias("records"), left.alias("unread"))


def page_id(name: str) -> Column:
    return F.regexp_extract(name, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")

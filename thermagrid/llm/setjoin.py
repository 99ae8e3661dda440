"""N-gram Jaccard join with PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Sets of shingle hashes fall into bands of nearly equal size; two sets whose similarity reaches the threshold are in
the same band or in neighbouring ones.  In a band the threshold bounds the Hamming distance by k.  The hash domain is
cut into first-level partitions so that one of them holds at most k2 of the differences, each cut again into n2 parts,
of which all but k2 must then agree: every subset of n2 - k2 parts gives a signature, and similar sets share one.

A signature of an empty subset says little, so there are spare first-level partitions, and similar sets agree in one
more partition than are spare.  A set with no more partly empty ones than that drops its empty signatures, and its
partners still meet it elsewhere.  A set with more of them drops them too but also joins a further level, partitioned
anew, where two such sets meet in the same way; the last level keeps them all.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import bounded_batches, forget, fresh, partitions, small_side, stored
from .components import connected, lowest
from .filters import members_filter, passes
from .textkit import mix, shingle_sets

_U = np.uint64
_FACTORS = mix(np.arange(7000, 7064, dtype=np.uint64)) | _U(1)
LEVELS = 4
#: (k2, n2), by rising selectivity and cost; the first that fills a subset well is taken.
DESIGNS = ((1, 3),)
#: Elements and documents that a task holds before it sends their signatures.
HELD_SHINGLES = 600_000
HELD_DOCS = 60_000
#: Distinct sets of a candidate cluster that are compared at once.
BLOCK = 512
#: Candidate clusters with more distinct sets are cut up first, by shingles that no other of their sets has.
LARGE = 2 * BLOCK
#: Bytes of a signature that travel beside its route, and of a shingle in a stored set.
SENT = 5
_DROPPED = _U(64 - 8 * SENT)


def bands(percent: int) -> list[tuple[int, int]]:
    found = [(1, 100 // percent)]
    while found[-1][1] < 1 << 40:
        low = found[-1][1] + 1
        found.append((low, low * 100 // percent))
    return found


@functools.lru_cache(None)
def design(percent: int, band: int) -> tuple[int, int, int, np.ndarray]:
    """(first-level partitions, spare ones among them, parts of each, subsets of parts) of a band."""
    all_bands = bands(percent)
    high, low = all_bands[band][1], all_bands[max(0, band - 1)][0]
    k = 2 * high * (100 - percent) // (100 + percent)
    if k == 0:
        return 1, 0, 1, np.array([[0]])
    if k <= 4:
        n2 = 2 * k + (k < 4)
        return 1, 0, n2, np.array(list(combinations(range(n2), n2 - k)))
    for k2, n2 in DESIGNS:
        subsets = np.array(list(combinations(range(n2), n2 - k2)))
        n1, spare = -(-(k + 1) // (k2 + 1)), 1
        for _ in range(3):
            filled = low * (n2 - k2) / n2 / (n1 + spare)
            empty = n1 * min(1.0, len(subsets) * math.exp(-filled))
            spare = max(1, min(n1 // 3, math.ceil(empty + 2 * math.sqrt(empty))))
        if filled >= 5:
            break
    return n1 + spare, spare, n2, subsets


def signatures(sets: list[np.ndarray], band: int, percent: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of sorted, nonempty sets in one band."""
    n1, spare, n2, subsets = design(percent, band)
    cells, m = n1 * n2, len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    h = np.concatenate(sets)
    if level:
        h = mix(h + _U(level))
        h = h[np.lexsort((h, owner))]
    cell = (((h >> _U(32)) * _U(cells)) >> _U(32)).astype(np.int64) + owner * cells
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + _U(1)), out=sums[1:])
    at = np.searchsorted(cell, np.arange(m * cells + 1))
    content = (sums[at[1:]] - sums[at[:-1]]).reshape(m, n1, n2) * _FACTORS[:n2]
    tag = mix(np.arange(n1 * len(subsets), dtype=np.uint64) + _U((band * 16 + level) << 24))
    signature = mix(content[:, :, subsets].sum(3).reshape(m, -1) + tag)
    empty = np.diff(at).reshape(m, n1, n2)[:, :, subsets].sum(3) == 0
    last = level == LEVELS or n1 * n2 == 1
    of, which = np.nonzero(np.ones_like(signature, bool) if last else ~empty.reshape(m, -1))
    again = np.flatnonzero(empty.any(2).sum(1) > spare)
    if last or not len(again):
        return of, signature[of, which]
    more, deeper = signatures([sets[i] for i in again], band, percent, level + 1)
    return np.concatenate([of, again[more]]), np.concatenate([signature[of, which], deeper])


def all_signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) in each set's own band and, as a visitor, in the next; by index."""
    lows = np.array([b[0] for b in bands(percent)])
    sizes = np.array([len(s) for s in sets])
    own = np.searchsorted(lows, sizes, "right") - 1
    visits = sizes * 100 // percent >= lows[own + 1]
    of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for band in np.unique(np.concatenate([own, own[visits] + 1])):
        here = np.flatnonzero((own == band) | (visits & (own + 1 == band)))
        step = max(1, 200_000 // max(1, int(sizes[here].mean())))
        for a in range(0, len(here), step):
            some = here[a : a + step]
            x, y = signatures([sets[i] for i in some], int(band), percent)
            of.append(some[x])
            found.append(y)
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return of[order], found[order]


def _stars(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges from each id to the smallest of its key, as rows; positions of the smallest)."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    head = i[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    edges = np.stack([head[~first], i[~first]], 1)
    return np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0), order[first]


def _pack(names: np.ndarray, of: np.ndarray, found: np.ndarray, route_of: np.ndarray, routes: int) -> list[tuple]:
    """A row for each route of the low ends of the hashes that documents (by ascending index) send."""
    rows = []
    for route, at in blobs.split(route_of, routes):
        who, which = np.unique(of[at], return_inverse=True)
        gaps = np.diff(which, prepend=0)
        gaps = gaps.astype(np.uint8 if gaps.max() < 256 else np.uint32)
        short = np.ascontiguousarray(found[at].view(np.uint8).reshape(-1, 8)[:, :SENT])
        rows.append((route, blobs.ids(names[who]), gaps.tobytes(), short.tobytes()))
    return rows


def _sent(names: np.ndarray, of: np.ndarray, found: np.ndarray, routes: int, turn: int, equal: list[tuple[int, int]] | None = None) -> list[tuple]:
    """Rows that let documents (by ascending index) meet on hashes.  What a task has of a hash is reduced to one document,
    and edges from it to the others; edges are dealt out from ``turn`` on."""
    edges, heads = _stars(names[of], found)
    keep = np.sort(heads)
    of, found = of[keep], found[keep]
    rows = _pack(names, of, found, blobs.route_of(found, routes), routes)
    pairs = np.concatenate([edges, np.array(equal or [], np.int64).reshape(-1, 2)])
    for k, a in enumerate(range(0, len(pairs), 1 << 16)):
        rows.append((-1 - (turn + k) % routes, None, None, pairs[a : a + (1 << 16)].tobytes()))
    return rows


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all that _pack sent to one route."""
    ids, keys = [], []
    for docs_, gaps, data in zip(*(group.column(c).to_pylist() for c in ("docs", "gaps", "data")), strict=True):
        keys.append(blobs.lengthened(data, SENT))
        step = np.frombuffer(gaps, np.uint8 if len(gaps) == len(keys[-1]) else np.uint32)
        ids.append(blobs.named(docs_)[np.cumsum(step.astype(np.int64))])
    return np.concatenate(ids), np.concatenate(keys)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (route,), group in blobs.keyed(batches, ["route"]):
        if route < 0:
            edges = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in group.column("data").to_pylist()])
        else:
            edges, _ = _stars(*_unpacked(group))
        edges = np.unique(edges, axis=0)
        for a in range(0, len(edges), 1 << 16):
            part = edges[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])


def _candidates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): every pair above the threshold is joined by a path of these edges.

    What one task has of a signature is reduced to one document before the shuffle, so a signature that a third of
    all rows share arrives once for each task."""
    routes = blobs.routes_for(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        ids: list[int] = []
        same: dict[tuple[int, int], int] = {}
        equal: list[tuple[int, int]] = []
        held, turn = 0, blobs.first_turn()

        def flush() -> pa.RecordBatch:
            nonlocal sets, ids, same, equal, held, turn
            rows = _sent(np.array(ids, np.int64), *all_signatures(sets, percent), routes, turn, equal)
            turn += 7919
            sets, ids, same, equal, held = [], [], {}, [], 0
            return blobs.batch(rows)

        for b in batches:
            names = b.column(0).to_pylist()
            for row, found in shingle_sets(b.column(1), words):
                if names[row] is None or not len(found):
                    continue
                key = (len(found), int(mix(found).sum()))
                if key in same:
                    equal.append((same[key], names[row]))
                    continue
                same[key] = names[row]
                sets.append(found)
                ids.append(names[row])
                held += len(found)
                if held >= HELD_SHINGLES or len(sets) + len(equal) >= HELD_DOCS:
                    yield flush()
        if sets:
            yield flush()

    sent = docs.select("doc_id", "text").mapInArrow(send, blobs.ROUTED)
    return blobs.dealt(sent).mapInArrow(_meet, "a long, b long")


def _unique_shares(sets: DataFrame) -> DataFrame:
    """(rep, n): how many shingles of each set (rep, shingles) other sets have too, where there are any.

    Hashes go by range to the tasks that count them.  A task sends a shingle once, and credits itself those that
    several of its own sets have, so a shingle that a third of all sets have arrives once from each task."""
    routes, spread = blobs.routes_for(sets), partitions(sets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = blobs.first_turn()
        for names, held in _piled(batches):
            of = np.repeat(np.arange(len(held)), [len(x) for x in held])
            h = np.concatenate(held)
            order = np.argsort(h, kind="stable")
            first = np.ones(len(h), bool)
            first[1:] = h[order[1:]] != h[order[:-1]]
            often = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
            heads, run = order[first], np.cumsum(first) - 1
            own = np.bincount(of[order[often[run]]], minlength=len(held))
            # shingles that several sets here have are sent without an owner
            alone, shared = np.sort(heads[~often]), heads[often]
            route_of = blobs.route_of(h << _DROPPED, routes)
            rows = _pack(names, of[alone], h[alone], route_of[alone], routes) if len(alone) else []
            for route, at in blobs.split(route_of[shared], routes):
                rows.append((route, None, None, blobs.shortened(h[shared][at], SENT)))
            full = np.flatnonzero(own)
            turn += 1
            rows.append((-1 - turn % routes, names[full].tobytes(), None, own[full].astype(np.int64).tobytes()))
            yield blobs.batch(rows)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting
            names, n = _summed(held)
            held, waiting = [], 0
            to = blobs.route_of(mix(names.view(np.uint64)), spread)
            return blobs.batch([(r, names[at].tobytes(), None, n[at].tobytes()) for r, at in blobs.split(to, spread)])

        for (route,), group in blobs.keyed(batches, ["route"]):
            if route < 0:
                held.append(tuple(np.concatenate([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()]) for c in ("docs", "data")))
            else:
                owned = group.filter(group.column("docs").is_valid())
                names, h = _unpacked(owned) if owned.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                others = [blobs.lengthened(x, SENT) for x in group.filter(group.column("docs").is_null()).column("data").to_pylist()]
                _, which, count = np.unique(np.concatenate([h, *others]), return_inverse=True, return_counts=True)
                held.append(np.unique(names[count[which[: len(h)]] > 1], return_counts=True))
            waiting += len(held[-1][0])
            if waiting >= HELD_SHINGLES:
                yield flush()
        if waiting:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in blobs.keyed(batches, ["route"]):
            rep, n = _summed([tuple(np.concatenate([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()]) for c in ("docs", "data"))])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n)], ["rep", "n"])

    credits = blobs.dealt(sets.mapInArrow(send, blobs.ROUTED)).mapInArrow(tally, blobs.ROUTED)
    return blobs.dealt(credits).mapInArrow(add, "rep long, n long")


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, which = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
    return names, np.bincount(which, weights=np.concatenate([n for _, n in counts]), minlength=len(names)).astype(np.int64)


def _prefix_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets (rep, shingles): every pair above the threshold is joined by a path of these edges.

    Two sets that reach the threshold share a shingle among the first size - ceil(threshold * size) + 1 of each in any
    one order of all shingles (prefix filter).  The order is by the number of sets that have a shingle, so what is met on
    is rare.  Sets are dealt into groups; a group sends each of its shingles once, with its count, to be counted over
    all groups, and gets the counts of those that others have too."""
    groups_ = partitions(sets)
    dealt = sets.select(F.pmod(F.xxhash64("rep"), F.lit(groups_)).cast("int").alias("route"), F.col("rep"), F.col("shingles").alias("data"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group,), rows in blobs.keyed(batches, ["route"]):
            h, n = np.unique(np.concatenate([blobs.lengthened(x, SENT) for x in rows.column("data").to_pylist()]), return_counts=True)
            to = blobs.split(blobs.route_of(h << _DROPPED, groups_), groups_)
            yield blobs.batch([(route, np.int64(group).tobytes(), blobs.narrow(n[at]), blobs.shortened(h[at], SENT)) for route, at in to])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in blobs.keyed(batches, ["route"]):
            group, counts, hashes = (rows.column(c).to_pylist() for c in ("docs", "gaps", "data"))
            hashes = [blobs.lengthened(x, SENT) for x in hashes]
            h, which = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([blobs.widened(x) for x in counts])).astype(np.int64)
            answers = []
            for g, one in zip(group, hashes, strict=True):
                often = n[np.searchsorted(h, one)]
                one, often = one[often > 1], often[often > 1]
                if len(one):
                    answers.append((int(np.frombuffer(g, np.int64)[0]), None, blobs.narrow(often), blobs.shortened(one, SENT)))
            if answers:
                yield blobs.batch(answers)

    routes = blobs.routes_for(sets)

    def meet_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = blobs.first_turn()
        for _, rows in blobs.keyed(batches, ["route"]):
            known = rows.column("docs").is_null()
            tables = rows.filter(known)
            if not tables.num_rows:
                continue
            h = np.concatenate([blobs.lengthened(x, SENT) for x in tables.column("data").to_pylist()])
            n = np.concatenate([blobs.widened(x) for x in tables.column("gaps").to_pylist()])
            order = np.argsort(h)
            h, n = h[order], n[order]
            own = rows.filter(pc.invert(known))
            of, found = [], []
            for i, packed in enumerate(own.column("data").to_pylist()):
                s = blobs.lengthened(packed, SENT)
                at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                often = np.where(h[at] == s, n[at], 1)
                first = np.lexsort((s, often))[: len(s) - -(-percent * len(s) // 100) + 1]
                first = first[often[first] > 1]
                of.append(np.full(len(first), i))
                found.append(mix(s[first] + _U(3)))
            names = np.concatenate([np.frombuffer(x, np.int64) for x in own.column("docs").to_pylist()])
            sent = _sent(names, np.concatenate(of), np.concatenate(found), routes, turn)
            turn += 7919
            if sent:
                yield blobs.batch(sent)

    answers = blobs.dealt(blobs.dealt(dealt).mapInArrow(count, blobs.ROUTED)).mapInArrow(total, blobs.ROUTED)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield blobs.batch([(r, np.int64(i).tobytes(), None, x) for r, i, x in zip(*(b.column(c).to_pylist() for c in ("route", "rep", "data")), strict=True)])

    both = blobs.dealt(answers.union(dealt.mapInArrow(named, blobs.ROUTED)))
    return blobs.dealt(both.mapInArrow(meet_on, blobs.ROUTED)).mapInArrow(_meet, "a long, b long")


def _piled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rep, sets) of batches of (rep, shingles), about HELD_SHINGLES at a time."""
    names, held, count = [], [], 0
    for b in batches:
        for rep, packed in zip(b.column("rep").to_pylist(), b.column("shingles").to_pylist(), strict=True):
            names.append(rep)
            held.append(blobs.lengthened(packed, SENT))
            count += len(held[-1])
            if count >= HELD_SHINGLES:
                yield np.array(names, np.int64), held
                names, held, count = [], [], 0
    if held:
        yield np.array(names, np.int64), held


def _refined(placed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """placed (rep, cluster) with the large clusters cut up, and no pair above the threshold parted.

    Passages that many documents hold chain documents into large clusters by chance.  A set that reaches the threshold
    with another has at least that percentage of its shingles in common with it; so one with fewer shingles that any
    other set of the large clusters has links with nothing and leaves.  Those that stay meet by _prefix_edges."""
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
    sizes = small_side(sizes.select("cluster"))
    if sizes.isEmpty():
        return placed
    chosen = small_side(placed.join(sizes, "cluster", "left_semi").select("rep"))
    sets = known.where("shingles is not null").join(chosen, F.col("doc_id") == F.col("rep")).select("rep", "shingles")
    width = F.octet_length("shingles") / SENT
    stay = _unique_shares(sets).withColumnRenamed("rep", "__rep").join(sets.select("rep", width.alias("width")), F.col("rep") == F.col("__rep"))
    # a doc_id that repeats with several texts stays if one of them may
    stay = small_side(stay.where(100 * F.col("n") >= percent * F.col("width")).select("__rep").distinct())
    parts = connected(_prefix_edges(sets.join(stay, F.col("rep") == F.col("__rep"), "left_semi"), percent))
    cut = parts.union(parts.select("component", "component")).distinct().toDF("rep", "cluster")
    # clusters are named by members, so names of cut and uncut ones differ
    done = stored(placed.join(sizes, "cluster", "left_anti").select("rep", "cluster").union(cut), "placed")
    forget(parts, stay, chosen, sizes)
    return done


def _linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of the first set of its component under 100 * common >= percent * union; with side, only
    sets of different sides are compared."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(int))
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner = owner[shared]
    renumber = np.cumsum(counts > 1) - 1
    column = renumber[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = np.arange(n) if side is None else np.flatnonzero(side)
    right = np.arange(n) if side is None else np.flatnonzero(~side)
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, (a, a + width))
        block = np.zeros((n, width), np.float32)
        block[owner[x:y], column[x:y] - a] = 1
        common += block[left] @ block[right].T
    common = common.astype(np.float64)
    i, j = np.nonzero(100 * common >= percent * (sizes[left, None] + sizes[None, right] - common))
    label = np.arange(n)
    node, low = lowest(left[i], right[j])
    label[node] = low
    return label


KNOWN = "doc_id long, n_shingles long, one long, two long, shingles binary"


def _known(docs: DataFrame, members: DataFrame, words: int, sizes: bool) -> DataFrame:
    """KNOWN, written: size and 128-bit hash of the set of every document, and the set itself of members (__doc) and a
    few others: the low end of each hash is left out.  With sizes False, only of those."""
    bits = members_filter(members, "__doc")
    if bits is None:  # too many for a bounded filter: the texts are joined with them
        marked = docs.join(members.select("__doc").distinct(), F.col("doc_id") == F.col("__doc"), "left")
    else:
        marked = docs.withColumn("__doc", F.col("doc_id"))
        bits = docs.sparkSession.sparkContext.broadcast(bits)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside = b.column("__doc").is_valid().to_numpy(zero_copy_only=False)
            if bits is not None:
                names = b.column("doc_id").fill_null(0).to_numpy()
                inside &= passes(bits.value, names)
            if not sizes:
                b, inside = b.filter(pa.array(inside)), np.ones(int(inside.sum()), bool)
            rows, start, pending = [], 0, 0
            for row, found in shingle_sets(b.column("text"), words):
                key = (int(mix(found).sum().view(np.int64)), int(mix(found + _U(9)).sum().view(np.int64)))
                kept = blobs.shortened(np.unique(found >> _DROPPED), SENT) if inside[row] and len(found) else None
                rows.append((len(found), *key, kept))
                pending += len(found) * int(inside[row])
                if pending > 1 << 20 or row == b.num_rows - 1:
                    n, one, two, packed = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").slice(start, row + 1 - start), *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(packed, pa.binary())],
                        [x.split()[0] for x in KNOWN.split(", ")],
                    )
                    rows, start, pending = [], row + 1, 0

    return stored(marked.select("doc_id", "__doc", "text").mapInArrow(collect, KNOWN), "sets")


def groups(docs: DataFrame, words: int = 5, percent: int = 80, sizes: bool = True) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct word shingles;
    component_id is the smallest doc_id reachable by links, the document itself included.  Candidates come from shared
    signatures; equal sets are then one, and the sets of a candidate cluster are compared in full, in blocks of about
    BLOCK, so every pair of a cluster is judged and links are reduced to spanning edges before they leave a task.
    Shingles stand for themselves by 64-bit hashes, of which the comparison has the high 40 bits.

    A text with fewer words has one shingle, of all its words.  A null or empty text, or one without words, has none
    and links with nothing.  A null doc_id links with nothing and has a null component.  Repeated rows each give a row;
    rows that share a doc_id are one node.  Other columns are ignored.  No rows: no rows.  With sizes False, rows
    outside any candidate cluster are left out.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    clusters = connected(_candidates(docs, words, percent))
    members = stored(clusters.union(clusters.select("component", "component")).distinct().toDF("__doc", "cluster"), "members")
    forget(clusters)
    known = _known(docs, members, words, sizes)
    every = stored(known.select("doc_id", "n_shingles"), "sizes")
    key = ["cluster", "n_shingles", "one", "two"]
    inside = known.where("shingles is not null").select("doc_id", "n_shingles", "one", "two").join(members, F.col("doc_id") == F.col("__doc"))
    equal = stored(inside.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "equal")
    copies = inside.join(equal.where("copies > 1"), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    placed = stored(equal.select("rep", "cluster").distinct(), "placed")
    ready = _refined(placed, known, percent)
    sized = ready.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    spots = small_side(ready.join(sized, "cluster"))
    cut = known.where("shingles is not null").join(spots, F.col("doc_id") == F.col("rep"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cut = cut.select("rep", "cluster", "shingles", "part", other)
    cut = cut.select("rep", "cluster", "shingles", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), group in blobs.keyed(batches, ["cluster", "x", "y"]):
            ids = group.column("rep").to_numpy()
            if len(ids) < 2:
                continue
            sets = [blobs.lengthened(s, SENT) for s in group.column("shingles").to_pylist()]
            label = _linked(sets, percent, None if x == y else group.column("part").to_numpy() == x)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["a", "b"])

    dealt = cut.repartition(partitions(docs), "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    found = connected(dealt.mapInArrow(compare, "a long, b long").union(copies))
    forget(spots, ready, placed, equal, known, members)
    rows = every.join(found.withColumnRenamed("node", "__node"), F.col("doc_id") == F.col("__node"), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose doc_id isn't the smallest of its group.

    Of rows that share a doc_id one stays, the first by its columns as JSON: they are one document.  Rows without a
    doc_id all stay, as they link with nothing.  Null, empty and short texts are as in groups(); other columns are
    kept.  No rows: no rows."""
    gone, more, row = fresh(docs, "__gone", "__again", "__row")
    found = groups(docs, words, percent, sizes=False).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    rows = docs.join(small_side(found), docs["doc_id"] == F.col(gone), "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(more))
    again = small_side(again)
    if again.isEmpty():
        return rows
    on = F.col("doc_id") == F.col(more)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rows.join(again, on, "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return rows.join(again, on, "left_anti").unionByName(one)

"""Near-duplicate vectors by spherical-cap filters with random product codes (Becker, Ducas, Gama, Laarhoven, 2016).

A vector is turned by a random rotation and cut into blocks; each block has a small random code of unit vectors, and a
filter is one code word of each block.  A vector belongs to every filter whose direction it exceeds by a threshold,
which list decoding finds from the few best words of each block without walking through all filters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import bounded_batches, forget, partitions, stored
from .components import connected, lowest

COSINE = 0.98
SEED = 77
#: Blocks of a vector, code words of a block at least and at most, filters that a random vector joins on average, and
#: vectors that a filter then has: with more vectors there are more words.
BLOCKS, WORDS, MOST_WORDS, FILTERS, BUCKET = 4, 24, 256, 48, 512
#: A cap is at least this wide (as a cosine), well beyond the angle of near duplicates: short vectors have fewer words.
WIDEST = 0.85
#: Rows of a bucket that are compared at once, and vectors whose filters a task remembers.
BLOCK, KEPT = 1024, 1 << 16


class Code:
    """The filters of vectors of one length, for about n vectors.

    A vector joins the filters within the cap, and those within ``slack`` of its nearest; both are fitted to random
    vectors, so that each gives half of FILTERS on average whatever the length.  The same on every task."""

    def __init__(self, dim: int, n: int = 0, seed: int = SEED):
        blocks = max(1, min(BLOCKS, dim // 2))
        words = min(MOST_WORDS, max(WORDS, math.ceil((n * FILTERS / BUCKET) ** (1 / blocks))))
        while True:
            self._fit(dim, blocks, words, np.random.default_rng([seed, dim]))
            if self.cap <= WIDEST or words <= 4:
                break
            words = words * 3 // 4

    def _fit(self, dim: int, blocks: int, words: int, rng: np.random.Generator) -> None:
        self.words, self.blocks = words, blocks
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        code = []
        for cut in np.array_split(np.arange(dim), blocks):
            w = rng.standard_normal((words, len(cut)))
            code.append(turn[:, cut] @ (w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks)).T)
        # all code words in the coordinates of the vector itself: one product for each vector
        self.all = np.ascontiguousarray(np.concatenate(code, 1).T)
        some = rng.standard_normal((128, dim))
        scores = self._scores(some / np.linalg.norm(some, axis=1, keepdims=True))
        nearest = np.sum([s.max(1) for s in scores], axis=0)
        wanted = len(some) * min(FILTERS, words**blocks) / 2

        def fitted(reach: Callable[[float], np.ndarray]) -> float:
            """The largest x for which vectors have at least the filters wanted above reach(x)."""
            high, step = 1.0, 0.1 / math.sqrt(dim)
            low = high
            while low > -1 and len(self._decode(reach(low), scores)[0]) < wanted:
                low, high = low - step, low
            for _ in range(10):
                middle = (low + high) / 2
                low, high = (middle, high) if len(self._decode(reach(middle), scores)[0]) >= wanted else (low, middle)
            return low

        self.cap = fitted(lambda x: np.full(len(nearest), x))
        self.slack = 1 - fitted(lambda x: nearest - (1 - x))

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        """Scores with the words of each block, a vector at a time: a vector's are the same in any batch."""
        out = np.empty((len(unit), len(self.all)))
        for row, u in zip(out, unit, strict=True):
            np.dot(self.all, u, out=row)
        return np.split(out, self.blocks, axis=1)

    def _decode(self, need: np.ndarray, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        best = [s.max(1) for s in scores]
        of, total, name = np.arange(len(need)), np.zeros(len(need)), np.zeros(len(need), np.int64)
        for i, s in enumerate(scores):
            reach = total[:, None] + s[of]
            for later in best[i + 1 :]:  # best still to come
                reach = reach + later[of][:, None]
            row, word = np.nonzero(reach >= need[of][:, None])
            total = total[row] + s[of[row], word]
            name = name[row] * self.words + word
            of = of[row]
        return of, name

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the vector, filter) for all filters within the cap, and those within the slack of its nearest where
        that is farther; by index."""
        scores = self._scores(unit)
        nearest = np.sum([s.max(1) for s in scores], axis=0)
        return self._decode(np.minimum(self.cap, nearest - self.slack), scores)

    def lists(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters of each vector, ascending."""
        of, name = self.filters(unit)
        order = np.lexsort((name, of))
        return np.split(name[order], np.searchsorted(of[order], np.arange(1, len(unit))))


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _met_before(filters: list[np.ndarray], now: int) -> np.ndarray:
    """Which pairs of rows share a filter before this one."""
    earlier = [f[f < now] for f in filters]
    owner = np.repeat(np.arange(len(filters)), [len(f) for f in earlier])
    _, column = np.unique(np.concatenate(earlier), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(filters), len(filters)), np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, (a, a + width))
        block = np.zeros((len(filters), width), np.float32)
        block[owner[x:y], column[x:y] - a] = 1
        shared += block @ block.T
    return shared > 0


def near(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Two vectors of one label link when their cosine, in double precision, is at least ``cosine``.  Candidates share a
    filter; every pair that shares one is judged, so no link below the threshold is made.  Equal vectors of a label
    form one class whose copies link with each other and are counted, not paired.  A bucket is compared in blocks of
    about BLOCK classes, so a bucket of any size is spread over tasks.  Of a block, only each class's number of links
    and spanning edges leave the task: a pair is counted in the first filter that its vectors share.

    A null label, a null, empty or zero vector, or one with null or non-finite components links with nothing; so do
    vectors of different lengths with each other.  A null vec_id gives a row without links.  Rows that repeat a vec_id
    each give a row; they are one node with the links of all.  Other columns are ignored.  No rows: no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    kind = F.concat_ws(":", F.size("v").cast("string"), F.to_json(F.struct("label")))
    rows = rows.withColumn("kind", F.when(usable, kind))
    rows = rows.withColumn("class", F.when(usable, F.sha2(F.concat("kind", F.lit("|"), F.array_join(F.col("v").cast("array<string>"), ",")), 256)))
    named = stored(rows.select("vec_id", "class"), "vectors")
    classes = rows.where(usable).groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"), F.any_value("kind").alias("kind")
    )
    classes = stored(classes, "classes")
    n = classes.count()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for b in batches:
            lengths = np.diff(b.column("v").offsets.to_numpy())
            flat = b.column("v").flatten().to_numpy()
            begin = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                if dim not in codes:
                    codes[dim] = Code(dim, n)
                here = np.flatnonzero(lengths == dim)
                for a in range(0, len(here), 512):
                    some = here[a : a + 512]
                    of, name = codes[dim].filters(_units(flat[begin[some][:, None] + np.arange(dim)]))
                    part = b.select(["kind", "rep"]).take(pa.array(some[of]))
                    yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array(name), part.column("rep")], ["kind", "filter", "rep"])

    inside = classes.select("kind", "rep", "v").mapInArrow(decode, "kind string, filter long, rep long")
    counts = inside.groupBy("kind", "filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    inside = inside.join(counts, ["kind", "filter"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    inside = inside.join(classes.select("rep", "copies", "v"), "rep")
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = inside.select("kind", "filter", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rep", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        seen: dict[int, np.ndarray] = {}  # filters of vectors that had a link

        def lists(rep: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
            if v.shape[1] not in codes:
                codes[v.shape[1]] = Code(v.shape[1], n)
            fresh = [i for i, x in enumerate(rep.tolist()) if x not in seen]
            if len(seen) + len(fresh) > KEPT:
                seen.clear()
                fresh = list(range(len(rep)))
            if fresh:
                seen.update(zip(rep[fresh].tolist(), codes[v.shape[1]].lists(v[fresh]), strict=True))
            return [seen[x] for x in rep.tolist()]

        for (_, now, x, y), group in blobs.keyed(batches, ["kind", "filter", "x", "y"]):
            if group.num_rows < 2:
                continue
            rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            v = _units(np.stack(group.column("v").to_numpy()))
            close = v @ v.T >= cosine
            np.fill_diagonal(close, False)
            if x != y:
                left = group.column("part").to_numpy() == x
                close &= left[:, None] != left[None, :]
            busy = np.flatnonzero(close.any(1))
            if not len(busy):
                continue
            rep, copies, close = rep[busy], copies[busy], close[np.ix_(busy, busy)]
            i, j = np.nonzero(close)
            node, low = lowest(i, j)
            close &= ~_met_before(lists(rep, v[busy]), now)
            others = close @ copies
            a, b = [rep, rep[node]], [rep, rep[low]]
            links = [others, np.zeros(len(node), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).astype(np.int64)) for z in (a, b, links)], ["a", "b", "n"])

    keys = ["kind", "filter", "x", "y"]
    dealt = inside.repartition(partitions(vectors), *keys).sortWithinPartitions(*keys)
    linked = stored(dealt.mapInArrow(compare, "a long, b long, n long"), "links")
    others = linked.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    parts = connected(linked.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    found = classes.select("class", "rep", "copies").join(others, "rep", "left").join(parts, "rep", "left")
    found = stored(
        found.select(
            F.col("class").alias("__class"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("component", "rep").alias("component"),
        ),
        "found",
    )
    forget(linked, classes)
    out = named.join(found, F.col("class") == F.col("__class"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

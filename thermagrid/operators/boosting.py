"""Second-order boosted regression trees in numpy, and their random search spread over Spark tasks.

A fit holds its rows as bins of a byte for each feature; what is grown level by level is one histogram for all open
nodes.  A search has many fits of bounded size, one for each draw and fold, and each is a task of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, and the penalty on the square of a leaf's value.
BINS, RIDGE = 64, 1.0


@dataclass(frozen=True)
class Params:
    """Number and depth of trees, step, shares of rows and columns that a tree sees, least gain of a split and least
    weight of a leaf."""

    trees: int = 100
    depth: int = 6
    step: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    gain: float = 0.0
    weight: float = 1.0


def draws(space: dict[str, tuple], n: int, seed: int = 42) -> list[Params]:
    """n parameter sets drawn from ranges (low, high): whole numbers below high, or any numbers between."""
    rng = np.random.default_rng(seed)
    return [
        Params(**{k: int(rng.integers(a, b)) if isinstance(a, int) and isinstance(b, int) else float(rng.uniform(a, b)) for k, (a, b) in space.items()})
        for _ in range(n)
    ]


class Boosted:
    """A sum of trees.  Nodes of all trees lie in four arrays; a leaf's children are itself."""

    def __init__(self, params: Params, edges: list[np.ndarray], base: float, trees: list[tuple[np.ndarray, ...]]):
        self.params, self.edges, self.base = params, edges, base
        sizes = np.cumsum([0, *(len(t[0]) for t in trees)])
        self.roots = sizes[:-1]
        if trees:
            self.feature, self.cut, self.value = (np.concatenate([t[k] for t in trees]) for k in (0, 1, 3))
            self.left = np.concatenate([t[2] + a for t, a in zip(trees, sizes, strict=False)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = _codes(x, self.edges)
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        step = max(1, (1 << 20) // len(self.roots))
        for a in range(0, len(x), step):
            part = codes[a : a + step]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.params.depth):
                inner = self.feature[node]
                right = part[row, np.maximum(inner, 0)] > self.cut[node]
                node = np.where(inner >= 0, self.left[node] + right, node)
            out[a : a + step] += self.value[node].sum(1)
        return out

    def pack(self) -> bytes:
        return pickle.dumps(self, protocol=5)


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8)


def _tree(codes: np.ndarray, g: np.ndarray, h: np.ndarray, p: Params, columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature or -1, cut, left child, value) of the nodes of one tree; right children follow left ones."""
    feature, cut, left, value = [-1], [0], [0], [0.0]
    rows, at, open_ = np.arange(len(g)), np.zeros(len(g), np.int64), [0]
    for level in range(p.depth + 1):
        n = len(open_)
        total_g, total_h = np.bincount(at, g[rows], n), np.bincount(at, h[rows], n)
        for k, node in enumerate(open_):
            value[node] = -p.step * total_g[k] / (total_h[k] + RIDGE)
        if level == p.depth:
            break
        best, where = np.full(n, 0.0), np.zeros((n, 2), np.int64)
        own = total_g**2 / (total_h + RIDGE)
        for j in columns.tolist():
            spot = at * BINS + codes[rows, j]
            lg, lh = (np.cumsum(np.bincount(spot, v[rows], n * BINS).reshape(n, BINS), 1) for v in (g, h))
            rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
            gain = 0.5 * (lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - own[:, None]) - p.gain
            gain[(lh < p.weight) | (rh < p.weight)] = -1
            most = gain.argmax(1)
            height = gain[np.arange(n), most]
            better = height > best + 1e-12
            best[better] = height[better]
            where[better] = np.stack([np.full(n, j), most], 1)[better]
        split = best > 0
        if not split.any():
            break
        following, child = [], np.zeros(n, np.int64)
        for k in np.flatnonzero(split).tolist():
            node = open_[k]
            feature[node], cut[node], left[node] = int(where[k, 0]), int(where[k, 1]), len(feature)
            child[k] = len(following)
            following += [len(feature), len(feature) + 1]
            for column, v in ((feature, -1), (cut, 0), (left, 0), (value, 0.0)):
                column += [v, v]
        stay = split[at]
        rows, at = rows[stay], at[stay]
        at = child[at] + (codes[rows, where[at, 0]] > where[at, 1])
        open_ = following
    return np.array(feature), np.array(cut), np.array(left), np.array(value)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, params: Params = Params(), seed: int = 42) -> Boosted:
    """Trees for rows of x without missing values, by weighted squared error."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(y)) if w is None else w
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = _codes(x, edges)
    base = float(np.average(y, weights=w)) if w.sum() > 0 else float(y.mean())
    at, trees = np.full(len(y), base), []
    use = max(1, round(params.columns * x.shape[1]))
    for _ in range(params.trees):
        some = np.flatnonzero(rng.random(len(y)) < params.rows) if params.rows < 1 else np.arange(len(y))
        columns = np.sort(rng.permutation(x.shape[1])[:use])
        tree = _tree(codes[some], (w * (at - y))[some], w[some], params, columns)
        trees.append(tree)
        node = np.zeros(len(y), np.int64)
        for _ in range(params.depth):
            inner = tree[0][node]
            right = codes[np.arange(len(y)), np.maximum(inner, 0)] > tree[1][node]
            node = np.where(inner >= 0, tree[2][node] + right, node)
        at = at + tree[3][node]
    return Boosted(params, edges, base, trees)


def score(y: np.ndarray, p: np.ndarray, metric: str) -> float:
    """Larger is better: r2, or the negative rmse."""
    error = float(np.mean((y - p) ** 2))
    if metric == "rmse":
        return -(error**0.5)
    if metric != "r2":
        raise ValueError(f"metric {metric!r} is neither r2 nor rmse")
    spread = float(np.var(y))
    return 1 - error / spread if spread > 0 else 0.0


def searched(samples: DataFrame, features: list[str], label: str, weight: str | None, space: dict[str, tuple], tries: int, folds: int, metric: str, most: int) -> tuple[Boosted, list[tuple[Params, float]]]:
    """The best of ``tries`` draws by the mean score over ``folds`` folds, fitted again to all rows, and every draw's score.

    samples has no missing values.  A fit has at most about ``most`` rows, chosen by a hash of their values, so that the
    same rows are chosen anywhere; scores are not weighted.  The rows are broadcast, and every (draw, fold) is a task."""
    spark = samples.sparkSession
    names = [*features, label, *([weight] if weight else [])]
    rows = samples.select(*[F.col(c).cast("double").alias(c) for c in names])
    share = min(1.0, most / max(1, rows.count()))
    place = F.pmod(F.xxhash64(*names), F.lit(1 << 30))
    held = rows.where(place < F.lit(int(share * (1 << 30)) + 1)).toPandas()
    held = held.sort_values(names, ignore_index=True).to_numpy(float)
    x, y = held[:, : len(features)], held[:, len(features)]
    w = held[:, -1] if weight else None
    fold = np.random.default_rng(42).permutation(len(y)) % folds
    params = draws(space, tries)
    shared = spark.sparkContext.broadcast((x, y, w, fold, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, w, fold, params = shared.value
        for b in batches:
            found = []
            for draw, out in zip(b.column("draw").to_pylist(), b.column("fold").to_pylist(), strict=True):
                train, test = fold != out, fold == out
                if not test.any() or not train.any():
                    found.append(0.0)
                    continue
                model = fit(x[train], y[train], None if w is None else w[train], params[draw])
                found.append(score(y[test], model.predict(x[test]), metric))
            yield pa.RecordBatch.from_arrays([b.column("draw"), pa.array(found)], ["draw", "score"])

    jobs = spark.range(tries * folds).select("id", F.expr(f"cast(id div {folds} as int)").alias("draw"), F.expr(f"cast(id % {folds} as int)").alias("fold"))
    # a few fits for each core, each with the fixed memory of one
    wide = min(tries * folds, 4 * spark.sparkContext.defaultParallelism)
    jobs = jobs.repartitionById(wide, F.col("id").cast("int")).select("draw", "fold")
    means = jobs.mapInArrow(run, "draw int, score double").groupBy("draw").agg(F.avg("score").alias("score")).collect()  # one row for each draw
    scores = sorted((r["draw"], r["score"]) for r in means)
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, w, _, params = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([fit(x, y, w, params[best]).pack()], pa.binary())], ["model"])

    model = spark.range(1).repartition(1).mapInArrow(again, "model binary").first()["model"]
    return pickle.loads(bytes(model)), [(params[k], s) for k, s in scores]


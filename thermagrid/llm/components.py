"""Connected components of an edge table, without the driver seeing an edge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Edges up to which one task settles them all, in some 100 MB; more take the distributed rounds.
SETTLED_EDGES = 1 << 20


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) of edges between integers."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if (new == up).all():
            return nodes, nodes[up]
        up = new


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not ends:
        return
    node, low = lowest(*(np.concatenate(x) for x in zip(*ends, strict=True)))
    rest = node != low
    yield pa.RecordBatch.from_arrays([pa.array(node[rest]), pa.array(low[rest])], ["node", "component"])


def _settled(edges: DataFrame) -> bool:
    """True when each node has one edge, to a node that has none."""
    high = edges.select(F.col("hi").alias("__hi")).distinct()
    row = edges.join(high, F.col("lo") == F.col("__hi"), "left").agg(
        F.count("__hi").alias("chained"), F.count(F.lit(1)).alias("n"), F.count_distinct("hi").alias("nodes")
    ).first()
    return row["chained"] == 0 and row["n"] == row["nodes"]


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) integer edges to (node, component): the smallest node reachable, for every node that isn't the smallest.

    Up to SETTLED_EDGES edges are settled by one task; more alternate the small-star and large-star steps of Kiveris et
    al. (2014), each a grouped minimum and a join, until every edge points at its component's smallest node.  Each round
    is written to the shared folder, and the one before it removed.  Loops and repeated edges do no harm; null ends are
    ignored.  The result is written: ``common.forget`` removes it."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = stored(now, "edges")
    if now.count() <= SETTLED_EDGES:
        done = stored(now.select("hi", "lo").repartition(1).mapInArrow(_settle, "node long, component long"), "components")
        forget(now)
        return done
    while not _settled(now):
        before = now
        least = now.groupBy("hi").agg(F.min("lo").alias("m"))
        others = now.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = least.select("hi", F.col("m").alias("lo")).union(others).distinct()
        up = small.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "__hi")
        large = small.join(up, F.col("lo") == F.col("__hi"), "left").select("hi", F.coalesce("up", "lo").alias("lo"))
        now = stored(large.distinct(), "edges")
        forget(before)
    done = stored(now.toDF("node", "component"), "components")
    forget(now)
    return done

"""Connected components: a local union-find and spanning edges for kernels, a distributed star contraction for edge tables, and one row of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import cut, join_small


class Forest:
    """Union-find over 0..n-1 on arrays; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) of values connect: from each value to the least of its component."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(values))
    forest.union(at[: len(a)], at[len(a) :])
    root = forest.roots()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return values[linked], values[root[linked]]


#: Edges of which one task finds the components at once; longer tables are contracted step by step.
AT_ONCE = 200_000


def _at_once(e: DataFrame) -> DataFrame:
    """components() of edges (u, v) that are few, in one task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([got.column(0).to_numpy(), got.column(1).to_numpy()]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.union(at[: got.num_rows], at[got.num_rows :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.roots()])], ["node", "root"])

    return e.repartition(1).mapInArrow(kernel, "node long, root long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node of its component. Ids are longs; null ends are ignored.

    Alternates large-star and small-star steps until the edges are stars. A step is one aggregation (combined before
    the shuffle) and one join on the node, so a hub's edges are never gathered in one task: the join streams them and
    adaptive execution splits a skewed side. Edges never reach the driver; only a count and a checksum do. Up to AT_ONCE
    edges are left to one task, with the same result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= AT_ONCE:
            return _at_once(e)
        if tuple(state) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # each end below u is tied to the least of them, and u itself too
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())


def keep_one(docs: DataFrame, named: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with one row of each root; named: a materialised (doc_id, h, root) per row, h the xxhash64 of its text."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    keeper = named.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("__vantage_id"), F.col("k.h").alias("__vantage_h"))
    # rows of one id and text are in one component, so id and text tell who stays; no join is on the component
    keeper = cut(keeper)
    rows = named.groupBy("doc_id", "h").agg(F.count("*").alias("times"))
    same = F.col("doc_id").eqNullSafe(F.col("__vantage_id")) & (F.col("h") == F.col("__vantage_h"))
    name = [F.col("doc_id").alias("__vantage_id"), F.col("h").alias("__vantage_h")]
    gone = rows.join(keeper, same, "left_anti").select(*name)
    again = rows.where("times > 1").join(keeper, same, "left_semi").select(*name)
    on = docs[doc_id].eqNullSafe(F.col("__vantage_id")) & (F.xxhash64(docs[text]) == F.col("__vantage_h"))
    kept = join_small(docs, cut(gone), on, "left_anti")
    again = cut(again)
    single = join_small(kept, again, on, "left_anti")
    return single.unionByName(join_small(kept, again, on, "left_semi").dropDuplicates([doc_id, text]))

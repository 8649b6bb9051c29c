"""Connected components by a distributed union-find.

Each task first joins the edges it holds, in memory bounded by `_HELD`, to stars.  Stars of no more
edges than that in all are joined by one task, as a round's tables would cost far more.  Of more, in
rounds, every node takes its smallest parent, its other parents become children of that one, and
it is moved to its parent's parent.  When a round changes nothing, each component is one star
around its smallest node.  Both joins of a round read written tables as they are, so Spark splits the
rows of a hub over tasks as it does in any skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import written

_HELD = 1_000_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n nodes' component, edges a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _labelled(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and the smallest of each one's component."""
    a = np.concatenate([x["a"].to_numpy() for x in held])
    b = np.concatenate([x["b"].to_numpy() for x in held])
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[roots(at[: len(a)], at[len(a) :], len(nodes))]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, root = _labelled(held)
        other = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(root[other])], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > _HELD:
            held = [star(held)]
            size = held[0].num_rows
            if size > _HELD // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield star(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _labelled(held)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b long); root is the smallest of its component."""
    now = written(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"), "components")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    state = mark(now)
    if state[0] <= _HELD:
        return now.coalesce(1).mapInArrow(_whole, "node long, root long")
    while True:
        # Here a > b throughout.
        parents = written(now.groupBy("a").agg(F.min("b").alias("b")), "components")
        up = parents.select("a", F.col("b").alias("m"))
        hooks = now.join(up, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        above = parents.select(F.col("a").alias("b"), F.col("b").alias("top"))
        moved = parents.join(above, "b", "left").select("a", F.coalesce("top", "b").alias("b"))
        now = written(hooks.unionByName(moved).distinct(), "components")
        if (seen := mark(now)) == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

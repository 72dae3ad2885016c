"""Connected components of a link table.

Links are contracted in tasks of about CHUNK of them: each becomes a link from a node
to the smallest one that its task can reach.  Where one task holds all that is left,
that is the answer.  Otherwise a round of alternating stars brings links of a node
together: the large star joins a node's larger neighbours to its smallest, the small
star the smaller ones, each by a minimum per node and a join; no neighbour list is
gathered, so a node with very many links costs rows, not memory.  Rounds grow with the
logarithm of a component's size, and every round is written to the shared folder.

Defined results: links of a node with itself and repeated links count for nothing;
nodes without a link are not returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit

#: Links that one task contracts, about.
CHUNK = 1 << 19

_LINKS = "a long, b long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        low = root.copy()
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := low[low], low):
            low = further
        if np.array_equal(low, root):
            return nodes, nodes[root]
        root = low


def _contract(links: DataFrame, tasks: int) -> DataFrame:
    """Links from each node to the smallest that its task can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if parts:
            node, root = roots(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            own = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[own], pa.int64()), pa.array(root[own], pa.int64())], names=["a", "b"])

    return links.select("a", "b").coalesce(tasks).mapInArrow(textkit.tidy(run), _LINKS)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links has b < a."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        # Links to larger neighbours only: (larger neighbour, smallest of node).
        up = links.select(F.col("b").alias("node"), F.col("a").alias("far"))
        moved = up.join(least.withColumnRenamed("a", "node"), "node").select(F.col("far").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    loose = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down = 1 AND up = 1)")
    return loose.limit(1).count() == 0


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node in links (a, b): the smallest node reachable."""
    now = links
    while True:
        tasks = -(-now.count() // chunk)
        if not tasks:
            break
        before, now = now, store.table(_contract(now, tasks), "components")
        if before is not links:
            store.drop(before)
        if tasks == 1 or _settled(now):
            break
        before, now = now, store.table(_star(_star(now, large=True), large=False), "components")
        store.drop(before)
    now = now.filter("a <> b")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

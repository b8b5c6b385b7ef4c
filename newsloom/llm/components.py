"""Connected components of a graph given as edges, by alternating star operations.

Each round links every node's larger neighbours to its smallest neighbour (large star), then its
smaller neighbours likewise (small star), until only stars are left; the number of rounds grows with
the logarithm of the nodes. Minima are aggregated before the shuffle and joined back, so a hub with
a third of all edges is neither one group nor one task's window; Spark splits such a join. Each
round is a written table, so a lost executor costs no more than a round; the one before is deleted.
Spark keeps a thread of the driver for each exchange of the last minute, so a round is one table and
one check, an aggregate without a join, after which the driver lets go of what the round has left.

Where a caller has many small graphs to solve one after another, `components_of_few` spares them these
rounds: edges whose counted number is bounded are joined in the driver, more go the way above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.llm.common import written
from newsloom.settings import discard, release


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """edges (a, b) with a > b. Large star looks at all neighbours, small star at the smaller ones."""
    if both_ways:
        directed = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = directed.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        linked = edges.join(least, edges["a"] == least["u"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return linked.where(F.col("a") != F.col("b"))


def _tangled(edges: DataFrame) -> DataFrame:
    """The nodes that keep edges (a, b) from being stars: those with two smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    edges has columns a and b of one ordered type; loops and rows with null are ignored.
    """
    named = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(named, "links")
    going = bool(now.take(1))
    while going:
        before, now = now, written(_star(_star(now, True), False).distinct(), "links")
        discard(before)
        # All stars: every node with a smaller neighbour has one, and that one has none.
        going = bool(_tangled(now).take(1))
        release(edges.sparkSession)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def smallest_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low, high = np.minimum(least[u], least[v]), np.maximum(least[u], least[v])
        apart = low < high
        if not apart.any():
            return nodes, nodes[least]
        np.minimum.at(least, high[apart], low[apart])
        while (further := least[least]).tobytes() != least.tobytes():
            least = further


def components_of_few(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """`components` of a written table of edges; at most `most` edges between whole numbers are joined in the driver."""
    kind = edges.schema["a"].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType)) or edges.count() > most:
        return written(components(edges), "labels")
    found = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
    node, component = smallest_linked(*(found.column(c).to_numpy() for c in ("a", "b")))
    table = pa.table({"node": node, "component": component})
    return edges.sparkSession.createDataFrame(table).select(F.col("node").cast(kind), F.col("component").cast(kind))

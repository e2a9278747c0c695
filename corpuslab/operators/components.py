"""Connected components over an edge table (alternating large-star and small-star contraction)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.joins import SMALL_BYTES, lookup
from corpuslab.session import Stage

MAX_ROUNDS = 60


def _stats(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges, an order-free digest of them, and the edges whose lower end is itself an upper end."""
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo") % 1000000007), F.lit(0))).first()
    return int(r[0]), int(r[1])


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node above u is tied to the smallest node around u instead of u."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(1).alias("one")).unionByName(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"), F.lit(0).alias("one"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.sum("one").alias("n")).filter("n > 0")
    least = least.select(F.col("u").alias("lo"), F.least("u", "m").alias("m"), "n")
    return lookup(edges, least, ["lo"], rows, "n").select("hi", F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node below u, and u, are tied to the smallest node below u."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = lookup(edges, least, ["hi"], rows, "n").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another one; ``component`` is the smallest node
    that can be reached. Nodes without an edge, self-loops and edges with a null end give no row. An empty edge
    table gives an empty result.

    Each round is two aggregations with map-side combine and two joins; a hub with a third of all edges is
    joined by broadcast of its single row (see ``lookup``). The edge table is written to the shared folder after
    each round. The number of rounds grows with the logarithm of the longest path."""
    spark = edges.sparkSession
    stage = Stage(spark, "components")
    a, b = F.col(src), F.col(dst)
    now = stage.put(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    state = _stats(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        big = stage.put(_large_star(now, state[0]), "large")
        nxt = stage.put(_small_star(big, state[0]), "small")
        stage.drop(big)
        new = _stats(nxt)
        stage.drop(now)
        now, done, state = nxt, new == state, new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def components_of_pairs(pairs: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``connected_components`` of a table that is cheap to read twice and whose ends are longs. Pairs of at most SMALL_BYTES, 16 bytes each, meet in one
    task, in which every node takes the least one around it until nothing changes: a round costs no job. More of them are contracted as there."""
    a, b = F.col(src), F.col(dst)
    edges = pairs.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(a.cast("long").alias("a"), b.cast("long").alias("b"))
    if 16 * edges.count() > SMALL_BYTES:
        return connected_components(pairs, src, dst)
    return edges.repartition(1).mapInArrow(_gathered, "node long, component long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        nodes, at = np.unique(np.concatenate([np.concatenate([p[k] for p in parts]) for k in (0, 1)]), return_inverse=True)
        a, b = np.split(at, 2)
        root = np.arange(len(nodes))
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])

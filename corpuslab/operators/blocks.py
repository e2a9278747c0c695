"""Search of a query set against all rows, block by block of queries.

A block of queries has a bounded size. It is collected, broadcast and meets every batch of the index where that lies, as one matrix
product; only the best value of each query in a batch moves on. The index is never shuffled, gathered or joined, so its size does
not matter; each block costs one scan of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.vocab import ranked
from corpuslab.session import Stage

_BUILT: dict[str, object] = {}
#: Rows of the index that meet a block at once.
ROWS = 1024


def best_of_blocks(queries: DataFrame, index: DataFrame, per_block: int, build: Callable, scores: Callable, exclude_self: bool) -> DataFrame:
    """``(q, best)``: the highest score of each query to any row of the index, null without one. ``queries`` and ``index`` have a long
    ``doc`` first, the former perhaps in several rows, and each its values. ``build`` makes a block, in the worker and once, of the columns of its
    queries, whose ``doc`` is replaced by a place; ``scores(block, columns)`` gives a matrix (index rows x queries)."""
    spark = queries.sparkSession
    stage = Stage(spark, "blocks")
    names = ranked(queries.select("doc").distinct(), [F.asc("doc")], "at").withColumn("at", F.col("at") - 1)
    q = stage.put(queries.join(names, "doc").withColumn("block", F.floor(F.col("at") / per_block)), "queries")
    n = q.agg(F.max("block")).first()[0]
    if n is None:
        return spark.createDataFrame([], "q long, best double")
    rows = index if n == 0 else stage.put(index, "index")
    found = []
    for b in range(n + 1):
        own = q.filter(F.col("block") == b).orderBy("at").toPandas()
        ids = own.drop_duplicates("at")["doc"].to_numpy(np.int64)
        place = own["at"].to_numpy(np.int64) - b * per_block
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, ids, place, {c: own[c].to_numpy() for c in own.columns if c not in ("doc", "at", "block")}))
        found.append(rows.mapInArrow(_meet(shared, build, scores, exclude_self), "q long, best double"))
    return reduce(DataFrame.unionByName, found).groupBy("q").agg(F.max("best").alias("best"))


def _meet(shared, build: Callable, scores: Callable, exclude_self: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, place, columns = shared.value
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = build(len(ids), place, columns)
        best = np.full(len(ids), -np.inf)
        order = np.argsort(ids, kind="stable")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                s = scores(_BUILT[key], part.columns[1:])
                if exclude_self:
                    doc = part.column(0).to_numpy(zero_copy_only=False)
                    k = np.minimum(np.searchsorted(ids[order], doc), len(ids) - 1)
                    own = np.flatnonzero(ids[order][k] == doc)
                    s[own, order[k[own]]] = -np.inf
                if len(s):
                    best = np.maximum(best, s.max(axis=0))
        hit = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(best[hit])], names=["q", "best"])

    return work

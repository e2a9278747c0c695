"""Cosine search over dense vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.blocks import best_of_blocks

#: Queries of one block.
BLOCK = 4096


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _matrix(n: int, place: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
    m = np.stack(list(columns["v"])).astype(float)
    out = np.empty((n, m.shape[1]))
    out[place] = m
    return _unit(out).T


def _products(block: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
    flat = columns[0].flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(len(columns[0]), -1)) @ block


def max_cosine(queries: DataFrame, index: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, best)``: the highest cosine of each query to any other index vector, all of one length. Null vectors are left out; a zero vector has
    cosine 0; a query without any other vector gives no row."""
    pick = lambda df: df.filter(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(vec).cast("array<double>").alias("v"))
    found = best_of_blocks(pick(queries).dropDuplicates(["doc"]), pick(index), BLOCK, _matrix, _products, True)
    return found.withColumnRenamed("q", key)

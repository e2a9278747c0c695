"""A Bloom filter of bounded size that lets a scan drop rows before they are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Never more than 2**27 bits, 16 MB; beyond about 10 million keys it passes more rows, which a join drops later.
MAX_BITS = 27
MIN_BITS = 16


def _place(col: Column, bits: int) -> Column:
    return F.xxhash64(col).bitwiseAND(F.lit((1 << bits) - 1))


def build(ids: DataFrame, col: str, count: int) -> tuple[np.ndarray, int]:
    """Bitmap of the hashes of a column and its number of bits; ``count`` says about how many ids there are. The
    bits are combined on the executors; what is collected is bounded by 2**MAX_BITS bits."""
    bits = min(MAX_BITS, max(MIN_BITS, (16 * max(count, 1)).bit_length()))
    h = ids.select(_place(F.col(col), bits).alias("h"))
    word = h.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    got = word.toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def place(col: Column, bits: int) -> Column:
    """The position to look up, computed in the scan."""
    return _place(col, bits)


def hit(bitmap: np.ndarray, position: np.ndarray) -> np.ndarray:
    p = position.astype(np.uint64)
    return (bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0

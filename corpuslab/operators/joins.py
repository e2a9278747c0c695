"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import Stage

#: A key is hot when it has more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 500


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: int, count_col: str, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, which is unique on ``keys`` and has in ``count_col`` how many rows of
    ``left`` bear the key. ``rows`` is the number of rows of ``left`` (or more). Keys with more than
    rows / HOT_SHARE rows are at most HOT_SHARE; they alone are broadcast, and their rows never move. All other
    rows take a shuffled join, in which no key is large. ``how``: inner or left."""
    floor = max(1000, rows // HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(count_col) > floor).drop(count_col))
    cold = right.filter(F.col(count_col) <= floor).drop(count_col)
    a = left.join(hot, keys, "inner")
    b = left.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return a.unionByName(b)


def salted(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, count_col: str, rows: int, by: Column) -> DataFrame:
    """Inner join of ``left`` with ``right``, in which a key may have any number of rows. ``counts`` has in ``count_col`` how many
    rows of ``left`` bear a key. Keys with more than rows / HOT_SHARE rows, at most HOT_SHARE, are parted by a hash of
    ``by``, a column of ``left``; the rows of ``right`` with such a key go to each part, twice HOT_SHARE parts at most together."""
    floor = max(1000, rows // HOT_SHARE)
    hot = F.broadcast(counts.filter(F.col(count_col) > floor).select(*keys, F.ceil(F.col(count_col) / floor).cast("int").alias("_parts")))
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [*keys, "_salt"]).drop("_salt")


#: A side may be broadcast up to this size, as text.
SMALL_BYTES = 16 << 20


def text_bytes(df: DataFrame) -> int:
    """Size of a table's values, written as text."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its values take at most ``limit`` bytes, written as text; otherwise as it is, for a shuffled
    join. It is written once, so that neither the measurement nor the join computes it again."""
    kept = Stage(df.sparkSession, "small").put(df)
    return F.broadcast(kept) if text_bytes(kept) <= limit else kept


def attach(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, how: str = "inner", limit: int = SMALL_BYTES) -> DataFrame:
    """Join with a dictionary: ``right`` is unique on ``keys`` and has in ``count_col`` how often a key stands in ``left``, or in what
    ``left`` resembles. A dictionary of at most ``limit`` bytes is broadcast, a larger one joined by ``lookup``, so that frequent keys
    are split."""
    kept = Stage(right.sparkSession, "dictionary").put(right)
    if text_bytes(kept) <= limit:
        return left.join(F.broadcast(kept.drop(count_col)), keys, how)
    return lookup(left, kept, keys, kept.agg(F.sum(count_col)).first()[0] or 0, count_col, how)

"""Exact random selection of a given number of rows per group, without sorting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.joins import lookup
from corpuslab.session import Stage

BUCKETS = 4096


def uniform_hash(cols: list[str], seed: int) -> Column:
    """A fixed pseudo-random long of the columns."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def take_quota(rows: DataFrame, quotas: DataFrame, group: list[str], key: list[str], seed: int, buckets: int = BUCKETS, counted: str | None = None, stage: Stage | None = None) -> DataFrame:
    """Of each group, ``quotas.take`` rows in the order of a hash of ``key`` (all of them if it has fewer). ``quotas`` has
    one row per group, ``group`` columns (not null) and ``take``. It must be small, unless its column ``counted`` has the number of
    rows of each group: then it may be of any size (see ``lookup``). ``key`` must be unique within a group. With a ``stage`` the hashed rows
    and the buckets where quotas end are written there: each ``lookup`` reads its left side twice, and a plan that repeats itself in each of
    several joins takes much of the driver's memory.

    The hash range is cut into buckets; a histogram of (group, bucket), aggregated map-side, tells in which
    bucket the quota ends. Rows of earlier buckets pass without a sort, only that one bucket, 1/4096 of a group,
    is ranked. So a group with any share of the rows is never gathered in one task."""
    quotas = quotas.filter("take > 0").select(*group, "take", (F.col(counted) if counted else F.lit(0)).alias("_of"))
    total = (quotas.agg(F.coalesce(F.sum("_of"), F.lit(0))).first()[0]) if counted else 0

    def meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return lookup(left, right, group, total, "_of", how) if counted else left.join(F.broadcast(right.drop("_of")), group, how)

    hashed = meet(rows, quotas).withColumn("_h", uniform_hash(key, seed)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    if stage:
        hashed = stage.put(hashed, "hashed")
    w = Window.partitionBy(*group).orderBy("_b")
    hist = hashed.groupBy(*group, "_b", "take").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(w)).withColumn("_of", F.sum("_n").over(Window.partitionBy(*group)))
    edge = hist.filter((F.col("_upto") - F.col("_n") < F.col("take")) & (F.col("_upto") >= F.col("take")))
    edge = edge.select(*group, "_of", F.col("_b").alias("_eb"), (F.col("take") - F.col("_upto") + F.col("_n")).alias("_left"))
    both = meet(hashed, stage.put(edge, "edge") if stage else edge, "left")
    before = both.filter(F.col("_eb").isNull() | (F.col("_b") < F.col("_eb")))
    at = both.filter(F.col("_b") == F.col("_eb"))
    ranked = at.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_h", *key))).filter("_r <= _left")
    keep = [c for c in rows.columns]
    return before.select(*keep).unionByName(ranked.select(*keep))

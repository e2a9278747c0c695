"""Two models' predictions side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUPS = ("both_right", "a_only_right", "b_only_right", "both_wrong")


def align(a: DataFrame, b: DataFrame, key: str = "test_idx") -> DataFrame:
    """``(key, y_true, a_pred, b_pred)`` of the keys that both have."""
    x = a.select(key, "y_true", F.col("y_pred").alias("a_pred"))
    y = b.select(key, F.col("y_true").alias("b_true"), F.col("y_pred").alias("b_pred"))
    return x.join(y, key)


def alignment_checks(a: DataFrame, b: DataFrame, key: str = "test_idx") -> DataFrame:
    """``(check, violations)``: keys of one side alone, and keys with different truths."""
    x = a.select(key, F.col("y_true").alias("ta"), F.lit(1).alias("in_a"))
    y = b.select(key, F.col("y_true").alias("tb"), F.lit(1).alias("in_b"))
    j = x.join(y, key, "full_outer").agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("ta").eqNullSafe(F.col("tb"))).alias("truth_differs")
    )
    return j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in ("only_a", "only_b", "truth_differs")])).alias("x")).select("x.*")


def grouped(aligned: DataFrame) -> DataFrame:
    a, b = F.col("a_pred") == F.col("y_true"), F.col("b_pred") == F.col("y_true")
    return aligned.withColumn("grp", F.when(a & b, GROUPS[0]).when(a, GROUPS[1]).when(b, GROUPS[2]).otherwise(GROUPS[3]))


def group_counts(g: DataFrame) -> DataFrame:
    n = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def first_examples(g: DataFrame, key: str, k: int) -> DataFrame:
    """The k smallest keys of each group. Each of 64 parts of a group keeps k before the rest is ranked."""
    part = Window.partitionBy("grp", "_p").orderBy(key)
    near = g.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_p", "_r")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(key))).filter(F.col("rank") <= k)


def confusion_pair_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Off-diagonal cells of two models' predictions (frames with y_true, y_pred): counts and how many fewer the second has."""
    n = lambda d, c: d.filter("y_true <> y_pred").groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias(c))
    j = n(a, "a_n").join(n(b, "b_n"), ["y_true", "y_pred"], "full_outer")
    j = j.select("y_true", "y_pred", F.coalesce("a_n", F.lit(0)).alias("a_n"), F.coalesce("b_n", F.lit(0)).alias("b_n"))
    return j.withColumn("reduction", F.col("a_n") - F.col("b_n"))

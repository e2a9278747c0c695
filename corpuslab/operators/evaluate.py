"""Classification metrics from predictions. Classes are integers 0..k-1; ``by`` are the columns that part runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order`` (then by the other columns). Combines map-side, so a hot key moves as one row
    per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    s = F.struct(*[F.col(c) for c in order + rest])
    return df.groupBy(*keys).agg(F.max(s).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in order + rest])


def check_labels(df: DataFrame, k: int, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """``(check, violations)``: empty input, nulls and classes outside 0..k-1."""
    bad = lambda c: F.count_if((F.col(c) < 0) | (F.col(c) >= k))
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(true).isNull()).alias("tn"), F.count_if(F.col(pred).isNull()).alias("pn"), bad(true).alias("to"), bad(pred).alias("po"))
    cells = [("empty", (F.col("n") == 0).cast("long")), ("null_true", F.col("tn")), ("null_pred", F.col("pn")), ("true_out_of_range", F.col("to")), ("pred_out_of_range", F.col("po"))]
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("violations")) for n, c in cells])).alias("x")).select("x.*")


def confusion(df: DataFrame, by: list[str], k: int, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """``(by, y_true, y_pred, n)``: all k * k cells of each run, with zeros."""
    n = df.groupBy(*by, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    ids = F.sequence(F.lit(0), F.lit(k - 1))
    cells = n.select(*by).distinct().select(*by, F.explode(ids).alias("y_true")).select(*by, "y_true", F.explode(ids).alias("y_pred"))
    return cells.join(n, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(cm: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of each class; ``present`` if it occurs at all."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    side = cm.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("c"), F.lit(1).alias("t"), "n", hit.alias("h")), F.struct(F.col("y_pred").alias("c"), F.lit(0).alias("t"), "n", F.lit(0).alias("h")))).alias("x")).select(*by, "x.*")
    s = side.groupBy(*by, F.col("c").alias("class_id")).agg(
        F.sum(F.col("n") * F.col("t")).alias("support"), F.sum(F.col("n") * (1 - F.col("t"))).alias("predicted"), F.sum("h").alias("tp")
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumn("precision", zero(F.col("tp"), F.col("predicted"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    s = s.withColumn("f1", zero(2.0 * F.col("tp"), F.col("support") + F.col("predicted")))
    return s.withColumn("present", (F.col("support") + F.col("predicted")) > 0)


def macro(classes: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and macro scores over the classes that occur, and macro-F1 over all classes."""
    some = lambda c: F.coalesce(F.avg(F.when(F.col("present"), F.col(c))), F.lit(0.0))
    aggs = [
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        some("f1").alias("macro_f1"),
        some("precision").alias("macro_precision"),
        some("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1_all"),
        F.sum("support").alias("n"),
    ]
    return classes.groupBy(*by).agg(*aggs) if by else classes.agg(*aggs)


def batch_macro_f1(df: DataFrame, by: list[str], key: str, size: int, k: int) -> DataFrame:
    """Mean of the macro-F1 of batches of ``size`` ids, which is not the macro-F1 of the whole."""
    b = df.withColumn("_batch", F.floor(F.col(key) / size))
    per = macro(per_class(confusion(b, [*by, "_batch"], k), [*by, "_batch"]), [*by, "_batch"])
    return per.groupBy(*by).agg(F.avg("macro_f1").alias("batch_macro_f1"), F.count(F.lit(1)).alias("batches"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_class) of each class."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return n.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def seed_statistics(df: DataFrame, by: list[str], value: str, ddof: int = 1) -> DataFrame:
    """Mean, deviation (null for one value and ddof 1), number, and spread of the values that are numbers."""
    v = F.when(~F.isnan(value), F.col(value))
    std = F.stddev_samp(v) if ddof == 1 else F.stddev_pop(v)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), std.alias("std"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("spread"))

"""Training histories: rows (run, epoch, metric, learning rate)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(df: DataFrame) -> DataFrame:
    """One row per run and epoch: repeated rows fall together, a value beats a null."""
    rest = [c for c in df.columns if c not in ("run", "epoch")]
    return df.groupBy("run", "epoch").agg(*[F.max(c).alias(c) for c in rest])


def best_epoch(df: DataFrame, metric: str = "val_macro_f1") -> DataFrame:
    """``(run, best_epoch, best)``: the first epoch with the highest value."""
    s = F.max(F.struct(F.col(metric).alias("v"), (-F.col("epoch")).alias("e")))
    return df.filter(F.col(metric).isNotNull()).groupBy("run").agg(s.alias("s")).select("run", (-F.col("s.e")).alias("best_epoch"), F.col("s.v").alias("best"))


def lr_reductions(df: DataFrame) -> DataFrame:
    """``(run, epoch, before, after)`` where the learning rate fell."""
    w = Window.partitionBy("run").orderBy("epoch")
    return df.withColumn("before", F.lag("learning_rate").over(w)).filter("learning_rate < before").select("run", "epoch", "before", F.col("learning_rate").alias("after"))


def since_best(df: DataFrame, metric: str = "val_macro_f1") -> DataFrame:
    """``(run, epoch, waited)``: epochs since the value last exceeded all before it; null values don't."""
    w = Window.partitionBy("run").orderBy("epoch")
    up = df.withColumn("prior", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    up = up.withColumn("at", F.when(F.col(metric).isNotNull() & (F.col("prior").isNull() | (F.col(metric) > F.col("prior"))), F.col("epoch")))
    return up.select("run", "epoch", (F.col("epoch") - F.coalesce(F.max("at").over(w), F.lit(0))).alias("waited"))


def early_stop(df: DataFrame, patience: int, metric: str = "val_macro_f1") -> DataFrame:
    """``(run, stop_epoch)``: the first epoch that is ``patience`` epochs past the best so far."""
    return since_best(df, metric).filter(F.col("waited") >= patience).groupBy("run").agg(F.min("epoch").alias("stop_epoch"))


def plateau(df: DataFrame, patience: int = 2, factor: float = 0.5, min_lr: float = 1e-6, metric: str = "val_macro_f1") -> DataFrame:
    """``(run, epoch, lr)``: the learning rate that a plateau schedule sets after each epoch. The wait starts anew with each
    reduction, so an epoch depends on all before it: runs, which are short, are walked through one by one."""

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("epoch")
        best, wait, out = float("-inf"), 0, []
        lr = float(f["learning_rate"].iloc[0])
        for v in f[metric]:
            if pd.notna(v) and v > best:
                best, wait = v, 0
            else:
                wait += 1
                if wait >= patience:
                    lr, wait = max(lr * factor, min_lr), 0
            out.append(lr)
        return pd.DataFrame({"run": f["run"], "epoch": f["epoch"], "lr": out})

    return df.groupBy("run").applyInPandas(walk, "run string, epoch int, lr double")

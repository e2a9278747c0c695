"""Group-aware stratified splits by folds, and the invariants of a split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.vocab import ranked
from corpuslab.session import Stage

SPLITS = ("train", "validation", "test")
TOLERANCE = 0.015


def folds_for(train: float, validation: float, test: float) -> tuple[int, int, int]:
    """Number of folds, and how many of them are validation and test; the ratios must be whole folds."""
    if not math.isclose(train + validation + test, 1.0):
        raise ValueError(f"split ratios must sum to 1, got {train + validation + test}")
    n = round(1 / min(validation, test))
    if not all(math.isclose(r * n, round(r * n), abs_tol=1e-9) for r in (train, validation, test)):
        raise ValueError(f"ratios {(train, validation, test)} are not whole folds of 1/{n}")
    return n, round(validation * n), round(test * n)


def group_split(rows: DataFrame, key: str, group: str, label: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``(key, group, split)``. Whole groups are dealt into folds, per dominant label from the largest group down (equal sizes
    by a hash of group and seed), so that each fold has its share of every label and of the large groups."""
    n, v, t = folds_for(*ratios)
    per = rows.groupBy(F.col(group).alias("g"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    lead = F.min(F.struct((-F.col("n")).alias("n"), F.coalesce("label", F.lit("")).alias("label")))
    dom = per.groupBy("g").agg(lead.alias("s"), F.sum("n").alias("size")).select("g", F.col("s.label").alias("label"), "size")
    dom = dom.withColumn("h", F.md5(F.concat(F.col("g").cast("string"), F.lit(f"-{seed}")).cast("binary")))
    r = ranked(dom, [F.asc("label"), F.desc("size"), F.asc("h")])
    start = r.groupBy("label").agg(F.min("rank").alias("lo"))
    fold = F.pmod(F.col("rank") - F.col("lo"), F.lit(n))
    name = F.when(fold < v, SPLITS[1]).when(fold < v + t, SPLITS[2]).otherwise(SPLITS[0])
    dealt = r.join(start, "label").select("g", name.alias("split"))
    return rows.select(key, F.col(group).alias("g")).join(dealt, "g").select(key, F.col("g").alias(group), "split")


def _crossing(df: DataFrame, what: Column) -> DataFrame:
    """How many distinct values stand in two given splits, for each pair, in one aggregation."""
    s = df.filter(what.isNotNull()).groupBy(what.alias("v")).agg(*[F.max((F.col("split") == x).cast("int")).alias(x) for x in SPLITS])
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    a = s.agg(*[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0)).alias(f"{x}_{y}") for x, y in pairs])
    return a.select(F.explode(F.array(*[F.struct(F.lit(f"{x}/{y}").alias("pair"), F.col(f"{x}_{y}").alias("shared")) for x, y in pairs])).alias("x")).select("x.*")


def leakage(df: DataFrame, text: str, group: str) -> DataFrame:
    """``(kind, pair, shared)``: texts and groups that stand in two splits. ``df`` has a column split."""
    t = _crossing(df, F.unhex(F.md5(F.col(text).cast("binary")))).withColumn("kind", F.lit("text"))
    return t.unionByName(_crossing(df, F.col(group)).withColumn("kind", F.lit("group")))


def class_deviation(df: DataFrame, label: str) -> DataFrame:
    """``(split, label, deviation)``: share of the label in the split less its share in all."""
    n = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    splits = n.groupBy("split").agg(F.sum("n").alias("sn"))
    labels = n.groupBy(label).agg(F.sum("n").alias("ln"))
    total = Window.partitionBy()
    every = F.array(*[F.lit(x) for x in SPLITS])
    grid = labels.withColumn("total", F.sum("ln").over(total)).withColumn("split", F.explode(every))
    j = grid.join(F.broadcast(splits), "split").join(n, ["split", label], "left")  # three splits
    return j.select("split", label, (F.coalesce("n", F.lit(0)) / F.col("sn") - F.col("ln") / F.col("total")).alias("deviation"))


def validate(assigned: DataFrame, base: DataFrame, key: str, text: str, group: str, label: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), tolerance: float = TOLERANCE) -> DataFrame:
    """``(check, violations)`` of every invariant. ``assigned``: (key, split); ``base``: all rows with text, group and label. Of a text
    only a digest is moved, and the rows with their splits are written once."""
    base = base.select(key, F.unhex(F.md5(F.col(text).cast("binary"))).alias(text), group, label)
    j = base.join(assigned.select(key, "split").withColumn("_in", F.lit(1)), key, "full_outer")
    rows = j.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("k"), F.count(F.coalesce(F.col(text), F.lit(""))).alias("b"), F.max(F.col(text).isNotNull() | F.col(label).isNotNull()).alias("base"))
    a = rows.agg(F.count_if(F.col("k") > 1).alias("row_in_several_splits"), F.count_if(F.col("k") == 0).alias("row_without_split"), F.count_if(~F.coalesce("base", F.lit(False))).alias("unknown_row"))
    counts = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in a.columns])).alias("x")).select("x.*")
    full = Stage(base.sparkSession, "checked").put(base.join(assigned.select(key, "split"), key))
    dup = full.groupBy(F.md5(F.col(text).cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit("duplicate_text").alias("check"), "violations")
    leak = leakage(full, text, group).select(F.concat(F.col("kind"), F.lit(" in "), F.col("pair")).alias("check"), F.col("shared").alias("violations"))
    want = F.create_map(*[F.lit(x) for kv in zip(SPLITS, ratios) for x in kv])
    size = full.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    ratio = size.agg(F.count_if(F.abs(F.col("share") - want[F.col("split")]) > tolerance).alias("violations")).select(F.lit("ratio").alias("check"), "violations")
    dev = class_deviation(full, label).agg(F.count_if(F.abs("deviation") > tolerance).alias("violations")).select(F.lit("class_share").alias("check"), "violations")
    return counts.unionByName(dup).unionByName(leak).unionByName(ratio).unionByName(dev)


def require_valid(checks: DataFrame) -> None:
    """Raise with every violated check."""
    bad = [f"{r.check}: {r.violations}" for r in checks.filter("violations > 0").orderBy("check").collect()]
    if bad:
        raise ValueError("; ".join(bad))

"""Audit queries over a text corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def class_summary(df: DataFrame, label: str) -> DataFrame:
    """Rows and percentage of each label."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls and distinct values. All columns are unpivoted and pre-aggregated in one pass."""
    names = df.columns
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])).alias("x")).select("x.*")
    per = long.groupBy("column", F.md5(F.col("v").cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("column").agg(F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("h").alias("distinct_values"))
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return out.withColumn("type", types[F.col("column")])


def rows_from(agg: DataFrame, name: str, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """One row of aggregates as one row per part."""
    cells = [F.struct(F.lit(k).alias(name), *[c.alias(a) for a, c in v.items()]) for k, v in parts.items()]
    return agg.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def length_summary(df: DataFrame, length: str, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """min, mean and sample deviation to one decimal, percentiles by linear interpolation cut to whole numbers, max."""
    a = df.agg(F.min(length).alias("min"), F.avg(length).alias("mean"), F.stddev_samp(length).alias("std"), F.percentile(length, F.array(*map(F.lit, points))).alias("p"), F.max(length).alias("max"))
    pts = [F.floor(F.col("p")[i]).cast("long").alias(f"p{int(q * 100)}") for i, q in enumerate(points)]
    return a.select(F.col("min").cast("long").alias("min"), F.round("mean", 1).alias("mean"), F.round("std", 1).alias("std"), *pts, F.col("max").cast("long").alias("max"))


def truncation_table(df: DataFrame, length: str, limits: list[int]) -> DataFrame:
    """For each limit the percentage of texts cut and of tokens kept, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(length).alias("t")]
    for m in limits:
        aggs += [F.count_if(F.col(length) > m).alias(f"c{m}"), F.sum(F.least(F.col(length), F.lit(m))).alias(f"k{m}")]
    a = df.agg(*aggs)
    cells = [
        F.struct(F.lit(m).alias("max_len"), F.round(100.0 * F.try_divide(f"c{m}", "n"), 1).alias("truncated_pct"), F.round(100.0 * F.try_divide(f"k{m}", "t"), 1).alias("tokens_kept_pct"))
        for m in limits
    ]
    return a.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def length_ecdf(df: DataFrame, length: str, grid: list[int]) -> DataFrame:
    """Share of texts of at most each length."""
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(length) <= g).alias(f"g{g}") for g in grid])
    return a.select(F.explode(F.array(*[F.struct(F.lit(g).alias("length"), F.round(F.try_divide(f"g{g}", "n"), 6).alias("share")) for g in grid])).alias("x")).select("x.*")


def artifact_counts(df: DataFrame, text: str, patterns: dict[str, str] = T.ARTIFACTS) -> DataFrame:
    """Texts that match each pattern; a null text matches none."""
    aggs = [F.count_if(F.coalesce(F.col(text).rlike(p), F.lit(False))).alias(f"a{i}") for i, p in enumerate(patterns.values())]
    a = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    return rows_from(a, "artifact", {k: {"docs": F.col(f"a{i}"), "pct": F.round(100.0 * F.try_divide(f"a{i}", "n"), 2)} for i, k in enumerate(patterns)})


def cue_precision(df: DataFrame, text: str, label: str, cues: dict[str, str] = T.CUES) -> DataFrame:
    """For each label's cue words the percentage of texts with them inside the label and elsewhere."""
    aggs = []
    for i, (k, p) in enumerate(cues.items()):
        hit, inside = F.lower(F.col(text)).rlike(p).cast("int"), F.col(label) == k
        aggs += [F.avg(F.when(inside, hit)).alias(f"i{i}"), F.avg(F.when(~inside, hit)).alias(f"o{i}")]
    return rows_from(df.agg(*aggs), "label", {k: {"in_class_pct": F.round(100 * F.col(f"i{i}"), 1), "elsewhere_pct": F.round(100 * F.col(f"o{i}"), 1)} for i, k in enumerate(cues)})


def top_word_share(text: Column) -> Column:
    """Share of the most frequent word between blanks, within the row."""
    w = F.array_sort(T.blank_words(text))
    # longest run in the sorted words
    step = F.aggregate(
        w,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["best"], F.when(x == s["last"], s["run"] + 1).otherwise(1)).alias("best")),
        lambda s: s["best"],
    )
    return F.try_divide(step, F.size(w))


def noise_counters(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    words = F.size(T.blank_words(t))
    tests = {
        "top_word_over_30pct": top_word_share(t) > 0.30,
        "uppercase_over_60pct": F.try_divide(F.regexp_count(t, F.lit("[A-Z]")), F.length(t)) > 0.60,
        "digits_over_20pct": F.try_divide(F.regexp_count(t, F.lit("[0-9]")), F.length(t)) > 0.20,
        "under_10_words": words < 10,
        "over_1000_words": words > 1000,
    }
    a = df.agg(*[F.count_if(v).alias(k) for k, v in tests.items()])
    return rows_from(a, "counter", {k: {"docs": F.col(k)} for k in tests})


def union_all(frames: list[DataFrame], key: str, names: list[str]) -> DataFrame:
    """Frames under one another, each with its name in ``key``."""
    return reduce(DataFrame.unionByName, [f.withColumn(key, F.lit(n)) for f, n in zip(frames, names)])

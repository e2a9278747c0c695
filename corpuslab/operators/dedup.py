"""Exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.joins import attach


def digest(c: Column) -> Column:
    """128 bits of a text; nulls are equal to one another."""
    return F.unhex(F.md5(F.coalesce(c, F.lit("\0null")).cast("binary")))


def first_keys(df: DataFrame, text: str, key: str) -> DataFrame:
    """The smallest ``key`` of each text, in one aggregation."""
    return df.groupBy(digest(F.col(text)).alias("_d")).agg(F.min(key).alias(key)).select(key)


def keep_first(df: DataFrame, text: str, key: str) -> DataFrame:
    """The row with the smallest ``key`` of each text. Digests are grouped with map-side combine and rows are kept by a
    semi-join on the unique key, so a text with a third of all rows gathers nowhere."""
    return df.join(first_keys(df, text, key), key, "left_semi")


def duplicate_groups(df: DataFrame, text: str) -> DataFrame:
    """``(text_md5, copies)`` of every text that occurs more than once."""
    return df.filter(F.col(text).isNotNull()).groupBy(F.md5(F.col(text).cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_flags(df: DataFrame, text: str, key: str) -> DataFrame:
    """``(key, copies, later)``: how many rows share the text, and whether the row is not the first of them."""
    g = df.groupBy(digest(F.col(text)).alias("_d")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("_first"))
    d = df.select(key, digest(F.col(text)).alias("_d"))
    return attach(d, g.withColumn("_n", F.col("copies")), ["_d"], "_n").select(key, "copies", (F.col(key) > F.col("_first")).alias("later"))


def label_conflicts(df: DataFrame, text: str, label: str) -> DataFrame:
    """``(text_md5, labels, rows)`` of texts that bear more than one label."""
    g = df.groupBy(F.md5(F.col(text).cast("binary")).alias("text_md5")).agg(F.count_distinct(label).alias("labels"), F.count(F.lit(1)).alias("rows"))
    return g.filter("labels > 1")

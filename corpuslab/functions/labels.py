"""Labels and their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import label_key
from corpuslab.operators.joins import small


def class_ids(df: DataFrame, label: str, labels: DataFrame, strict: bool = True) -> DataFrame:
    """``df`` with class_id by the label table (label, class_id), compared by ``label_key``. A label that the table lacks is an
    error when the row is computed, or null if not strict."""
    known = labels.filter("class_id is not null").select(label_key(F.col("label")).alias("_k"), "class_id")
    j = df.withColumn("_k", label_key(F.col(label))).join(small(known), "_k", "left").drop("_k")
    if not strict:
        return j
    fail = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))).cast("int")
    return j.withColumn("class_id", F.coalesce("class_id", fail))


def ranked_classes(scores):
    """Array of (class, score) with the highest score first, equal scores by class."""
    return F.array_sort(
        F.transform(scores, lambda s, i: F.struct(i.alias("class_id"), s.alias("score"))),
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["class_id"] < b["class_id"], -1).when(a["class_id"] > b["class_id"], 1).otherwise(0),
    )


def first_max(scores):
    """Position, from 0, of the first highest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

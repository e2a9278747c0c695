"""Run registry: keyed upserts, validation, comparison of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators.evaluate import latest, seed_statistics

# The order of the experiments, of which each one's predecessor is the one before it.
LADDER = ("M0", "M1", "M2", "M3", "M4", "M5", "M6", "D0")
# Seeds that an experiment needs.
REQUIRED_SEEDS = {"M0": 3, "M1": 1, "M2": 1, "M3": 1, "M4": 1, "D0": 3}
# Scores and columns of the registry's file.
METRICS = ("macro_f1", "accuracy", "macro_precision", "macro_recall")
REQUIRED_COLUMNS = ("experiment", "model", "seed", *METRICS, "best_epoch", "epochs_run", "train_time", "parameter_count", "checkpoint_path", "dataset_version")


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with their keys."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def newest(df: DataFrame, keys: tuple[str, ...] = ("experiment", "seed"), at: str = "logged_at") -> DataFrame:
    """The registry as it is after all its rows were upserted in the order of their time."""
    return latest(df, list(keys), [at])


def ladder(df: DataFrame) -> DataFrame:
    """``(experiment, ord, predecessor)``."""
    rows = [(e, i, LADDER[i - 1] if i else None) for i, e in enumerate(LADDER)]
    return df.sparkSession.createDataFrame(rows, "experiment string, ord int, predecessor string")


def validate(df: DataFrame) -> DataFrame:
    """``(experiment, seed, error)``: one row per violated rule. Nulls and NaN count as violations."""
    rules = [(F.col("experiment").isNull() | ~F.col("experiment").isin(*LADDER), "unknown experiment"), (F.col("seed").isNull(), "null seed")]
    for m in METRICS:
        rules.append((F.col(m).isNull() | F.isnan(m) | (F.col(m) < 0) | (F.col(m) > 1), f"{m} outside [0, 1]"))
    rules += [
        (F.col("best_epoch").isNull() | (F.col("best_epoch") < 1) | (F.col("best_epoch") > F.col("epochs_run")), "best_epoch outside the run"),
        (F.col("train_time").isNull() | F.isnan("train_time") | (F.col("train_time") < 0), "negative train_time"),
        (F.col("parameter_count").isNull() | (F.col("parameter_count") <= 0), "parameter_count not positive"),
        (F.col("checkpoint_path").isNull() | (F.trim("checkpoint_path") == ""), "no checkpoint_path"),
        (F.col("model").isNull(), "null model"),
    ]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))
    return df.select("experiment", "seed", F.explode(errors).alias("error"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("experiment", "seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def seed_completeness(df: DataFrame) -> DataFrame:
    """``(experiment, required, have, complete)``."""
    need = df.sparkSession.createDataFrame(list(REQUIRED_SEEDS.items()), "experiment string, required int")
    have = df.groupBy("experiment").agg(F.count_distinct("seed").alias("have"))
    j = need.join(have, "experiment", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return j.withColumn("complete", F.col("have") >= F.col("required"))


def parameter_consistency(df: DataFrame) -> DataFrame:
    """Experiments whose runs don't agree on the number of parameters."""
    return df.groupBy("experiment").agg(F.count_distinct("parameter_count").alias("counts")).filter("counts <> 1")


def deltas(df: DataFrame, baseline: str = "M0", skip_missing: bool = False, metric: str = "macro_f1") -> DataFrame:
    """``(experiment, ord, mean, vs_previous, vs_baseline)``, unrounded; null without the other. The previous experiment
    is the predecessor on the ladder, or with ``skip_missing`` the nearest one before that has runs."""
    m = seed_statistics(df, ["experiment"], metric).select("experiment", "mean", "std", "n", "spread")
    lad = F.broadcast(ladder(df))  # eight rows
    at = m.join(lad, "experiment")
    if skip_missing:
        at = at.withColumn("prev", F.lag("mean").over(Window.orderBy("ord")))  # at most eight rows
    else:
        at = at.join(m.select(F.col("experiment").alias("predecessor"), F.col("mean").alias("prev")), "predecessor", "left")
    base = F.max(F.when(F.col("experiment") == baseline, F.col("mean"))).over(Window.partitionBy())
    return at.select("experiment", "ord", "mean", "std", "n", "spread", (F.col("mean") - F.col("prev")).alias("vs_previous"), F.when(F.col("experiment") != baseline, F.col("mean") - base).alias("vs_baseline"))


def classify_delta(delta, spread):
    """A difference against the spread over seeds."""
    r = F.try_divide(F.abs(delta), spread)
    return F.when(delta.isNull() | spread.isNull(), None).when(r < 1.0, "within spread").when(r < 1.5, "borderline").otherwise("beyond spread")


def comparison(df: DataFrame, descriptions: dict[str, str] | None = None, metric: str = "macro_f1", second: str = "accuracy") -> DataFrame:
    """One formatted row per experiment, in ladder order. For a registry of validation scores name its metrics."""
    acc = seed_statistics(df, ["experiment"], second).select("experiment", F.col("mean").alias("am"), F.col("std").alias("as"))
    rest = df.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("runs"), F.min("best_epoch").alias("lo"), F.max("best_epoch").alias("hi"), F.avg("train_time").alias("tm"), F.stddev_samp("train_time").alias("ts"), F.min("parameter_count").alias("pc")
    )
    j = deltas(df, metric=metric).join(acc, "experiment").join(rest, "experiment")
    names = F.create_map(*[F.lit(x) for kv in (descriptions or {"": ""}).items() for x in kv])
    return j.select(
        "ord",
        F.col("experiment").alias("model"),
        F.coalesce(names[F.col("experiment")], F.lit("")).alias("configuration"),
        T.format_metric(F.col("mean"), F.col("std")).alias("macro_f1"),
        T.format_metric(F.col("am"), F.col("as")).alias("accuracy"),
        T.format_delta(F.col("vs_previous")).alias("vs_previous"),
        T.format_delta(F.col("vs_baseline")).alias("vs_baseline"),
        F.when(F.col("runs") > 1, F.concat_ws("–", F.col("lo").cast("string"), F.col("hi").cast("string"))).otherwise(F.col("lo").cast("string")).alias("best_epoch"),
        F.when(F.col("runs") > 1, F.format_string("%.0f ± %.0f", "tm", "ts")).otherwise(F.format_string("%.0f", "tm")).alias("time"),
        F.format_number("pc", 0).alias("parameters"),
    )


def traceability(df: DataFrame, dataset_version: str, checkpoints: DataFrame) -> DataFrame:
    """``(experiment, seed, error)``: runs of another dataset, without a checkpoint record, or chosen by another metric.
    ``checkpoints``: (experiment, seed, monitor_metric)."""
    c = checkpoints.select("experiment", "seed", F.col("monitor_metric"), F.lit(True).alias("there"))
    j = df.join(c, ["experiment", "seed"], "left")
    errors = F.array_compact(
        F.array(
            F.when(~F.col("dataset_version").eqNullSafe(F.lit(dataset_version)), F.lit("other dataset_version")),
            F.when(F.col("there").isNull(), F.lit("no checkpoint record")),
            F.when(F.col("there") & ~F.col("monitor_metric").eqNullSafe(F.lit("val_macro_f1")), F.lit("other monitor_metric")),
        )
    )
    return j.select("experiment", "seed", F.explode(errors).alias("error"))


def tracked_comparison(df: DataFrame, order: list[str] = [e for e in LADDER if e not in ("M5", "M6")], descriptions: dict[str, str] | None = None) -> DataFrame:
    """One formatted row per model of the second registry, by validation scores, in the given order. Differences are to the model before in
    that order and to the first, and bear a plus only above zero."""
    places = spark_map({m: i for i, m in enumerate(order)})
    v = df.withColumn("ord", places[F.col("model_name")]).filter("ord is not null")
    s = v.groupBy("ord", "model_name").agg(
        F.avg("best_val_macro_f1").alias("f"), F.stddev_samp("best_val_macro_f1").alias("fs"), F.avg("val_accuracy").alias("a"), F.stddev_samp("val_accuracy").alias("as"), F.count(F.lit(1)).alias("runs")
    )
    s = s.filter("f is not null")
    w = Window.orderBy("ord")  # one row per model
    s = s.withColumn("p", F.when(F.lag("ord").over(w) == F.col("ord") - 1, F.lag("f").over(w))).withColumn("b", F.max(F.when(F.col("ord") == 0, F.col("f"))).over(Window.partitionBy()))
    shown = lambda m, d: F.when(F.col(m).isNull(), "—").when(F.col("runs") > 1, F.concat(F.format_string("%.4f", m), F.lit(" ± "), F.format_string("%.4f", F.coalesce(d, F.lit(0.0))))).otherwise(F.format_string("%.4f", m))
    diff = lambda c: F.when((F.col("ord") == 0) | F.col(c).isNull(), "—").otherwise(F.concat(F.when(F.col("f") > F.col(c), "+").otherwise(""), F.format_string("%.4f", F.col("f") - F.col(c))))
    name = spark_map(descriptions or {"": ""})[F.col("model_name")]
    return s.select("ord", F.col("model_name").alias("model"), F.coalesce(name, F.lit("")).alias("configuration"), shown("f", F.col("fs")).alias("macro_f1"), shown("a", F.col("as")).alias("accuracy"), diff("p").alias("vs_previous"), diff("b").alias("vs_baseline"))


def spark_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def parameter_counts(weights: DataFrame) -> DataFrame:
    """``(trainable, non_trainable, total)`` parameters of weights with a ``shape`` (array) and whether they are ``trainable``."""
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))
    one = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
    return weights.agg(one(F.col("trainable")).alias("trainable"), one(~F.col("trainable")).alias("non_trainable"), one(F.lit(True)).alias("total"))

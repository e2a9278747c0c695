"""Training callbacks as state per run: best value, learning-rate plateau and early stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslab.streaming.confusion import run_to_table
from corpuslab.streaming.sources import parquet_stream

OUT = "run string, epoch int, best double, waited int, lr double, stop boolean"
STATE = "best double, waited int, since int, lr double, last int"


def schedule(stream: DataFrame, patience: int = 2, stop_after: int = 3, factor: float = 0.5, min_lr: float = 1e-6) -> DataFrame:
    """One row per run and epoch. State is five numbers per run. An epoch that was already seen is skipped, so repeated rows
    don't count twice; epochs of one batch are taken in order, values before nulls."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, waited, since, lr, last = state.get if state.exists else (float("-inf"), 0, 0, float("nan"), 0)
        f = pd.concat(list(frames)).sort_values(["epoch", "val_macro_f1"], na_position="last")
        out = []
        for e, v, r in zip(f["epoch"], f["val_macro_f1"], f["learning_rate"]):
            if pd.isna(e) or e <= last:
                continue
            last = int(e)
            lr = r if pd.isna(lr) else lr
            if pd.notna(v) and v > best:
                best, waited, since = float(v), 0, 0
            else:
                waited, since = waited + 1, since + 1
                if since >= patience:
                    lr, since = max(lr * factor, min_lr), 0
            out.append((key[0], last, best, waited, lr, waited >= stop_after))
        state.update((best, waited, since, float(lr), last))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "waited", "lr", "stop"])

    return stream.groupBy("run").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def schedule_of_stream(spark: SparkSession, path: str) -> DataFrame:
    return run_to_table(schedule(parquet_stream(spark, path)), "append")

"""Writers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import runs


def write_corpus(df: DataFrame, parquet: str | None = None, csv: str | None = None) -> None:
    if parquet:
        df.write.mode("overwrite").parquet(parquet)
    if csv:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(csv)


def write_document(document: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_split(assigned: DataFrame, path: str) -> None:
    """``(row_id, split)``, one folder per split."""
    assigned.select("row_id", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("test_idx", "y_true", "y_pred").write.mode("overwrite").option("header", True).csv(path)


class Registry:
    """A table of runs with keyed upserts. Each version is a folder of its own, and a marker names the last complete one, so a
    reader never sees half a version and a failed write leaves the last one in place."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("experiment", "seed")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _fs(self, p: str):
        jp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return jp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jp

    def version(self) -> int:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return 0
        done = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(x[1:]) for x in done if x[:1] == "v" and fs.exists(self._fs(f"{self.path}/{x}/_SUCCESS")[1])), default=0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v else None

    def upsert(self, rows: DataFrame, validate: bool = False) -> DataFrame:
        """Put rows in place of those with their keys, and return the new version, with ``validate`` only if it is valid. Of rows with one
        key in one call the last logged counts."""
        old = self.read()
        new = runs.newest(rows, tuple(self.keys)).select(rows.columns) if "logged_at" in rows.columns else rows.dropDuplicates(self.keys)
        full = runs.upsert(old, new, self.keys) if old is not None else new
        target = f"{self.path}/v{self.version() + 1}"
        full.write.mode("overwrite").parquet(target)
        return self.validated() if validate else self.spark.read.parquet(target)

    def validated(self) -> DataFrame:
        """The registry, if its columns are complete and no rule is violated."""
        df = self.read()
        if df is None:
            raise FileNotFoundError(self.path)
        if missing := runs.missing_columns(df):
            raise ValueError(f"missing columns: {missing}")
        errors = [f"{r.experiment}/{r.seed}: {r.error}" for r in runs.validate(df).orderBy("experiment", "seed", "error").collect()]
        dup = [f"{r.experiment}/{r.seed}: {r.n} rows" for r in runs.duplicate_keys(df).collect()]
        if errors or dup:
            raise ValueError("; ".join(errors + dup))
        return df


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))

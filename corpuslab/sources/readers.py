"""Readers. Every reader takes a declared schema; none infers one."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpuslab import schemas
from corpuslab.operators.joins import small


def _exists(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    _exists(spark, path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, multiline: bool = True) -> DataFrame:
    """CSV with a header, quotes doubled within quotes, and line breaks within fields."""
    _exists(spark, path)
    return spark.read.schema(schema).option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"').csv(path)


def read_tracked_runs(spark: SparkSession, path: str) -> DataFrame:
    """The second registry, one row per run_id."""
    return read_csv(spark, path, schemas.TRACKED_RUNS)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint records, one JSON document per file."""
    return read_json(spark, path, schemas.CHECKPOINT)


def combine_csv(spark: SparkSession, folder: str, schema: StructType = schemas.RAW_COMPLAINTS) -> DataFrame:
    """All CSV files of a folder under one another, with ``row_id`` by file name and then place in the file. Within a file,
    which a multi-line reader can't divide, the place follows from the order in which its rows are read; only the
    number of rows per file is gathered."""
    files = read_csv(spark, folder, schema)
    placed = files.withColumn("_file", F.input_file_name()).withColumn("_m", F.monotonically_increasing_id())
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_lo"))
    off = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.withColumn("_off", off).select("_file", "_lo", "_off")
    return placed.join(small(before), "_file").withColumn("row_id", F.col("_off") + F.col("_m") - F.col("_lo")).select("row_id", *schema.fieldNames())


def read_any(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """By suffix: Parquet, CSV or JSON."""
    kind = Path(path).suffix.lower()
    if kind == ".parquet":
        return read_parquet(spark, path, schema)
    if kind == ".csv":
        if schema is None:
            raise ValueError("a CSV file needs a schema")
        return read_csv(spark, path, schema)
    if kind == ".json":
        return read_json(spark, path, schema)
    raise ValueError(f"unknown file type: {path}")


def read_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """One JSON document, or an array of them, per file."""
    _exists(spark, path)
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def load_document(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_counted(spark: SparkSession, path: str, rows: int, schema: StructType | None = None) -> DataFrame:
    """A table that must have so many rows."""
    df = read_parquet(spark, path, schema)
    if (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return df


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``: the first token of each line of a text file of vectors."""
    _exists(spark, path)
    return spark.read.schema(StructType([StructField("value", StringType())])).text(path).select(F.substring_index("value", " ", 1).alias("word")).distinct()


def read_vectors(spark: SparkSession, path: str, dim: int, words: DataFrame | None = None) -> DataFrame:
    """``(word, vec)`` of a text file of vectors, of the wanted words alone if given; lines of another length are an
    error when read."""
    _exists(spark, path)
    parts = spark.read.text(path).select(F.split("value", " ").alias("p")).select(F.col("p")[0].alias("word"), F.slice("p", 2, 1 << 20).alias("v"))
    if words is not None:
        parts = parts.join(small(words.select("word").distinct()), "word", "left_semi")
    checked = F.when(F.size("v") == dim, F.transform("v", lambda x: x.cast("float"))).otherwise(F.raise_error(F.concat(F.lit("wrong number of values: "), "word")).cast("array<float>"))
    return parts.select("word", checked.alias("vec"))


def read_file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of files of up to 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_history(spark: SparkSession, path: str, run: str) -> DataFrame:
    """A history document of equally long arrays as one row per epoch."""
    h = load_document(path)
    names = [c for c in ("val_macro_f1", "loss", "accuracy", "learning_rate") if c in h]
    n = {len(h[c]) for c in names}
    if len(n) != 1:
        raise ValueError(f"{path}: arrays of different lengths")
    rows = [(run, i + 1, *[float(h[c][i]) if c in h and h[c][i] is not None else None for c in ("val_macro_f1", "loss", "accuracy", "learning_rate")]) for i in range(n.pop())]
    return spark.createDataFrame(rows, schemas.EPOCHS)

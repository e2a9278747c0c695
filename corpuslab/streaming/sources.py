"""Tables as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over a Parquet table, which may be a folder or a single file."""
    schema = spark.read.parquet(path).schema
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hp).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if folder:
        return reader.parquet(path)
    where, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(where)

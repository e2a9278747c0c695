"""Content fingerprints of datasets and splits, and their verification."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(cols: list[str]):
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols]).cast("binary"), 256)


#: Parts of 32 bits that a digest is summed in.
PARTS = 8


def sums(h: Column) -> list[Column]:
    """Aggregates of hexadecimal SHA-256 digests: their number and the sum of each of their parts. They don't depend on order or
    partitioning, repeated digests count as often as they stand, and those of two tables add up to those of their union."""
    part = lambda i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    return [F.count(h).alias("_n"), *[F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(30,0)")).alias(f"_s{i}") for i in range(PARTS)]]


def of_sums() -> Column:
    """The digest of a multiset from its ``sums``."""
    return F.sha2(F.concat_ws(",", F.col("_n").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(PARTS)]).cast("binary"), 256)


def multiset_digests(df: DataFrame, h: Column, by: list[str]) -> DataFrame:
    """``(by, n, sha256)``: number and digest of the rows of each group, in one aggregation with map-side combine."""
    return df.groupBy(*by).agg(*sums(h)).select(*by, F.col("_n").alias("n"), of_sums().alias("sha256"))


def content_digest(df: DataFrame, cols: list[str]) -> str:
    """Digest of the rows as a multiset. Rows are hashed where they are; the driver gets one row."""
    return multiset_digests(df, row_digest(cols), []).first().sha256


def ordered_digest(df: DataFrame, id_col: str | None, cols: list[str], headers: list[str]) -> str:
    """SHA-256 over whole columns, one after the other: a header line, then each value and a line break, rows in the order
    of their id as text. This is the form of older manifests: it streams every value through the driver once per column, so it is only for
datasets of a size for that, to check such a manifest."""
    h = hashlib.sha256()
    order = F.col(f"`{id_col}`").cast("string") if id_col else None
    for name, head in zip(([id_col] if id_col else []) + cols, headers):
        h.update(f"{head}:{name}\n".encode())
        v = df.select(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")).alias("v"), *([order.alias("k")] if order is not None else []))
        for r in (v.orderBy("k") if order is not None else v).toLocalIterator():
            h.update((r.v + "\n").encode())
    return h.hexdigest()


def index_digest(ids: Iterator[int]) -> str:
    """SHA-256 of 64-bit little-endian integers in the given order, the form of older manifests."""
    h = hashlib.sha256()
    for i in ids:
        h.update(struct.pack("<q", i))
    return h.hexdigest()


def file_digest(path: str, chunk: int = 1 << 16) -> str:
    h = hashlib.sha256()
    with Path(path).open("rb") as f:
        while b := f.read(chunk):
            h.update(b)
    return h.hexdigest()


def dataset(df: DataFrame, text: str, label: str, cols: list[str]) -> DataFrame:
    """One row: rows, distinct and duplicate texts, null texts, labels and the content digest."""
    per = df.groupBy(F.md5(F.col(text).cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(
        F.sum("n").alias("rows"), F.count("h").alias("unique_texts"), (F.sum("n") - F.count("h")).alias("duplicate_texts"), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("null_texts")
    )
    labels = df.groupBy(label).agg(F.lit(1)).count()
    return a.withColumn("labels", F.lit(labels).cast("long")).withColumn("content_sha256", F.lit(content_digest(df, cols)))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def split(assigned: DataFrame, key: str, label: str, cols: list[str]) -> dict:
    """Sizes, class distributions and digests of each split of ``assigned`` (with a column split), and of the whole."""
    out: dict = {"dataset_content_sha256": content_digest(assigned, cols), "splits": {}}
    for r in assigned.groupBy("split", label).agg(F.count(F.lit(1)).alias("n")).collect():
        s = out["splits"].setdefault(r["split"], {"rows": 0, "classes": {}})
        s["rows"] += r["n"]
        s["classes"][r[label]] = r["n"]
    for r in multiset_digests(assigned, row_digest([key]), ["split"]).collect():
        out["splits"][r.split]["index_sha256"] = r.sha256
    for s in out["splits"].values():
        s["classes"] = dict(sorted(s["classes"].items(), key=lambda x: str(x[0])))
    return out


def verify(manifest: dict, current: dict, at: str = "") -> list[str]:
    """Where two fingerprints differ."""
    errors = []
    for k in sorted(set(manifest) | set(current)):
        a, b = manifest.get(k), current.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            errors += verify(a, b, f"{at}{k}.")
        elif a != b:
            errors.append(f"{at}{k}: {a!r} expected, {b!r} found")
    return errors


def save(manifest: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False))


def load(path: str) -> dict:
    return json.loads(Path(path).read_text())

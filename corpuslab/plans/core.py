"""Registry of the core queries, each with the SQL that checks it, and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators.dedup import first_keys, keep_first
from corpuslab.operators.joins import small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Complaints (c), the first row of each narrative (d), labels by key (l), labelled first rows (x), word lists (w).
VIEWS = r"""c as (select *, "Consumer complaint narrative" as text, trim(regexp_replace(lower("Product"), '[\s\p{Z}]+', ' ', 'g')) as pkey from combined_complaints),
d as (select * from c qualify row_number() over (partition by text order by row_id) = 1),
l as (select *, trim(regexp_replace(lower(label), '[\s\p{Z}]+', ' ', 'g')) as lkey from labels),
x as (select d.row_id, d.text, l.label, l.class_id, l.short_name from d join l on l.lkey = d.pkey where l.class_id is not null),
w as (select row_id, label, class_id, list_filter(string_split(translate(lower(text), '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 34)), ' '), lambda q: q <> '') as words from x)"""


#: The digest of a multiset of digests h (see ``operators.fingerprint``), in SQL.
MULTISET = "sha256(concat_ws(',', count(h)::varchar, " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::bigint)::varchar" for i in range(8)) + "))"


def query(sql: str | None = None, views: bool = True):
    """Register a query under its function's name, with its SQL over the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            s = sql.strip()
            SQL[f.__name__] = (f"with recursive {VIEWS}" + ("," if s.startswith(",") else "") + "\n" + s.lstrip(",")) if views else s
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "combined_complaints").withColumns({"text": F.col("Consumer complaint narrative"), "pkey": T.label_key(F.col("Product"))})


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, pkey) of the first row of each narrative."""
    return keep_first(complaints(spark, sf_dir).select("row_id", "text", "pkey"), "text", "row_id")


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id) of the first row of each narrative; no row is looked up."""
    return first_keys(complaints(spark, sf_dir).select("row_id", "text"), "text", "row_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, label, class_id, short_name) of first rows in one of the five classes."""
    names = table(spark, sf_dir, "labels").filter("class_id is not null").withColumn("pkey", T.label_key(F.col("label")))
    return first_rows(spark, sf_dir).join(small(names), "pkey").select("row_id", "text", "label", "class_id", "short_name")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, class_id, words) of labelled rows."""
    return labelled(spark, sf_dir).select("row_id", "label", "class_id", T.split_words(F.col("text")).alias("words"))


def _load() -> None:
    from corpuslab.plans import corpus, evaluation, registry, similarity, splitting, vocabulary  # noqa: F401


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)

"""TF-IDF postings, cosine similarity joins and near-duplicate clusters by cosine.

Postings are rows ``(doc, term, w)`` with weights normalised per document: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators import cosine
from corpuslab.operators.blocks import best_of_blocks
from corpuslab.operators.components import components_of_pairs
from corpuslab.operators.joins import attach
from corpuslab.operators.vocab import ranked
from corpuslab.session import Stage


def term_counts(docs: DataFrame, key: str, terms: str | Column) -> DataFrame:
    """``(doc, term, tf)``. Texts move to their document's place once, so that neither the counts nor what is later taken over a document
    shuffle its terms."""
    t = F.col(terms) if isinstance(terms, str) else terms
    return docs.repartition(key).select(F.col(key).alias("doc"), F.explode(t).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def fit(docs: DataFrame, terms: str | Column, n: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """``(term, df, idf)`` of the terms within the limits, of these the ``max_features`` that occur most. Each document is a row of ``docs``;
    its distinct terms are found within the row."""
    t = F.col(terms) if isinstance(terms, str) else terms
    df = docs.select(F.explode(F.array_distinct(t)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if max_features:
        tf = docs.select(F.explode(t).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_tf"))
        df = df.join(tf, "term").orderBy(F.desc("_tf"), "term").limit(max_features).drop("_tf")
    return _with_idf(df, n)


def fit_coded(groups: DataFrame, min_df: int = 1) -> DataFrame:
    """The model of ``fit`` from ``cosine.coded`` documents: what moves are the terms of groups, not of documents."""
    n = (groups.agg(F.sum(F.octet_length("docs"))).first()[0] or 0) // 8
    per = groups.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    return _with_idf(per.filter(F.col("df") >= min_df), n)


def _with_idf(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def weigh(counts: DataFrame, model: DataFrame) -> DataFrame:
    """Normalised postings of documents by a fitted model; unknown terms are dropped. Frequent terms are split (see ``attach``), and
    the norm is taken over a document's own terms."""
    raw = attach(counts, model.withColumn("_n", F.col("df")), ["term"], "_n").withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", "df", (F.col("w") / norm).alias("w"))


def similar_pairs(postings: DataFrame, threshold: float, epsilon: float | None = None, rare: int | None = None) -> DataFrame:
    """``(a, b, cos)`` of all pairs a < b with cosine of at least ``threshold``; exact (see ``cosine``). ``doc`` is a long. ``epsilon`` and ``rare``
    tuned a former join and change nothing."""
    return cosine.pairs(cosine.of_postings(postings), threshold)


def clusters(docs: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``(key, root)`` of every document: the smallest document of its cluster, itself if it is alone."""
    comp = components_of_pairs(pairs)
    return docs.select(key).join(comp, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("root"))


#: Size of a block of queries as a matrix, terms by queries.
BLOCK_BYTES = 64 << 20


def _columns_of(n: int, place: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
    term = columns["idx"].astype(np.int64)
    out = np.zeros((int(columns["size"][0]), n))
    out[term, place] = columns["w"]
    return out


def _dots(block: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
    ends = columns[0].offsets.to_numpy()
    term, w = columns[0].flatten().to_numpy().astype(np.int64), columns[1].flatten().to_numpy()
    ends = ends - ends[0]
    out = np.empty((len(ends) - 1, block.shape[1]))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i] = w[a:b] @ block[term[a:b]]
    return out


def max_similarity(queries: DataFrame, index: DataFrame, exclude_self: bool = False) -> DataFrame:
    """``(doc, best)``: the highest cosine of each query document to any (with ``exclude_self``: any other) index document, 0 without a
    common term. Both sides are postings of one model, whose ``df`` tells frequent terms. Queries go in blocks (see ``blocks``); of the
    index only the queries' terms are kept."""
    stage = Stage(queries.sparkSession, "search")
    q = stage.put(queries.select("doc", "term", "df", "w"), "queries")
    terms = stage.put(ranked(q.groupBy("term").agg(F.max("df").alias("n")), [F.asc("term")], "idx").select("term", "n", (F.col("idx") - 1).alias("idx")), "terms")
    size = terms.count()
    docs = attach(index.select("doc", "term", "w"), terms, ["term"], "n").groupBy("doc").agg(F.collect_list("idx").alias("i"), F.collect_list("w").alias("w"))
    mine = attach(q.drop("df"), terms, ["term"], "n").select("doc", "idx", "w", F.lit(size).alias("size"))
    best = best_of_blocks(mine, docs, max(1, BLOCK_BYTES // (8 * max(size, 1))), _columns_of, _dots, exclude_self)
    every = queries.select("doc").distinct().join(best.withColumnRenamed("q", "doc"), "doc", "left")
    return every.select("doc", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("best"))

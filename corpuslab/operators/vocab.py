"""Vocabularies, token sequences and coverage. Corpora are frames with an id and an array of words."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import split_words
from corpuslab.operators.joins import attach
from corpuslab.session import Stage


MAX_LABELS = 1000


def exploded(df: DataFrame, key: str, words: str) -> DataFrame:
    return df.select(key, F.posexplode(words).alias("pos", "word"))


def word_counts(df: DataFrame, key: str, words: str) -> DataFrame:
    """``(word, n, docs, first)``: occurrences, documents and the first place (id, position) of each word. Each document is
    reduced to its distinct words before the shuffle."""
    per = exploded(df, key, words).groupBy(key, "word").agg(F.count(F.lit(1)).alias("_k"), F.min("pos").alias("pos"))
    return per.groupBy("word").agg(F.sum("_k").alias("n"), F.count(F.lit(1)).alias("docs"), F.min(F.struct(F.col(key).alias("key"), "pos")).alias("first"))


def ranked(counts: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Rank over a whole vocabulary in a total order. The vocabulary is range-partitioned and sorted within partitions, and
    each partition's rows count on from the sizes of those before it, so no task sorts the whole of it. It is
    written once in between, because both steps must see the same partitions."""
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = counts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    part = Stage(spark, "ranked").put(part)
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_lo"))  # one row per partition
    before = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(before.select("_p", "_lo", "_off")), "_p").withColumn(name, F.col("_off") + F.col("_m") - F.col("_lo") + 1).drop("_p", "_m", "_lo", "_off")


def word_index(counts: DataFrame, oov: bool = True) -> DataFrame:
    """``(word, n, idx)``: by falling count and, among equals, first occurrence; 0 is reserved and 1 is the
    out-of-vocabulary token if there is one."""
    r = ranked(counts.select("word", "n", "first"), [F.desc("n"), F.asc("first")])
    return r.select("word", "n", (F.col("rank") + (1 if oov else 0)).cast("int").alias("idx"))


def to_sequences(df: DataFrame, key: str, words: str, index: DataFrame, cap: int | None = None, oov: bool = True) -> DataFrame:
    """``(key, seq)`` of every document, empty ones included. Words beyond the cap or unknown become 1, or are dropped
    without an out-of-vocabulary token."""
    known = index.filter(F.col("idx") < cap) if cap else index
    hit = attach(exploded(df, key, words), known.select("word", "idx", F.col("n") if "n" in known.columns else F.lit(1).alias("n")), ["word"], "n", "left")
    hit = hit.withColumn("idx", F.coalesce("idx", F.lit(1 if oov else None).cast("int"))).filter("idx is not null")
    seq = hit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_s")).select(key, F.transform("_s", lambda x: x["idx"]).alias("seq"))
    return df.select(key).join(seq, key, "left").select(key, F.coalesce("seq", F.array().cast("array<int>")).alias("seq"))


def oov_rate(df: DataFrame, key: str, words: str, index: DataFrame, cap: int | None = None) -> DataFrame:
    """``(tokens, unknown, rate)`` over all occurrences."""
    known = (index.filter(F.col("idx") < cap) if cap else index).select("word", F.lit(True).alias("known"))
    n = exploded(df, key, words).groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(known, "word", "left")
    a = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)), F.lit(0)).alias("unknown"))
    return a.withColumn("rate", F.round(F.try_divide("unknown", "tokens"), 6))


def coverage(counts: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """For the ``size`` most frequent words (0: all): the percentage of types and of their tokens that ``known`` has, and of
    the corpus that they make up."""
    top = ranked(counts.select("word", "n"), [F.desc("n"), F.asc("word")]).join(known.select("word").distinct().withColumn("hit", F.lit(1)), "word", "left")
    aggs = [F.sum("n").alias("corpus")]
    for s in sizes:
        inside = F.lit(True) if not s else F.col("rank") <= s
        aggs += [F.count_if(inside).alias(f"k{s}"), F.count_if(inside & F.col("hit").isNotNull()).alias(f"h{s}")]
        aggs += [F.sum(F.when(inside, F.col("n"))).alias(f"n{s}"), F.coalesce(F.sum(F.when(inside & F.col("hit").isNotNull(), F.col("n"))), F.lit(0)).alias(f"t{s}")]
    a = top.agg(*aggs)
    cells = [
        F.struct(
            F.lit(s).alias("size"),
            F.round(100.0 * F.try_divide(f"h{s}", f"k{s}"), 1).alias("type_pct"),
            F.round(100.0 * F.try_divide(f"t{s}", f"n{s}"), 2).alias("token_pct"),
            F.round(100.0 * F.try_divide(f"n{s}", "corpus"), 2).alias("corpus_pct"),
        )
        for s in sizes
    ]
    return a.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def missing_terms(counts: DataFrame, known: DataFrame, size: int, k: int) -> DataFrame:
    """Of the ``size`` most frequent words the ``k`` most frequent that ``known`` lacks."""
    top = counts.select("word", "n").orderBy(F.desc("n"), "word").limit(size)
    return top.join(known.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(k)


def embedding_rows(index: DataFrame, vectors: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """``(idx, word, vec, matched)``: the pretrained vector, or a fixed pseudo-random one within ±0.05 that depends on
    index, dimension and seed alone."""
    noise = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("idx"), i), F.lit(1 << 24)) / F.lit(float(1 << 24)) * 0.1 - 0.05).cast("float"))
    return index.join(vectors.select("word", "vec"), "word", "left").select("idx", "word", F.coalesce("vec", noise).alias("vec"), F.col("vec").isNotNull().alias("matched"))


def log_odds(counts: DataFrame, label: str, k: int) -> DataFrame:
    """``counts``: (label, word, n). The ``k`` words most over-represented in each label, by the log odds of counts plus one
    over totals plus one."""
    per = counts.groupBy("word").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("m"))  # one entry per label
    sums = counts.groupBy(label).agg(F.sum("n").alias("s")).limit(MAX_LABELS + 1).collect()
    if not sums:
        return counts.select(label, "word", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    if len(sums) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    grand = sum(r["s"] for r in sums)
    each = F.array(*[F.struct(F.lit(r[label]).alias(label), F.lit(r["s"]).alias("inside_sum")) for r in sums])
    pairs = per.select("word", "all", "m", F.explode(each).alias("x")).select("word", "all", "x.*", F.lit(grand).alias("grand"), F.coalesce(F.col("m")[F.col(f"x.{label}")], F.lit(0)).alias("n"))
    score = F.log((F.col("n") + 1) / (F.col("inside_sum") + 1)) - F.log((F.col("all") - F.col("n") + 1) / (F.col("grand") - F.col("inside_sum") + 1))
    scored = pairs.withColumn("score", F.round(score, 6))
    w = Window.partitionBy(label).orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(label, "word", "score", "rank")


class WordTokenizer:
    """A fitted vocabulary. ``fit`` sees the rows it is given and no others; capping happens on use, so the index stays whole."""

    def __init__(self, index: DataFrame, cap: int | None = None, oov: bool = True):
        self.index, self.cap, self.oov = index, cap, oov

    @classmethod
    def fit(cls, df: DataFrame, key: str, words: str, cap: int | None = None, oov: bool = True) -> WordTokenizer:
        return cls(word_index(word_counts(df, key, words), oov), cap, oov)

    def transform(self, df: DataFrame, key: str, words: str) -> DataFrame:
        return to_sequences(df, key, words, self.index, self.cap, self.oov)

    def save(self, path: str) -> None:
        meta = F.struct(F.lit(self.cap).cast("int").alias("cap"), F.lit(self.oov).alias("oov"))
        self.index.withColumn("meta", meta).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> WordTokenizer:
        df = spark.read.parquet(path)
        m = df.select("meta.*").first()
        return cls(df.drop("meta"), m.cap if m else None, m.oov if m else True)


class SequenceModel(Model):
    """A fitted tokenizer as a stage of a pipeline: adds ``outputCol`` with the indices of the words in ``inputCol``."""

    def __init__(self, tokenizer: WordTokenizer, key: str, input_col: str, output_col: str):
        super().__init__()
        self.tokenizer, self.key, self.input_col, self.output_col = tokenizer, key, input_col, output_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = dataset.select(self.key, split_words(F.col(self.input_col)).alias("_ws"))
        return dataset.join(self.tokenizer.transform(words, self.key, "_ws").withColumnRenamed("seq", self.output_col), self.key)


class SequenceEstimator(Estimator):
    """Learns the vocabulary of a text column. ``fit`` is refused on rows that are not all of the training split, if ``split_col`` is given."""

    def __init__(self, key: str, input_col: str, output_col: str, cap: int | None = None, oov: bool = True, split_col: str | None = None):
        super().__init__()
        self.key, self.input_col, self.output_col, self.cap, self.oov, self.split_col = key, input_col, output_col, cap, oov, split_col

    def _fit(self, dataset: DataFrame) -> SequenceModel:
        if self.split_col and not dataset.filter(~F.col(self.split_col).eqNullSafe(F.lit("train"))).isEmpty():
            raise ValueError("a vocabulary is learned from training rows alone")
        words = dataset.select(self.key, split_words(F.col(self.input_col)).alias("_ws"))
        return SequenceModel(WordTokenizer.fit(words, self.key, "_ws", self.cap, self.oov), self.key, self.input_col, self.output_col)

"""Text classifier of record: multinomial logistic regression over TF-IDF of words and word pairs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpuslab.functions import text as T
from corpuslab.functions.labels import ranked_classes
from corpuslab.operators import evaluate, tfidf
from corpuslab.operators.joins import attach
from corpuslab.operators.vocab import ranked
from corpuslab.session import Stage

#: Features of the classifier at most, by document frequency; its coefficients live on the driver.
MAX_FEATURES = 2_000_000


def features(text: Column, pairs: bool = True) -> Column:
    """Terms without accents and, with ``pairs``, pairs of neighbouring terms."""
    ts = T.terms(T.strip_accents(text))
    return F.concat(ts, T.bigrams(ts)) if pairs else ts


def _vectors(postings: DataFrame, index: DataFrame, docs: DataFrame, key: str, size: int) -> DataFrame:
    """``docs`` with sparse vectors. They are written in the form in which a vector is stored and read back as such, so no row
    passes through Python."""
    rows = attach(postings.select("doc", "term", "w"), index, ["term"], "df").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("s"))
    j = docs.join(rows, F.col(key) == F.col("doc"), "left").drop("doc").withColumn("s", F.coalesce("s", F.array().cast("array<struct<idx:int,w:double>>")))
    parts = (F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform("s", lambda x: x["idx"]).alias("indices"), F.transform("s", lambda x: x["w"]).alias("values"))
    stage = Stage(docs.sparkSession, "vectors")
    kept = stage.put(j.select(*docs.columns, F.struct(*parts).alias("features")))
    schema = StructType([f for f in kept.schema.fields if f.name != "features"] + [StructField("features", VectorUDT())])
    return docs.sparkSession.read.schema(schema).parquet(kept._stage_path)


@dataclass
class TextClassifier:
    vocabulary: DataFrame
    index: DataFrame
    size: int
    model: LogisticRegressionModel
    pairs: bool = True

    @property
    def iterations(self) -> int:
        """Iterations that the fit took."""
        return self.model.summary.totalIterations

    def vectors(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """Features of documents, by the vocabulary as it was fitted."""
        counts = tfidf.term_counts(docs.select(key, text), key, features(F.col(text), self.pairs))
        return _vectors(tfidf.weigh(counts, self.vocabulary), self.index, docs, key, self.size)

    def predict(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        return self.model.transform(self.vectors(docs, key, text)).select(key, F.col("prediction").cast("int").alias("y_pred"))

    def probabilities(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``(key, classes)``: class and probability, the likeliest first."""
        p = self.model.transform(self.vectors(docs, key, text)).select(key, vector_to_array("probability").alias("p"))
        return p.select(key, ranked_classes(F.col("p")).alias("classes"))

    def predict_text(self, spark: SparkSession, text: str) -> list[tuple[int, float]]:
        """Classes and probabilities of one text."""
        r = self.probabilities(spark.createDataFrame([(0, text)], "k long, t string"), "k", "t").first()
        return [(c.class_id, c.score) for c in r.classes]

    def top_features(self, spark: SparkSession, k: int) -> DataFrame:
        """``(class_id, rank, term, coef)``: the k largest coefficients of each class."""
        m = self.model.coefficientMatrix.toArray()
        best = [(int(c), r + 1, int(i), float(m[c, i])) for c in range(m.shape[0]) for r, i in enumerate(np.argsort(-m[c], kind="stable")[:k])]
        top = spark.createDataFrame(best, "class_id int, rank int, idx int, coef double")
        return self.index.drop("df").join(F.broadcast(top), "idx").select("class_id", "rank", "term", "coef")


def fit_text_classifier(train: DataFrame, key: str, text: str, label: str, min_df: int = 2, max_df: float = 0.95, c: float = 1.0, max_iter: int = 1000, pairs: bool = True, max_features: int | None = None) -> TextClassifier:
    """Vocabulary, weights and coefficients from the training rows alone. ``pairs``: pairs of terms are features as well; ``max_features``:
    the most frequent features alone. The fit ends at its tolerance or after ``max_iter`` iterations (``TextClassifier.iterations``)."""
    stage = Stage(train.sparkSession, "classifier")
    n = train.count()
    counts = tfidf.term_counts(train.select(key, text), key, features(F.col(text), pairs))
    vocabulary = stage.put(tfidf.fit(train, features(F.col(text), pairs), n, min_df, max_df, max_features), "vocabulary")
    size = vocabulary.count()
    if size > MAX_FEATURES:
        raise ValueError(f"{size} features; raise min_df")
    index = stage.put(ranked(vocabulary.select("term", "df"), [F.asc("term")]).select("term", "df", (F.col("rank") - 1).cast("int").alias("idx")), "index")
    x = _vectors(tfidf.weigh(counts, vocabulary), index, train.select(key, F.col(label).cast("double").alias("label")), key, size)
    lr = LogisticRegression(family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return TextClassifier(vocabulary, index, size, lr.fit(x), pairs)


#: The settings of the classifier in the audit, terms alone and a weaker penalty.
AUDIT = {"min_df": 3, "max_df": 1.0, "max_features": 60_000, "c": 4.0, "max_iter": 400, "pairs": False}


def result_record(fitted: TextClassifier, predictions: DataFrame, k: int, settings: dict, val_macro_f1: float | None = None, **facts: object) -> dict:
    """What is kept of a finished classifier: settings, size of its vocabulary, scores, classes and confusion matrix on ``predictions`` (y_true,
    y_pred), and given facts such as the dataset's digest or the runtime."""
    cm = Stage(predictions.sparkSession, "result").put(evaluate.confusion(predictions, [], k))
    cells, classes = cm.collect(), evaluate.per_class(cm, [])
    matrix = [[0] * k for _ in range(k)]
    for r in cells:
        matrix[r.y_true][r.y_pred] = r.n
    m = evaluate.macro(classes, []).first()
    per = {r.class_id: {c: r[c] for c in ("precision", "recall", "f1", "support")} for r in classes.orderBy("class_id").collect()}
    scores = {c: m[c] for c in ("macro_f1", "accuracy", "macro_precision", "macro_recall")}
    return {"settings": settings, "vocabulary_size": fitted.size, "iterations": fitted.iterations, **scores, "per_class": per, "confusion_matrix": matrix, "val_macro_f1": val_macro_f1, "created_at_utc": datetime.now(timezone.utc).isoformat(), **facts}


#: What the probe sees, by name.
PROBES = {"redaction only": ("redactions", "amounts", "dates", "density"), "length only": ("words",), "redaction + length": ("redactions", "amounts", "dates", "density", "words")}


def shape_probe(train: DataFrame, test: DataFrame, key: str, text: str, label: str, seed: int = 42, rounds: int = 20) -> DataFrame:
    """``(probe, key, y_true, y_pred)`` by boosted trees, one model a class, that see lengths and redactions only."""

    def shape(df: DataFrame) -> DataFrame:
        t = F.col(text)
        counts = {"words": F.size(T.blank_words(t)), "redactions": F.regexp_count(t, F.lit(T.ARTIFACTS["XXXX redaction"])), "amounts": F.regexp_count(t, F.lit(T.ARTIFACTS["{$...} amount"])), "dates": F.regexp_count(t, F.lit("XX/XX/"))}
        f = df.select(key, F.col(label).cast("double").alias("label"), *[v.cast("double").alias(k) for k, v in counts.items()])
        return f.withColumn("density", F.coalesce(F.try_divide("redactions", "words"), F.lit(0.0)))

    stage, out = Stage(train.sparkSession, "probe"), []
    seen, asked = stage.put(shape(train)), stage.put(shape(test))
    for name, cols in PROBES.items():
        pack = VectorAssembler(inputCols=list(cols), outputCol="features")
        fitted = OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=4, seed=seed)).fit(pack.transform(seen))
        got = fitted.transform(pack.transform(asked))
        out.append(got.select(F.lit(name).alias("probe"), key, F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")))
    return reduce(DataFrame.unionByName, out)

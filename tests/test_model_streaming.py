import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import model
from corpuslab.streaming import confusion, history


def test_classifier_learns_and_fits_on_train_only(spark):
    words = ["checking overdraft", "card interest", "collector debt", "transfer wire", "loan student"]
    rows = [(i, f"{words[i % 5]} case number {i}", i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, text string, class_id int")
    train, test = df.filter("row_id < 70"), df.filter("row_id >= 70")
    fitted = model.fit_text_classifier(train, "row_id", "text", "class_id", max_iter=20)
    assert fitted.vocabulary.filter("term = '99'").count() == 0
    got = fitted.predict(test.unionByName(spark.createDataFrame([(500, "", 0)], df.schema)), "row_id", "text")
    both = got.join(test, "row_id")
    assert got.count() == 31 and both.filter("y_pred = class_id").count() >= 28
    assert fitted.top_features(spark, 3).count() == 15


def test_stream_equals_batch(spark, tmp_path):
    rows = [("M0", 42, i, i % 5, (i * 3) % 5 if i % 7 else None) for i in range(83)]
    df = spark.createDataFrame(rows, "experiment string, seed int, test_idx long, y_true int, y_pred int")
    p = str(tmp_path / "p.parquet")
    df.repartition(6).write.parquet(p)
    got = {tuple(r) for r in confusion.confusion_of_stream(spark, p).collect()}
    assert got == {tuple(r) for r in confusion.confusion_counts(df).collect()}


def test_daily_counts_drop_late_rows(spark, tmp_path):
    p, seen = str(tmp_path / "d.parquet"), set()
    for i, at in enumerate(["2025-01-01 10:00:00", "2025-03-01 00:00:00", "2025-03-02 00:00:00", "2025-01-01 11:00:00"]):
        spark.createDataFrame([("M0", 1, i)], "experiment string, seed int, test_idx long").withColumn("logged_at", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(p)
        for f in set(Path(p).glob("*.parquet")) - seen:  # the stream takes files by age
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
            seen.add(f)
    from corpuslab.streaming.sources import parquet_stream

    out = confusion.run_to_table(confusion.daily_counts(parquet_stream(spark, p, 1)), "append").collect()
    assert [r.n for r in out] == [1]


def test_schedule_state(spark, tmp_path):
    f1 = [0.5, 0.6, 0.59, None, 0.58, 0.7]
    df = spark.createDataFrame([("r", i + 1, v, 0.001) for i, v in enumerate(f1)] + [("r", 2, 0.6, 0.001)], "run string, epoch int, val_macro_f1 double, learning_rate double")
    p = str(tmp_path / "h.parquet")
    df.coalesce(1).write.parquet(p)
    got = history.schedule_of_stream(spark, p).orderBy("epoch").collect()
    assert [r.epoch for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r.lr for r in got] == [0.001, 0.001, 0.001, 0.0005, 0.0005, 0.0005]
    assert [r.stop for r in got] == [False, False, False, False, True, False]


@pytest.mark.parametrize("master", ["yarn"])
def test_cluster_needs_a_shared_folder(master):
    from corpuslab import session

    class Conf:
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"
        applicationId = "x"

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Fake())


def test_result_record(spark):
    words = ["checking overdraft", "card interest", "collector debt", "transfer wire", "loan student"]
    df = spark.createDataFrame([(i, f"{words[i % 5]} case {i}", i % 5) for i in range(100)], "row_id long, text string, class_id int")
    fitted = model.fit_text_classifier(df, "row_id", "text", "class_id", **model.AUDIT | {"max_features": 12})
    assert fitted.size == 11 and fitted.vocabulary.filter("term like '% %'").count() == 0  # ten words, and the one they share
    p = fitted.predict(df, "row_id", "text").join(df.select("row_id", F.col("class_id").alias("y_true")), "row_id")
    r = model.result_record(fitted, p, 5, model.AUDIT, val_macro_f1=0.9, dataset_content_sha256="x")
    assert r["macro_f1"] == r["accuracy"] == 1.0 and r["confusion_matrix"] == [[20 * (i == j) for j in range(5)] for i in range(5)]
    assert r["per_class"][3]["support"] == 20 and r["vocabulary_size"] == 11 and r["dataset_content_sha256"] == "x" and r["iterations"] >= 1
    best, score = fitted.predict_text(spark, "a student loan")[0]
    assert best == 4 and score > 0.5


def test_vectors_are_those_of_the_postings(spark):
    df = spark.createDataFrame([(1, "loan card loan fee", 0), (2, "card fee", 1), (3, "", 0)], "row_id long, text string, class_id int")
    fitted = model.fit_text_classifier(df, "row_id", "text", "class_id", min_df=1, max_df=1.0, max_iter=3)
    idx = {r.term: r.idx for r in fitted.index.collect()}
    v = {r.row_id: r.features for r in fitted.vectors(df, "row_id", "text").collect()}
    assert v[3].numNonzeros() == 0 and v[1].size == len(idx) == fitted.size
    assert set(v[2].indices) == {idx["card"], idx["fee"], idx["card fee"]}
    assert v[1].norm(2) == pytest.approx(1.0) and v[1][idx["loan"]] > v[1][idx["fee"]]


def test_redaction_probe_sees_shape_only(spark):
    df = spark.createDataFrame([(i, ("XXXX paid {$5.00} " * (i % 2 * 4)) + "word " * 20, i % 2) for i in range(80)], "row_id long, text string, class_id int")
    p = model.shape_probe(df.filter("row_id < 60"), df.filter("row_id >= 60"), "row_id", "text", "class_id", rounds=2)
    assert p.filter("probe = 'redaction only' and y_true <> y_pred").count() == 0 and p.count() == 60

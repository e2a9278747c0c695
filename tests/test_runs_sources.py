import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from corpuslab import config, schemas
from corpuslab.operators import dynamics, fingerprint, runs
from corpuslab.sources import readers, sinks


def run_rows(spark, rows):
    base = {"experiment": "M0", "model": "m", "seed": 42, "macro_f1": 0.85, "accuracy": 0.84, "macro_precision": 0.8, "macro_recall": 0.8, "best_epoch": 2, "epochs_run": 4, "train_time": 10.0, "parameter_count": 100, "checkpoint_path": "p", "dataset_version": "v", "logged_at": None}
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in schemas.RUNS.fieldNames()) for r in full], schemas.RUNS)


def test_registry_upserts_and_validates(spark, tmp_path):
    reg = sinks.Registry(spark, str(tmp_path / "runs"))
    reg.upsert(run_rows(spark, [{}, {"seed": 123, "macro_f1": 0.86}]))
    reg.upsert(run_rows(spark, [{"macro_f1": 0.9}]))
    got = {r.seed: r.macro_f1 for r in reg.validated().collect()}
    assert got == {42: 0.9, 123: 0.86} and reg.version() == 2
    reg.upsert(run_rows(spark, [{"seed": 7, "accuracy": 1.5, "best_epoch": 9}]))
    with pytest.raises(ValueError, match="accuracy outside"):
        reg.validated()


@pytest.mark.parametrize("change", [{"macro_f1": None}, {"macro_f1": float("nan")}, {"seed": None}, {"experiment": "X"}, {"best_epoch": 0}, {"train_time": -1.0}, {"parameter_count": 0}, {"checkpoint_path": " "}])
def test_each_rule(spark, change):
    assert runs.validate(run_rows(spark, [change])).count() == 1
    assert runs.validate(run_rows(spark, [{}])).count() == 0


def test_comparison(spark):
    df = run_rows(spark, [{"macro_f1": 0.848}, {"seed": 123, "macro_f1": 0.850}, {"seed": 456, "macro_f1": 0.852}, {"experiment": "M1", "macro_f1": 0.866, "parameter_count": 2117893}])
    got = {r.model: r for r in runs.comparison(df).collect()}
    assert got["M0"].macro_f1 == "0.8500 ± 0.0020" and got["M0"].vs_previous == "—"
    assert got["M1"].vs_previous == got["M1"].vs_baseline == "+0.0160" and got["M1"].parameters == "2,117,893"


def test_predecessor_modes(spark):
    df = run_rows(spark, [{}, {"experiment": "M4", "macro_f1": 0.87}])
    assert {r.experiment: r.vs_previous for r in runs.deltas(df).collect()}["M4"] is None
    assert {r.experiment: r.vs_previous for r in runs.deltas(df, skip_missing=True).collect()}["M4"] == pytest.approx(0.02)


def test_traceability(spark):
    df = run_rows(spark, [{}, {"seed": 1, "dataset_version": "old"}, {"seed": 2}])
    ck = spark.createDataFrame([("M0", 42, "val_macro_f1"), ("M0", 1, "val_loss")], "experiment string, seed int, monitor_metric string")
    got = {(r.seed, r.error) for r in runs.traceability(df, "v", ck).collect()}
    assert got == {(1, "other dataset_version"), (1, "other monitor_metric"), (2, "no checkpoint record")}


def test_dynamics(spark):
    f1 = [0.5, 0.6, 0.6, None, 0.59, 0.7]
    df = spark.createDataFrame([("r", i + 1, v, 0.001 if i < 4 else 0.0005) for i, v in enumerate(f1)] + [("r", 1, 0.5, 0.001)], "run string, epoch int, val_macro_f1 double, learning_rate double")
    h = dynamics.clean(df)
    assert h.count() == 6
    assert tuple(dynamics.best_epoch(h).first()) == ("r", 6, 0.7)
    assert tuple(dynamics.best_epoch(h.filter("epoch < 6")).first()) == ("r", 2, 0.6)
    assert [r.epoch for r in dynamics.lr_reductions(h).collect()] == [5]
    assert [r.waited for r in dynamics.since_best(h).orderBy("epoch").collect()] == [0, 0, 1, 2, 3, 0]
    assert dynamics.early_stop(h, 3).first().stop_epoch == 5
    assert [r.lr for r in dynamics.plateau(h, 2).orderBy("epoch").collect()] == [0.001, 0.001, 0.001, 0.0005, 0.0005, 0.0005]


def test_digests(spark, tmp_path):
    df = spark.createDataFrame([("102", "b", "y"), ("101", "a", "x")], "id string, text string, label string")
    assert fingerprint.content_digest(df, df.columns) == fingerprint.content_digest(df.repartition(3), df.columns)
    assert fingerprint.content_digest(df, df.columns) != fingerprint.content_digest(df.replace("a", "c", "text"), df.columns)
    want = hashlib.sha256(b"ID_COL:id\n101\n102\nTEXT_COL:text\na\nb\nLABEL_COL:label\nx\ny\n").hexdigest()
    assert fingerprint.ordered_digest(df, "id", ["text", "label"], ["ID_COL", "TEXT_COL", "LABEL_COL"]) == want
    assert fingerprint.index_digest([1, 2]) == hashlib.sha256(struct.pack("<qq", 1, 2)).hexdigest()
    (tmp_path / "f").write_bytes(b"abc")
    assert fingerprint.file_digest(str(tmp_path / "f")) == hashlib.sha256(b"abc").hexdigest() == readers.read_file_hashes(spark, str(tmp_path / "f")).first().sha256


def test_split_manifest_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "AB"[i % 2], "train" if i < 8 else "test") for i in range(10)], "row_id long, text string, label string, split string")
    m = fingerprint.split(df, "row_id", "label", ["row_id", "text", "label"])
    fingerprint.save(m, str(tmp_path / "x" / "m.json"))
    assert fingerprint.verify(fingerprint.load(str(tmp_path / "x" / "m.json")), m) == []
    other = fingerprint.split(df.replace("t3", "t33", "text"), "row_id", "label", ["row_id", "text", "label"])
    assert len(fingerprint.verify(m, other)) == 1


def test_readers(spark, tmp_path):
    schema = "a string, b string"
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "2.csv").write_text('a,b\n3,"line\nbreak ""q"""\n')
    (tmp_path / "csv" / "1.csv").write_text("a,b\n1,x\n2,\n")
    got = readers.combine_csv(spark, str(tmp_path / "csv"), schema).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(0, "1", "x"), (1, "2", None), (2, "3", 'line\nbreak "q"')]
    with pytest.raises(FileNotFoundError):
        readers.read_any(spark, str(tmp_path / "no.parquet"))
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "x.txt"))
    p = str(tmp_path / "p.parquet")
    sinks.write_corpus(spark.range(3).toDF("row_id"), parquet=p)
    assert readers.read_counted(spark, p, 3).count() == 3
    with pytest.raises(ValueError):
        readers.read_counted(spark, p, 4)
    (tmp_path / "v.txt").write_text("alpha 1 2\nbeta 3 4\n")
    v = str(tmp_path / "v.txt")
    assert {r.word for r in readers.read_vocabulary(spark, v).collect()} == {"alpha", "beta"}
    want = spark.createDataFrame([("beta",)], "word string")
    assert [tuple(r) for r in readers.read_vectors(spark, v, 2, want).collect()] == [("beta", [3.0, 4.0])]
    (tmp_path / "h.json").write_text(json.dumps({"val_macro_f1": [0.1, None], "learning_rate": [0.01, 0.01]}))
    assert [(r.epoch, r.val_macro_f1) for r in readers.read_history(spark, str(tmp_path / "h.json"), "r").collect()] == [(1, 0.1), (2, None)]


def test_config(spark, data):
    c = config.current(spark.read.parquet(f"{data}/data_config.parquet"))
    assert c.label_column == "Product" and c.ratios == (0.8, 0.1, 0.1)
    for bad in ({"ratios": (0.5, 0.1, 0.1)}, {"labels": ("a", "a")}, {"dropout": 1.0}, {"learning_rate": 0.0}):
        with pytest.raises(ValueError):
            config.CorpusConfig(**{"text_column": "t", "label_column": "l", "labels": ("a",), **bad})
    with pytest.raises(ValueError, match="missing sections"):
        config.from_document({})
    assert config.environment(spark)["spark"] == spark.version


def test_frozen_dataset_is_checked(spark, tmp_path):
    from corpuslab.operators import frozen

    rows = spark.createDataFrame([(i, f"t{i}", "AB"[i % 2]) for i in range(10)] + [(50, "t1", "B")], "row_id long, text string, label string")
    s = spark.createDataFrame([(i, "train" if i < 8 else "test") for i in range(10)], "row_id long, split string")
    sp, mp = str(tmp_path / "split"), str(tmp_path / "m.json")
    sinks.write_split(s, sp)
    cols = ["row_id", "text", "label"]
    fingerprint.save(fingerprint.split(rows.filter("row_id < 10").join(s, "row_id"), "row_id", "label", cols), mp)
    assert frozen.load_frozen(spark, rows, sp, mp, "row_id", "text", "label", cols).count() == 10
    with pytest.raises(ValueError, match="expected"):
        frozen.load_frozen(spark, rows.replace("t3", "x", "text"), sp, mp, "row_id", "text", "label", cols)


def test_checkpoint_and_run_errors(tmp_path):
    from corpuslab.operators import frozen

    f = tmp_path / "c"
    f.write_bytes(b"w")
    good = {"monitor_metric": "val_macro_f1", "best_epoch": 2, "best_metric_value": 0.8}
    assert frozen.checkpoint_errors(good, str(f)) == []
    assert len(frozen.checkpoint_errors({"monitor_metric": "loss", "best_epoch": 0, "best_metric_value": 2}, str(tmp_path / "no"))) == 4
    run = {"dataset_version": "v", "best_epoch": 2, "epochs_run": 4, "val_macro_f1": 0.8}
    assert frozen.run_errors(run, {"dataset_content_sha256": "v"}, 0.8005, 10, [str(f)]) == []
    assert len(frozen.run_errors(run, {"dataset_content_sha256": "w"}, 0.9, 3, ["/no"])) == 4


def test_labels(spark):
    from pyspark.sql import functions as F

    from corpuslab.functions.labels import class_ids, first_max, ranked_classes

    names = spark.createDataFrame([("Credit card", 1), ("Other", None)], "label string, class_id int")
    df = spark.createDataFrame([(" credit  CARD",)], "p string")
    assert class_ids(df, "p", names).first().class_id == 1
    bad = spark.createDataFrame([("Other",)], "p string")
    assert class_ids(bad, "p", names, strict=False).first().class_id is None
    with pytest.raises(Exception, match="unknown label"):
        class_ids(bad, "p", names).collect()
    r = spark.createDataFrame([([0.2, 0.5, 0.5],)], "s array<double>").select(first_max(F.col("s")).alias("m"), ranked_classes(F.col("s")).alias("c")).first()
    assert r.m == 1 and [x.class_id for x in r.c] == [1, 2, 0]


def test_word_tokenizer_roundtrip(spark, tmp_path):
    from corpuslab.operators.vocab import WordTokenizer

    df = spark.createDataFrame([(0, ["a", "a", "b"]), (1, [])], "k long, ws array<string>")
    t = WordTokenizer.fit(df, "k", "ws", cap=3)
    t.save(str(tmp_path / "t"))
    u = WordTokenizer.load(spark, str(tmp_path / "t"))
    get = lambda x: {r.k: r.seq for r in x.transform(df, "k", "ws").collect()}
    assert get(t) == get(u) == {0: [2, 2, 1], 1: []} and u.cap == 3


def test_checkpoint_record_roundtrip(spark, tmp_path):
    from corpuslab.operators import frozen

    weights, record = tmp_path / "w.h5", tmp_path / "meta" / "M0_42.json"
    weights.write_bytes(b"w")
    kept = frozen.save_checkpoint(str(record), "M0", 42, 7, 0.842, str(weights), {"units": "64"})
    assert set(kept) == set(schemas.CHECKPOINT.fieldNames()) and frozen.verify_checkpoint(str(record), str(weights)) == []
    r = readers.read_checkpoints(spark, str(record.parent)).first()
    assert (r.experiment, r.best_epoch, r.best_metric_value, r.model_architecture) == ("M0", 7, 0.842, {"units": "64"})
    with pytest.raises(ValueError):
        frozen.save_checkpoint(str(record), "M0", 42, 7, 0.842, "w", metric="val_loss")
    weights.write_bytes(b"")
    assert "empty" in frozen.verify_checkpoint(str(record), str(weights))[0]
    record.write_text("{")
    assert "broken" in frozen.verify_checkpoint(str(record), str(weights))[0]
    record.write_text("{}")
    assert "lacks" in frozen.verify_checkpoint(str(record), str(weights))[0]
    assert len(frozen.verify_checkpoint(str(tmp_path / "no.json"), str(tmp_path / "no"))) == 2


def test_second_registry(spark, tmp_path):
    f = schemas.TRACKED_RUNS.fieldNames()
    rows = [("M0-1", "M0", 1, 0.84, 0.843), ("M0-2", "M0", 2, 0.846, 0.849), ("M1-1", "M1", 1, 0.859, 0.862), ("M3-1", "M3", 1, 0.80, None), ("X-1", "X", 1, 0.9, 0.9)]
    full = [dict.fromkeys(f) | {"run_id": a, "model_name": b, "seed": c, "best_val_macro_f1": d, "val_accuracy": e} for a, b, c, d, e in rows]
    df = spark.createDataFrame([tuple(r[c] for c in f) for r in full], schemas.TRACKED_RUNS)
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "runs"))
    back = readers.read_tracked_runs(spark, str(tmp_path / "runs"))
    assert back.count() == 5 and back.filter("run_id = 'M3-1'").first().val_accuracy is None
    reg = sinks.Registry(spark, str(tmp_path / "reg"), ("run_id",))
    reg.upsert(back)
    reg.upsert(back.filter("run_id = 'M0-1'").withColumn("best_val_macro_f1", F.lit(0.84)))
    assert reg.read().count() == 5
    got = {r.model: r for r in runs.tracked_comparison(reg.read()).collect()}
    assert list(got) == ["M0", "M1", "M3"] or set(got) == {"M0", "M1", "M3"}
    assert got["M0"].macro_f1 == "0.8430 ± 0.0042" and got["M0"].vs_previous == "—"
    assert (got["M1"].vs_previous, got["M1"].vs_baseline) == ("+0.0160", "+0.0160")
    assert (got["M3"].vs_previous, got["M3"].vs_baseline, got["M3"].accuracy) == ("—", "-0.0430", "—")


def test_upsert_validates(spark, tmp_path):
    reg = sinks.Registry(spark, str(tmp_path / "runs"))
    assert reg.upsert(run_rows(spark, [{}]), validate=True).count() == 1
    with pytest.raises(ValueError, match="accuracy"):
        reg.upsert(run_rows(spark, [{"accuracy": 2.0}]), validate=True)


def test_parameter_counts(spark):
    w = spark.createDataFrame([([20, 3], True), ([3], True), ([100, 7], False), ([], True)], "shape array<int>, trainable boolean")
    assert tuple(runs.parameter_counts(w).first()) == (64, 700, 764)
    assert tuple(runs.parameter_counts(w.limit(0)).first()) == (0, 0, 0)


def test_verify_all_names_every_error(spark, tmp_path):
    from corpuslab.operators import frozen

    (tmp_path / "a").write_text("")
    cfg = {"split": {"seed": 42}}
    frozen.verify_all({"project": lambda: frozen.project_errors(str(tmp_path), ["a"], cfg, {"split.seed": 42}), "registry": lambda: runs.validate(run_rows(spark, [{}]))})
    with pytest.raises(ValueError) as e:
        frozen.verify_all({"project": lambda: frozen.project_errors(str(tmp_path), ["a", "b"], cfg, {"split.seed": 1, "x.y": 2}), "registry": lambda: runs.validate(run_rows(spark, [{"accuracy": 7.0}])), "broken": lambda: 1 / 0})
    assert str(e.value).count("\n") == 4 and "ZeroDivisionError" in str(e.value)


def test_multiset_digests(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("c", 2)], "t string, g int")
    d = {r.g: (r.n, r.sha256) for r in fingerprint.multiset_digests(df, fingerprint.row_digest(["t"]), ["g"]).collect()}
    again = {r.g: (r.n, r.sha256) for r in fingerprint.multiset_digests(df.repartition(3), fingerprint.row_digest(["t"]), ["g"]).collect()}
    assert d == again and d[1][0] == 3
    # a row that stands twice counts twice
    once = fingerprint.content_digest(df.dropDuplicates(), ["t", "g"])
    assert once != fingerprint.content_digest(df, ["t", "g"])
    assert fingerprint.content_digest(df.limit(0), ["t"]) == hashlib.sha256(b"0,0,0,0,0,0,0,0,0").hexdigest()


def test_recurrent_config_and_times():
    from datetime import datetime, timezone

    ok = {"experiment": "M1", "vocab_size": 100, "output_classes": 5, "classes": 5, "experiments": ("M0", "M1")}
    config.RecurrentConfig(**ok)
    with pytest.raises(ValueError) as e:
        config.RecurrentConfig(**ok | {"experiment": "D0", "vocab_size": 0, "output_classes": 4, "embedding": "x", "layers": 4, "dropouts": (1.0,), "learning_rate": 0})
    assert str(e.value).count(";") == 6
    assert config.run_id("M0", 42, datetime(2025, 1, 2, 3, 4, 5, tzinfo=timezone.utc)) == "M0_seed42_20250102T030405Z"
    assert config.duration_s("2025-01-01T00:00:00+00:00", "2025-01-01T00:01:00.5+00:00") == 60.5

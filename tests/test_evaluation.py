import random

import pytest

from corpuslab.operators import errors, evaluate


def metrics(true, pred, k):
    """Scores from their definitions."""
    out = []
    for c in range(k):
        tp = sum(t == p == c for t, p in zip(true, pred))
        s, q = true.count(c), pred.count(c)
        out.append((tp / q if q else 0.0, tp / s if s else 0.0, 2 * tp / (s + q) if s + q else 0.0, s, s + q > 0))
    return out


def frame(spark, true, pred):
    return spark.createDataFrame([("r", i, t, p) for i, (t, p) in enumerate(zip(true, pred))], "run string, test_idx long, y_true int, y_pred int")


RNG = random.Random(5)
CASES = [
    ([0, 1, 2, 3, 4], [0, 1, 2, 3, 4]),
    ([0, 1, 2, 3, 4, 0, 1], [0, 1, 2, 3, 4, 1, 0]),
    ([0, 1, 2, 3, 4], [0] * 5),
    ([0, 1, 2, 3, 4, 4, 4], [0, 1, 2, 3, 3, 3, 2]),
    ([0, 1, 2, 4, 4], [0, 1, 2, 3, 4]),
    ([0, 1], [0, 1]),
    ([RNG.randrange(5) for _ in range(83)], [RNG.randrange(5) for _ in range(83)]),
]


@pytest.mark.parametrize("true, pred", CASES)
def test_scores(spark, true, pred):
    cm = evaluate.confusion(frame(spark, true, pred), ["run"], 5)
    cells = {(r.y_true, r.y_pred): r.n for r in cm.collect()}
    assert len(cells) == 25 and sum(cells.values()) == len(true)
    want = metrics(true, pred, 5)
    classes = evaluate.per_class(cm, ["run"])
    got = {r.class_id: r for r in classes.collect()}
    for c, (p, r, f, s, here) in enumerate(want):
        assert (got[c].precision, got[c].recall, got[c].f1) == pytest.approx((p, r, f))
        assert (got[c].support, got[c].present) == (s, here)
    m = evaluate.macro(classes, ["run"]).first()
    some = [w[2] for w in want if w[4]]
    assert m.macro_f1 == pytest.approx(sum(some) / len(some))
    assert m.macro_f1_all == pytest.approx(sum(w[2] for w in want) / 5)
    assert m.accuracy == pytest.approx(sum(t == p for t, p in zip(true, pred)) / len(true))


def test_absent_class_differs(spark):
    m = evaluate.macro(evaluate.per_class(evaluate.confusion(frame(spark, [0, 1], [0, 1]), ["run"], 5), ["run"]), ["run"]).first()
    assert (m.macro_f1, m.macro_f1_all) == (1.0, 0.4)


def test_label_checks(spark):
    df = spark.createDataFrame([(0, 5), (None, 1), (-1, None)], "y_true int, y_pred int")
    assert {r.check: r.violations for r in evaluate.check_labels(df, 5).collect()} == {"empty": 0, "null_true": 1, "null_pred": 1, "true_out_of_range": 1, "pred_out_of_range": 1}
    assert {r.check: r.violations for r in evaluate.check_labels(df.limit(0), 5).collect()}["empty"] == 1


def test_batches_differ_from_whole(spark):
    df = frame(spark, CASES[6][0], CASES[6][1])
    b = evaluate.batch_macro_f1(df, ["run"], "test_idx", 7, 5).first()
    assert b.batches == 12
    want = []
    for i in range(0, 83, 7):
        w = metrics(CASES[6][0][i : i + 7], CASES[6][1][i : i + 7], 5)
        some = [x[2] for x in w if x[4]]
        want.append(sum(some) / len(some))
    assert b.batch_macro_f1 == pytest.approx(sum(want) / len(want))


def test_seed_statistics(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.5), ("c", float("nan"))], "e string, v double")
    got = {r.e: r for r in evaluate.seed_statistics(df, ["e"], "v").collect()}
    assert got["a"].mean == pytest.approx(0.2) and got["a"].std == pytest.approx(0.1414213562)
    assert got["b"].std is None and got["c"].n == 0
    assert evaluate.seed_statistics(df, ["e"], "v", ddof=0).filter("e = 'b'").first().std == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "c int")
    assert {r.c: r.weight for r in evaluate.class_weights(df, "c").collect()} == pytest.approx({0: 4 / 6, 1: 2.0})


def test_groups_and_examples(spark):
    a = frame(spark, [0] * 12, [0] * 6 + [1] * 6)
    b = frame(spark, [0] * 12, [0, 1] * 6)
    g = errors.grouped(errors.align(a, b))
    assert {r.grp: r.n for r in errors.group_counts(g).collect()} == {"both_right": 3, "a_only_right": 3, "b_only_right": 3, "both_wrong": 3}
    ex = {}
    for r in errors.first_examples(g, "test_idx", 2).orderBy("grp", "rank").collect():
        ex.setdefault(r.grp, []).append(r.test_idx)
    assert ex == {"both_right": [0, 2], "a_only_right": [1, 3], "b_only_right": [6, 8], "both_wrong": [7, 9]}
    assert {r.check: r.violations for r in errors.alignment_checks(a, b.filter("test_idx > 1")).collect()} == {"only_a": 2, "only_b": 0, "truth_differs": 0}
    d = {(r.y_true, r.y_pred): (r.a_n, r.b_n, r.reduction) for r in errors.confusion_pair_delta(a, b).collect()}
    assert d == {(0, 1): (6, 6, 0)}


def test_latest_keeps_last(spark):
    df = spark.createDataFrame([("k", 1, 1), ("k", 3, 2), ("k", 2, 9)], "k string, at int, v int")
    assert [tuple(r) for r in evaluate.latest(df, ["k"], ["at"]).collect()] == [("k", 3, 2)]

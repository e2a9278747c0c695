"""Metrics, comparisons and error analysis over the predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import errors, evaluate
from corpuslab.operators.joins import small
from corpuslab.plans.core import complaints, labelled, query, table

K = 5
BY = ["experiment", "seed"]

_P = """, p0 as (select * from predictions qualify row_number() over (partition by experiment, seed, test_idx order by logged_at desc, y_true desc, y_pred desc nulls last) = 1), p as (select * from p0 where y_pred is not null)"""
_CM = _P + """, n as (select experiment, seed, y_true, y_pred, count(*) as n from p group by all), ids as (select unnest(range(5))::int as i),
cm as (select r.experiment, r.seed, a.i as y_true, b.i as y_pred, coalesce(n.n, 0) as n from (select distinct experiment, seed from p) r cross join ids a cross join ids b left join n on n.experiment = r.experiment and n.seed = r.seed and n.y_true = a.i and n.y_pred = b.i)"""
_PC = _CM + """, pc as (select experiment, seed, i as class_id, sum(n) filter (y_true = i)::bigint as support, sum(n) filter (y_pred = i)::bigint as predicted, sum(n) filter (y_true = i and y_pred = i)::bigint as tp from cm, ids group by all),
pr as (select *, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2.0::double * tp / nullif(support + predicted, 0), 0) as f1, support + predicted > 0 as present from pc)"""


def _latest(spark, sf_dir):
    return evaluate.latest(table(spark, sf_dir, "predictions"), ["experiment", "seed", "test_idx"], ["logged_at"])


def _valid(spark, sf_dir):
    return _latest(spark, sf_dir).filter("y_pred is not null")


@query(_P + "select experiment, seed, test_idx, y_true, y_pred from p0")
def latest_predictions(spark, sf_dir):
    return _latest(spark, sf_dir).select("experiment", "seed", "test_idx", "y_true", "y_pred")


@query(
    _P
    + """select 'empty' as "check", (count(*) = 0)::bigint as violations from p0 union all select 'null_true', count(*) filter (y_true is null) from p0 union all select 'null_pred', count(*) filter (y_pred is null) from p0
union all select 'true_out_of_range', count(*) filter (y_true < 0 or y_true >= 5) from p0 union all select 'pred_out_of_range', count(*) filter (y_pred < 0 or y_pred >= 5) from p0"""
)
def prediction_checks(spark, sf_dir):
    return evaluate.check_labels(_latest(spark, sf_dir), K)


def _cm(spark, sf_dir):
    return evaluate.confusion(_valid(spark, sf_dir), BY, K)


@query(_CM + "select experiment, seed, y_true, y_pred, n from cm")
def confusion_matrix(spark, sf_dir):
    return _cm(spark, sf_dir)


def _pc(spark, sf_dir):
    return evaluate.per_class(_cm(spark, sf_dir), BY)


@query(_PC + "select experiment, seed, l.label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from pr join l using (class_id)")
def per_class_metrics(spark, sf_dir):
    names = small(table(spark, sf_dir, "labels").filter("class_id is not null").select("class_id", "label"))
    return _pc(spark, sf_dir).join(names, "class_id").select(*BY, "label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    _PC
    + "select experiment, seed, round(sum(tp) / sum(support), 9) as accuracy, round(avg(f1) filter (present), 9) as macro_f1, round(avg(precision) filter (present), 9) as macro_precision, round(avg(recall) filter (present), 9) as macro_recall, round(avg(f1), 9) as macro_f1_all, sum(support)::bigint as n from pr group by all"
)
def macro_metrics(spark, sf_dir):
    m = evaluate.macro(_pc(spark, sf_dir), BY)
    return m.select(*BY, *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "macro_precision", "macro_recall", "macro_f1_all")], "n")


@query(
    _P
    + """, b as (select *, test_idx // 500 as batch from p), ids as (select unnest(range(5))::int as i),
pc as (select experiment, seed, batch, i, count(*) filter (y_true = i) as s, count(*) filter (y_pred = i) as q, count(*) filter (y_true = i and y_pred = i) as tp from b, ids group by all),
per as (select experiment, seed, batch, avg(2.0::double * tp / (s + q)) filter (s + q > 0) as f from pc group by all) select experiment, seed, round(avg(f), 9) as batch_macro_f1, count(*) as batches from per group by all"""
)
def batch_macro_f1(spark, sf_dir):
    return evaluate.batch_macro_f1(_valid(spark, sf_dir), BY, "test_idx", 500, K).withColumn("batch_macro_f1", F.round("batch_macro_f1", 9))


@query(", n as (select class_id, count(*) as n from x group by 1) select class_id, n, round(sum(n) over () / (count(*) over () * n), 9) as weight from n")
def class_weights(spark, sf_dir):
    return evaluate.class_weights(labelled(spark, sf_dir), "class_id").withColumn("weight", F.round("weight", 9))


def _model(spark, sf_dir, e, s):
    return _valid(spark, sf_dir).filter((F.col("experiment") == e) & (F.col("seed") == s))


_AB = _P + ", a as (select * from p where experiment = 'M4' and seed = 42), b as (select * from p where experiment = 'D0' and seed = 42), ab as (select test_idx, a.y_true, a.y_pred as a_pred, b.y_pred as b_pred from a join b using (test_idx)), g as (select *, case when a_pred = y_true and b_pred = y_true then 'both_right' when a_pred = y_true then 'a_only_right' when b_pred = y_true then 'b_only_right' else 'both_wrong' end as grp from ab)"


def _ab(spark, sf_dir):
    return _model(spark, sf_dir, "M4", 42), _model(spark, sf_dir, "D0", 42)


@query(_AB + "select test_idx, y_true, a_pred, b_pred, grp from g")
def prediction_alignment(spark, sf_dir):
    return errors.grouped(errors.align(*_ab(spark, sf_dir))).select("test_idx", "y_true", "a_pred", "b_pred", "grp")


@query(_AB + """select 'only_a' as "check", count(*) as violations from (select test_idx from a except select test_idx from b) union all select 'only_b', count(*) from (select test_idx from b except select test_idx from a) union all select 'truth_differs', count(*) from a join b using (test_idx) where a.y_true is distinct from b.y_true""")
def alignment_checks(spark, sf_dir):
    return errors.alignment_checks(*_ab(spark, sf_dir))


@query(_AB + "select grp, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as pct from g group by 1")
def disagreement_groups(spark, sf_dir):
    return errors.group_counts(errors.grouped(errors.align(*_ab(spark, sf_dir))))


@query(_AB + r", r as (select *, row_number() over (partition by grp order by test_idx) as rank from g) select r.grp, rank, test_idx, y_true, a_pred, b_pred, substr(regexp_replace(regexp_replace(text, '\S+@\S+\.\w+', '[email]', 'g'), '[0-9]{6,}', '[number]', 'g'), 1, 180) as excerpt from r join c on c.row_id = test_idx where rank <= 5")
def first_k_examples(spark, sf_dir):
    f = errors.first_examples(errors.grouped(errors.align(*_ab(spark, sf_dir))), "test_idx", 5)
    c = complaints(spark, sf_dir).select(F.col("row_id").alias("test_idx"), "text")
    # five rows per group
    return c.join(F.broadcast(f), "test_idx").select("grp", F.col("rank").cast("long").alias("rank"), "test_idx", "y_true", "a_pred", "b_pred", T.excerpt(F.col("text")).alias("excerpt"))


@query(_AB + ", fa as (select y_true, y_pred, count(*) as n from a where y_true <> y_pred group by all), fb as (select y_true, y_pred, count(*) as n from b where y_true <> y_pred group by all) select coalesce(fa.y_true, fb.y_true) as y_true, coalesce(fa.y_pred, fb.y_pred) as y_pred, coalesce(fa.n, 0) as a_n, coalesce(fb.n, 0) as b_n, coalesce(fa.n, 0) - coalesce(fb.n, 0) as reduction from fa full join fb on fa.y_true = fb.y_true and fa.y_pred = fb.y_pred")
def confusion_pair_delta(spark, sf_dir):
    return errors.confusion_pair_delta(*_ab(spark, sf_dir))


@query(_PC + ", e as (select experiment, class_id, support - tp as errors, f1 from pr where seed = 42 and experiment in ('M4', 'D0')) select a.class_id, a.errors as a_errors, b.errors as b_errors, round(b.f1 - a.f1, 9) as f1_delta from e a join e b using (class_id) where a.experiment = 'M4' and b.experiment = 'D0'")
def class_error_delta(spark, sf_dir):
    pc = _pc(spark, sf_dir).filter("seed = 42").withColumn("errors", F.col("support") - F.col("tp"))
    a = pc.filter("experiment = 'M4'").select("class_id", F.col("errors").alias("a_errors"), F.col("f1").alias("fa"))
    b = pc.filter("experiment = 'D0'").select("class_id", F.col("errors").alias("b_errors"), F.col("f1").alias("fb"))
    return a.join(b, "class_id").select("class_id", "a_errors", "b_errors", F.round(F.col("fb") - F.col("fa"), 9).alias("f1_delta"))


@query(
    _AB
    + r""", f as (select grp, len(list_filter(string_split(translate(lower(text), '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 34)), ' '), lambda q: q <> '')) as k, len(regexp_extract_all(text, '\bX{2,}\b')) as xs from g join c on c.row_id = test_idx) select grp, count(*) as n, round(100.0 * avg((k > 128)::int), 4) as truncated_pct, round(avg(100.0::double * xs / nullif(k, 0)), 6) as redaction_density from f group by 1"""
)
def error_group_profile(spark, sf_dir):
    g = errors.grouped(errors.align(*_ab(spark, sf_dir))).select(F.col("test_idx").alias("row_id"), "grp")
    f = complaints(spark, sf_dir).select("row_id", F.size(T.split_words(F.col("text"))).alias("k"), F.regexp_count("text", F.lit(T.ARTIFACTS["XXXX redaction"])).alias("xs")).join(g, "row_id")
    return f.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg((F.col("k") > 128).cast("int")), 4).alias("truncated_pct"), F.round(F.avg(F.try_divide(F.lit(100.0) * F.col("xs"), F.col("k"))), 6).alias("redaction_density"))


_DUP = _P + ", dup as (select row_id, count(*) over (partition by text) > 1 as twin from c), e as (select p.*, dup.twin from p join dup on row_id = test_idx)"


@query(
    _DUP
    + """, ids as (select unnest(range(5))::int as i), pc as (select experiment, seed, twin, i, count(*) filter (y_true = i) as s, count(*) filter (y_pred = i) as q, count(*) filter (y_true = i and y_pred = i) as tp from e, ids group by all)
select experiment, seed, twin, sum(s)::bigint as n, round(avg(2.0::double * tp / (s + q)) filter (s + q > 0), 9) as macro_f1 from pc group by all"""
)
def contamination_metrics(spark, sf_dir):
    """Macro-F1 apart for test rows whose text stands elsewhere in the corpus, and for the others."""
    from corpuslab.operators.dedup import duplicate_flags

    d = duplicate_flags(complaints(spark, sf_dir).select("row_id", "text"), "text", "row_id")
    e = _valid(spark, sf_dir).join(d.select(F.col("row_id").alias("test_idx"), (F.col("copies") > 1).alias("twin")), "test_idx")
    by = [*BY, "twin"]
    m = evaluate.macro(evaluate.per_class(evaluate.confusion(e, by, K), by), by)
    return m.select(*by, "n", F.round("macro_f1", 9).alias("macro_f1"))

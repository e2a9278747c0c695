"""Leak-free splits of the first rows, by near-duplicate cluster; models on them; streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.operators import evaluate, fingerprint, model, split
from corpuslab.plans.core import MULTISET, complaints, labelled, query
from corpuslab.plans.similarity import _CL, _clusters
from corpuslab.session import Stage
from corpuslab.streaming import confusion, history

_SP = _CL + """, gl as (select root, pkey as label, count(*) as n from cl join d using (row_id) group by all), dom as (select root, label, sum(n) over (partition by root) as size from gl qualify row_number() over (partition by root order by n desc, label) = 1),
fo as (select root, (row_number() over (partition by label order by size desc, md5(root || '-42')) - 1) % 10 as fold from dom), sp as (select row_id, root, case fold when 0 then 'validation' when 1 then 'test' else 'train' end as split from cl join fo using (root)),
full_ as (select sp.*, d.text, d.pkey from sp join d using (row_id))"""


def _rows(spark, sf_dir):
    """First rows with their clusters and, for a text, its digest: what follows asks only which texts are equal."""
    short = complaints(spark, sf_dir).select("row_id", F.md5(F.col("text").cast("binary")).alias("text"), "pkey")
    return short.join(_clusters(spark, sf_dir), "row_id")


def _assigned(spark, sf_dir):
    stage = Stage(spark, "splitting")
    rows = stage.put(_rows(spark, sf_dir))
    return rows, stage.put(split.group_split(rows, "row_id", "root", "pkey"))


@query(_SP + "select row_id, root, split from sp")
def group_split(spark, sf_dir):
    return _assigned(spark, sf_dir)[1]


def _leak(col: str, kind: str) -> str:
    return " union all ".join(
        f"select '{kind}' as kind, '{a}/{b}' as pair, (select count(*) from (select {col} from full_ where split = '{a}' intersect select {col} from full_ where split = '{b}')) as shared"
        for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
    )


@query(_SP + _leak("text", "text") + " union all " + _leak("root", "group"))
def split_leakage(spark, sf_dir):
    rows, s = _assigned(spark, sf_dir)
    return split.leakage(rows.join(s.select("row_id", "split"), "row_id"), "text", "root")


@query(_SP + f"select split, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, {MULTISET} as ids_sha256 from (select split, sha256(row_id::varchar) as h from full_) group by 1")
def split_fingerprint(spark, sf_dir):
    """Size and digest of the ids of each split."""
    d = fingerprint.multiset_digests(_assigned(spark, sf_dir)[1], fingerprint.row_digest(["row_id"]), ["split"])
    total = F.sum("n").over(Window.partitionBy())  # one row per split
    return d.select("split", "n", F.round(F.col("n") / total, 6).alias("share"), F.col("sha256").alias("ids_sha256"))


_DEV = """, sn as (select split, count(*) as sn from full_ group by 1), ln as (select pkey, count(*) as ln from full_ group by 1), n as (select split, pkey, count(*) as n from full_ group by all), dv as (select sn.split, ln.pkey, coalesce(n, 0) / sn - ln / (select count(*) from full_) as deviation from sn cross join ln left join n on n.split = sn.split and n.pkey = ln.pkey)"""


@query(_SP + _DEV + "select split, pkey as label, round(deviation, 9) as deviation from dv")
def split_class_deviation(spark, sf_dir):
    rows, s = _assigned(spark, sf_dir)
    d = split.class_deviation(rows.join(s.select("row_id", "split"), "row_id"), "pkey")
    return d.select("split", F.col("pkey").alias("label"), F.round("deviation", 9).alias("deviation"))


@query(
    _SP
    + _DEV
    + """, lk as ("""
    + _leak("text", "text")
    + " union all "
    + _leak("root", "group")
    + """)
select 'row_in_several_splits' as "check", (select count(*) from (select row_id from sp group by 1 having count(*) > 1)) as violations
union all select 'row_without_split', (select count(*) from d anti join sp using (row_id)) union all select 'unknown_row', (select count(*) from sp anti join d using (row_id))
union all select 'duplicate_text', (select count(*) from (select text from full_ group by 1 having count(*) > 1))
union all select kind || ' in ' || pair, shared from lk
union all select 'ratio', (select count(*) from (select split, count(*) / sum(count(*)) over () as share from full_ group by 1) where abs(share - case split when 'train' then 0.8 else 0.1 end) > 0.015)
union all select 'class_share', (select count(*) from dv where abs(deviation) > 0.015)"""
)
def split_checks(spark, sf_dir):
    rows, s = _assigned(spark, sf_dir)
    return split.validate(s, rows, "row_id", "text", "root", "pkey")


def _parts(spark, sf_dir):
    """Labelled first rows, nine tenths of which train."""
    x = labelled(spark, sf_dir).withColumn("part", F.conv(F.substring(F.md5(F.col("row_id").cast("string").cast("binary")), 1, 2), 16, 10).cast("int"))
    x = Stage(spark, "parts").put(x)
    return x.filter("part < 230"), x.filter("part >= 230")


@query()
def lr_tfidf_predictions(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    fitted = model.fit_text_classifier(train, "row_id", "text", "class_id")
    return fitted.predict(test, "row_id", "text").join(test.select("row_id", F.col("class_id").alias("y_true")), "row_id").select("row_id", "y_true", "y_pred")


@query()
def lr_top_features(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    return model.fit_text_classifier(train, "row_id", "text", "class_id").top_features(spark, 12)


@query()
def redaction_probe(spark, sf_dir):
    """What length and redactions alone tell of the class: macro-F1 by what is seen."""
    train, test = _parts(spark, sf_dir)
    p = Stage(spark, "probe").put(model.shape_probe(train, test, "row_id", "text", "class_id"))
    return evaluate.macro(evaluate.per_class(evaluate.confusion(p, ["probe"], 5), ["probe"]), ["probe"]).select("probe", "n", "accuracy", "macro_f1")


@query()
def audit_classifier(spark, sf_dir):
    """Scores of each class by the classifier of the audit: terms alone, at most 60,000 of them, and a weaker penalty."""
    train, test = _parts(spark, sf_dir)
    fitted = model.fit_text_classifier(train, "row_id", "text", "class_id", **model.AUDIT)
    p = fitted.predict(test, "row_id", "text").join(test.select("row_id", F.col("class_id").alias("y_true")), "row_id")
    return evaluate.per_class(evaluate.confusion(p, [], 5), []).select("class_id", "support", "precision", "recall", "f1")


@query("select experiment, seed, y_true, y_pred, count(*) as n from predictions where y_pred is not null group by all", views=False)
def stream_confusion(spark, sf_dir):
    return confusion.confusion_of_stream(spark, f"{sf_dir}/predictions.parquet")


@query()
def stream_schedule(spark, sf_dir):
    return history.schedule_of_stream(spark, f"{sf_dir}/epoch_history.parquet")

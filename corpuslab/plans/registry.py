"""Run registry, training dynamics and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import dynamics, evaluate, fingerprint, runs
from corpuslab.plans.core import MULTISET, complaints, query, table

_LAST = "with r as (select * from run_registry qualify row_number() over (partition by experiment, seed order by logged_at desc) = 1)"
_ORD = ", lad as (select * from (values ('M0', 0, null), ('M1', 1, 'M0'), ('M2', 2, 'M1'), ('M3', 3, 'M2'), ('M4', 4, 'M3'), ('M5', 5, 'M4'), ('M6', 6, 'M5'), ('D0', 7, 'M6')) t(experiment, ord, predecessor)), m as (select experiment, avg(macro_f1) as mean, stddev_samp(macro_f1) as std, count(macro_f1) as n, max(macro_f1) - min(macro_f1) as spread from r where not isnan(macro_f1) group by 1)"
_DELTA = _LAST + _ORD + ", dl as (select m.experiment, lad.ord, m.mean, m.std, m.n, m.spread, m.mean - p.mean as vs_previous, case when m.experiment <> 'M0' then m.mean - (select mean from m where experiment = 'M0') end as vs_baseline from m join lad using (experiment) left join m p on p.experiment = lad.predecessor)"


def _runs(spark, sf_dir):
    return runs.newest(table(spark, sf_dir, "run_registry"))


@query(_LAST + "select experiment, seed, model, round(accuracy, 9) as accuracy, best_epoch, parameter_count, logged_at from r", views=False)
def registry_upsert(spark, sf_dir):
    return _runs(spark, sf_dir).select("experiment", "seed", "model", F.round("accuracy", 9).alias("accuracy"), "best_epoch", "parameter_count", "logged_at")


@query("select experiment, seed, count(*) as n from run_registry group by all having count(*) > 1", views=False)
def registry_duplicate_keys(spark, sf_dir):
    return runs.duplicate_keys(table(spark, sf_dir, "run_registry"))


@query(
    "with e as (select experiment, seed, unnest([case when experiment is null or experiment not in ('M0','M1','M2','M3','M4','M5','M6','D0') then 'unknown experiment' end, case when seed is null then 'null seed' end, "
    + ", ".join(f"case when {m} is null or isnan({m}) or {m} < 0 or {m} > 1 then '{m} outside [0, 1]' end" for m in runs.METRICS)
    + ", case when best_epoch is null or best_epoch < 1 or best_epoch > epochs_run then 'best_epoch outside the run' end, case when train_time is null or isnan(train_time) or train_time < 0 then 'negative train_time' end, case when parameter_count is null or parameter_count <= 0 then 'parameter_count not positive' end, case when checkpoint_path is null or trim(checkpoint_path) = '' then 'no checkpoint_path' end, case when model is null then 'null model' end]) as error from run_registry) select * from e where error is not null",
    views=False,
)
def registry_errors(spark, sf_dir):
    return runs.validate(table(spark, sf_dir, "run_registry"))


@query(_LAST + ", need as (select * from (values ('M0', 3), ('M1', 1), ('M2', 1), ('M3', 1), ('M4', 1), ('D0', 3)) t(experiment, required)), have as (select experiment, count(distinct seed) as have from r group by 1) select experiment, required, coalesce(have, 0) as have, coalesce(have, 0) >= required as complete from need left join have using (experiment)", views=False)
def seed_completeness(spark, sf_dir):
    return runs.seed_completeness(_runs(spark, sf_dir))


@query(_LAST + "select experiment, count(distinct parameter_count) as counts from r group by 1 having count(distinct parameter_count) <> 1", views=False)
def parameter_consistency(spark, sf_dir):
    return runs.parameter_consistency(_runs(spark, sf_dir))


@query(_LAST + "select experiment, round(avg(macro_f1), 9) as mean, round(stddev_samp(macro_f1), 9) as std, count(macro_f1) as n, round(max(macro_f1) - min(macro_f1), 9) as spread from r where not isnan(macro_f1) group by 1", views=False)
def seed_statistics(spark, sf_dir):
    s = evaluate.seed_statistics(_runs(spark, sf_dir), ["experiment"], "macro_f1")
    return s.select("experiment", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n", F.round("spread", 9).alias("spread"))


@query(_DELTA + "select experiment, ord, round(mean, 9) as mean, round(vs_previous, 9) as vs_previous, round(vs_baseline, 9) as vs_baseline from dl", views=False)
def registry_deltas(spark, sf_dir):
    d = runs.deltas(_runs(spark, sf_dir))
    return d.select("experiment", "ord", *[F.round(c, 9).alias(c) for c in ("mean", "vs_previous", "vs_baseline")])


@query(
    _DELTA + ", s as (select *, (select spread from m where experiment = 'M0') as base from dl) select experiment, case when vs_baseline is null then null when abs(vs_baseline) / base < 1.0 then 'within spread' when abs(vs_baseline) / base < 1.5 then 'borderline' else 'beyond spread' end as verdict from s",
    views=False,
)
def delta_classification(spark, sf_dir):
    from pyspark.sql import Window

    d = runs.deltas(_runs(spark, sf_dir))
    base = F.max(F.when(F.col("experiment") == "M0", F.col("spread"))).over(Window.partitionBy())
    return d.withColumn("base", base).select("experiment", runs.classify_delta(F.col("vs_baseline"), F.col("base")).alias("verdict"))


@query(
    _DELTA
    + """, a as (select experiment, avg(accuracy) as am, stddev_samp(accuracy) as s from r where accuracy is not null and not isnan(accuracy) group by 1), t as (select experiment, count(*) as runs, min(best_epoch) as lo, max(best_epoch) as hi, avg(train_time) as tm, stddev_samp(train_time) as ts, min(parameter_count) as pc from r group by 1)
select ord, experiment as model, '' as configuration, case when std is null then printf('%.4f', mean) else printf('%.4f ± %.4f', mean, std) end as macro_f1, case when a.s is null then printf('%.4f', am) else printf('%.4f ± %.4f', am, a.s) end as accuracy,
case when vs_previous is null then '—' else (case when vs_previous < 0 then '-' else '+' end) || printf('%.4f', abs(vs_previous)) end as vs_previous, case when vs_baseline is null then '—' else (case when vs_baseline < 0 then '-' else '+' end) || printf('%.4f', abs(vs_baseline)) end as vs_baseline,
case when runs > 1 then lo || '–' || hi else lo::varchar end as best_epoch, case when runs > 1 then printf('%.0f ± %.0f', tm, ts) else printf('%.0f', tm) end as time, format('{:,}', pc) as parameters from dl join a using (experiment) join t using (experiment)""",
    views=False,
)
def comparison_table(spark, sf_dir):
    return runs.comparison(_runs(spark, sf_dir))


@query(
    _LAST
    + """, lad as (select * from (values ('M0', 0), ('M1', 1), ('M2', 2), ('M3', 3), ('M4', 4), ('D0', 5)) t(model, ord)), s as (select ord, model, avg(f) as f, stddev_samp(f) as fs, avg(a) as a, stddev_samp(a) as ds, count(*) as runs from (select experiment as model, case when not isnan(macro_f1) then macro_f1 end as f, case when not isnan(accuracy) then accuracy end as a from r) join lad using (model) group by 1, 2 having avg(f) is not null),
x as (select s.*, p.f as p, (select f from s where ord = 0) as b from s left join s p on p.ord = s.ord - 1)
select ord, model, '' as configuration, case when runs > 1 then printf('%.4f ± %.4f', f, coalesce(fs, 0)) else printf('%.4f', f) end as macro_f1, case when a is null then '—' when runs > 1 then printf('%.4f ± %.4f', a, coalesce(ds, 0)) else printf('%.4f', a) end as accuracy,
case when ord = 0 or p is null then '—' else (case when f > p then '+' else '' end) || printf('%.4f', f - p) end as vs_previous, case when ord = 0 or b is null then '—' else (case when f > b then '+' else '' end) || printf('%.4f', f - b) end as vs_baseline from x""",
    views=False,
)
def tracked_comparison(spark, sf_dir):
    """The comparison of the second registry, with the scores of this one."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    r = _runs(spark, sf_dir).select(F.concat_ws("-", "experiment", "seed").alias("run_id"), F.col("experiment").alias("model_name"), "seed", number("accuracy").alias("val_accuracy"), number("macro_f1").alias("best_val_macro_f1"))
    return runs.tracked_comparison(r)


@query("with h as (select run, epoch, max(val_macro_f1) as v, max(learning_rate) as lr from epoch_history group by all) select run, epoch as best_epoch, round(v, 9) as best from h where v is not null qualify row_number() over (partition by run order by v desc, epoch) = 1", views=False)
def best_epoch(spark, sf_dir):
    return dynamics.best_epoch(dynamics.clean(table(spark, sf_dir, "epoch_history"))).withColumn("best", F.round("best", 9))


@query("with h as (select run, epoch, max(learning_rate) as lr from epoch_history group by all), k as (select run, epoch, lag(lr) over (partition by run order by epoch) as before, lr as after from h) select * from k where after < before", views=False)
def lr_reductions(spark, sf_dir):
    return dynamics.lr_reductions(dynamics.clean(table(spark, sf_dir, "epoch_history")))


_SINCE = "with h as (select run, epoch, max(val_macro_f1) as v from epoch_history group by all), p as (select *, max(v) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as prior from h), u as (select *, case when v is not null and (prior is null or v > prior) then epoch end as hit from p), s as (select run, epoch, epoch - coalesce(max(hit) over (partition by run order by epoch), 0) as waited from u)"


@query(_SINCE + "select run, epoch, waited from s", views=False)
def epochs_since_best(spark, sf_dir):
    return dynamics.since_best(dynamics.clean(table(spark, sf_dir, "epoch_history")))


@query(_SINCE + "select run, min(epoch) as stop_epoch from s where waited >= 1 group by 1", views=False)
def early_stop_epoch(spark, sf_dir):
    return dynamics.early_stop(dynamics.clean(table(spark, sf_dir, "epoch_history")), 1)


@query()
def plateau_schedule(spark, sf_dir):
    return dynamics.plateau(dynamics.clean(table(spark, sf_dir, "epoch_history")))


@query(
    """, p as (select "Product" as product, count(*) as n from c group by 1) select count(*) as "rows", count(distinct text) as unique_texts, count(*) - count(distinct text) as duplicate_texts, count(*) filter (text is null) as null_texts, (select count(*) from p) as labels,
(select """
    + MULTISET
    + """ from (select sha256(concat_ws(chr(31), coalesce("Complaint ID", ''), coalesce(text, ''), coalesce("Product", ''), row_id::varchar)) as h from c)) as content_sha256 from c"""
)
def dataset_fingerprint(spark, sf_dir):
    c = complaints(spark, sf_dir)
    return fingerprint.dataset(c, "text", "Product", ["Complaint ID", "text", "Product", "row_id"])


@query("""select "Product" as product, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as ratio from c where "Product" is not null group by 1""")
def fingerprint_classes(spark, sf_dir):
    return fingerprint.class_distribution(complaints(spark, sf_dir).select(F.col("Product").alias("product")), "product")


@query(
    _LAST
    + ", v as (select dataset_version as want from r order by logged_at desc limit 1), e as (select experiment, seed, unnest([case when dataset_version is distinct from want then 'other dataset_version' end, case when checkpoint_path is distinct from 'ckpt/' || experiment || '_' || seed || '.weights' then 'no checkpoint record' end]) as error from r, v) select * from e where error is not null",
    views=False,
)
def run_traceability(spark, sf_dir):
    """Runs that can't be traced to the newest dataset version and to a checkpoint of their own."""
    r = _runs(spark, sf_dir)
    want = r.orderBy(F.desc("logged_at")).select("dataset_version").first()
    own = F.concat(F.lit("ckpt/"), F.col("experiment"), F.lit("_"), F.col("seed").cast("string"), F.lit(".weights"))
    kept = r.filter(F.col("checkpoint_path") == own).select("experiment", "seed", F.lit("val_macro_f1").alias("monitor_metric"))
    return runs.traceability(r, want.dataset_version if want else "", kept)


@query("with e as (select run, epoch, max(val_macro_f1) as v from epoch_history group by all), b as (select run, epoch, v from e where v is not null qualify row_number() over (partition by run order by v desc, epoch) = 1), r as (select * from run_registry qualify row_number() over (partition by experiment, seed order by logged_at desc) = 1) select experiment, seed, b.epoch = best_epoch as epoch_agrees, abs(b.v - macro_f1) <= 0.001 as value_agrees from r join b on b.run = experiment || '_seed' || seed", views=False)
def history_agreement(spark, sf_dir):
    """Whether the registry's best epoch and score are those of the run's history."""
    b = dynamics.best_epoch(dynamics.clean(table(spark, sf_dir, "epoch_history"))).select("run", F.col("best_epoch").alias("e"), "best")
    r = _runs(spark, sf_dir).withColumn("run", F.concat(F.col("experiment"), F.lit("_seed"), F.col("seed").cast("string")))
    return r.join(b, "run").select("experiment", "seed", (F.col("e") == F.col("best_epoch")).alias("epoch_agrees"), (F.abs(F.col("best") - F.col("macro_f1")) <= 0.001).alias("value_agrees"))

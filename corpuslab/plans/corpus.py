"""Audit of the complaint corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import dedup, profile
from corpuslab.operators.joins import small
from corpuslab.plans.core import complaints, first_rows, labelled, query, table, words

COLUMNS = ["Date received", "Product", "Sub-product", "Issue", "Sub-issue", "Consumer complaint narrative", "Company public response", "Company", "State", "ZIP code", "Tags", "Submitted via", "Date sent to company", "Company response to consumer", "Timely response?", "Complaint ID"]


@query("select row_id, pkey as product from d")
def dedup_keep_first(spark, sf_dir):
    return first_rows(spark, sf_dir).select("row_id", F.col("pkey").alias("product"))


@query("select label, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as pct from x group by 1")
def class_summary(spark, sf_dir):
    return profile.class_summary(labelled(spark, sf_dir), "label")


@query("select coalesce(a.product, b.product) as product, a.n as n_raw, coalesce(b.n, 0) as n_dedup, a.n - coalesce(b.n, 0) as removed from (select pkey as product, count(*) as n from c group by 1) a full join (select pkey as product, count(*) as n from d group by 1) b on a.product = b.product")
def class_loss_after_dedup(spark, sf_dir):
    a = complaints(spark, sf_dir).groupBy(F.col("pkey").alias("product")).agg(F.count(F.lit(1)).alias("n_raw"))
    b = first_rows(spark, sf_dir).groupBy(F.col("pkey").alias("product")).agg(F.count(F.lit(1)).alias("n"))
    both = a.join(b, "product", "full_outer")
    return both.select("product", "n_raw", F.coalesce("n", F.lit(0)).alias("n_dedup"), (F.col("n_raw") - F.coalesce("n", F.lit(0))).alias("removed"))


@query("select md5(text) as text_md5, count(*) as copies from c where text is not null group by 1 having count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(complaints(spark, sf_dir), "text")


@query("select copies, count(*) as groups from (select count(*) as copies from c where text is not null group by text having count(*) > 1) group by 1")
def duplicate_group_sizes(spark, sf_dir):
    return duplicate_groups(spark, sf_dir).groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))


@query(", f as (select row_id, pkey as product, count(*) over (partition by text) as copies from c) select product, count(*) filter (copies > 1) as in_groups, round(100.0 * count(*) filter (copies > 1) / count(*), 4) as pct from f group by 1")
def duplicate_share_by_class(spark, sf_dir):
    c = complaints(spark, sf_dir).select("row_id", "text", F.col("pkey").alias("product"))
    f = dedup.duplicate_flags(c, "text", "row_id").join(c.select("row_id", "product"), "row_id")
    return f.groupBy("product").agg(F.count_if(F.col("copies") > 1).alias("in_groups"), F.round(100.0 * F.count_if(F.col("copies") > 1) / F.count(F.lit(1)), 4).alias("pct"))


@query(", f as (select row_id, row_number() over (partition by text order by row_id) > 1 as later, count(*) over (partition by text) as copies from c) select row_id, copies, later from f")
def duplicate_flags(spark, sf_dir):
    return dedup.duplicate_flags(complaints(spark, sf_dir).select("row_id", "text"), "text", "row_id")


@query('select md5(text) as text_md5, count(distinct "Product") as labels, count(*) as "rows" from c group by 1 having count(distinct "Product") > 1')
def label_conflicts(spark, sf_dir):
    return dedup.label_conflicts(complaints(spark, sf_dir), "text", "Product")


@query(", f as (select md5(text) as text_md5, pkey as product, text from c), k as (select text_md5 from f group by 1 having count(distinct product) > 1) select text_md5, product, count(*) as n from f semi join k using (text_md5) group by 1, 2")
def label_conflict_detail(spark, sf_dir):
    c = complaints(spark, sf_dir).select(F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("pkey").alias("product"))
    per = c.groupBy("text_md5", "product").agg(F.count(F.lit(1)).alias("n"))
    conflict = per.groupBy("text_md5").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return per.join(conflict, "text_md5", "left_semi")


@query("\nunion all\n".join(f"""select '{k}' as "column", cast(count(*) - count("{k}") as bigint) as nulls, count(distinct "{k}") as distinct_values, 'string' as type from combined_complaints""" for k in COLUMNS), views=False)
def column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "combined_complaints").select(*[f"`{c}`" for c in COLUMNS]))


@query(
    """select count(*) filter (text is null) as null_text, count(*) filter (trim(text) = '') as blank_text, count(*) filter (pkey not in (select lkey from l where class_id is not null)) as other_label,
count(*) - (select count(*) from (select distinct """
    + ", ".join(f'"{k}"' for k in COLUMNS)
    + " from combined_complaints)) as full_duplicates from c"
)
def quality_predicates(spark, sf_dir):
    c = complaints(spark, sf_dir)
    keys = small(table(spark, sf_dir, "labels").filter("class_id is not null").select(T.label_key(F.col("label")).alias("pkey"), F.lit(True).alias("known")))
    full = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`"), F.lit("\0")) for k in COLUMNS]).cast("binary"))
    marked = c.withColumn("h", full).join(keys, "pkey", "left")
    per = marked.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("a"), F.count_if(F.trim("text") == "").alias("b"), F.count_if(F.col("known").isNull()).alias("o")
    )
    return per.agg(F.sum("a").alias("null_text"), F.sum("b").alias("blank_text"), F.sum("o").alias("other_label"), (F.sum("n") - F.count(F.lit(1))).alias("full_duplicates"))


@query(", n as (select len(words) as k from w) select min(k) as min, round(avg(k), 1) as mean, round(stddev_samp(k), 1) as std, floor(quantile_cont(k, 0.5))::bigint as p50, floor(quantile_cont(k, 0.75))::bigint as p75, floor(quantile_cont(k, 0.9))::bigint as p90, floor(quantile_cont(k, 0.95))::bigint as p95, floor(quantile_cont(k, 0.99))::bigint as p99, max(k) as max from n")
def length_summary(spark, sf_dir):
    return profile.length_summary(words(spark, sf_dir).select(F.size("words").alias("k")), "k")


@query(", n as (select label, len(words) as k from w) select label, round(quantile_cont(k, 0.5), 4) as median, round(quantile_cont(k, 0.75), 4) as p75, round(quantile_cont(k, 0.9), 4) as p90, round(avg(k), 4) as mean, round(avg((k > 256)::int), 6) as share_over from n group by 1")
def length_by_class(spark, sf_dir):
    n = words(spark, sf_dir).select("label", F.size("words").alias("k"))
    p = [F.round(F.percentile("k", F.lit(q)), 4).alias(a) for a, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))]
    return n.groupBy("label").agg(*p, F.round(F.avg("k"), 4).alias("mean"), F.round(F.avg((F.col("k") > 256).cast("int")), 6).alias("share_over"))


@query(", n as (select len(words) as k from w), m as (select unnest([64, 128, 256, 512]) as max_len) select max_len, round(100.0 * count(*) filter (k > max_len) / count(*), 1) as truncated_pct, round(100.0 * sum(least(k, max_len)) / sum(k), 1) as tokens_kept_pct from n, m group by 1")
def truncation_table(spark, sf_dir):
    return profile.truncation_table(words(spark, sf_dir).select(F.size("words").alias("k")), "k", [64, 128, 256, 512])


@query(", n as (select len(words) as k from w), m as (select unnest([50, 100, 150, 200, 300, 400]) as length) select length, round(count(*) filter (k <= length) / count(*), 6) as share from n, m group by 1")
def length_ecdf(spark, sf_dir):
    return profile.length_ecdf(words(spark, sf_dir).select(F.size("words").alias("k")), "k", [50, 100, 150, 200, 300, 400])


def _q(p: str) -> str:
    return p.replace("'", "''")


@query("\nunion all\n".join(f"select '{k}' as artifact, count(*) filter (regexp_matches(text, '{_q(p)}')) as docs, round(100.0 * count(*) filter (regexp_matches(text, '{_q(p)}')) / count(*), 2) as pct from d" for k, p in T.ARTIFACTS.items()))
def artifact_counts(spark, sf_dir):
    return profile.artifact_counts(first_rows(spark, sf_dir), "text")


@query(r"select row_id, len(regexp_extract_all(text, '\bX{2,}\b')) as redactions, len(regexp_extract_all(text, '\{\$[\d.,]+\}')) as amounts from d")
def pattern_counts(spark, sf_dir):
    d = first_rows(spark, sf_dir)
    return d.select("row_id", *[F.regexp_count("text", F.lit(T.ARTIFACTS[k])).cast("long").alias(a) for k, a in (("XXXX redaction", "redactions"), ("{$...} amount", "amounts"))])


@query(r", r as (select x.label, len(regexp_extract_all(text, '\bX{2,}\b')) as k, len(words) as n from x join w using (row_id)) select label, round(100.0 * avg((k > 0)::int), 4) as has_pct, round(avg(k), 4) as mean, round(quantile_cont(k, 0.5), 4) as median, round(quantile_cont(100.0::double * k / nullif(n, 0), 0.5), 4) as median_density from r group by 1")
def redaction_by_class(spark, sf_dir):
    d = labelled(spark, sf_dir).select("label", F.regexp_count("text", F.lit(T.ARTIFACTS["XXXX redaction"])).alias("k"), F.size(T.split_words(F.col("text"))).alias("n"))
    d = d.withColumn("density", F.try_divide(F.lit(100.0) * F.col("k"), F.col("n")))
    return d.groupBy("label").agg(F.round(100.0 * F.avg((F.col("k") > 0).cast("int")), 4).alias("has_pct"), F.round(F.avg("k"), 4).alias("mean"), F.round(F.percentile("k", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("density", F.lit(0.5)), 4).alias("median_density"))


@query(
    r""", b as (select row_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda q: q <> '') as ws from d),
t as (select row_id, max(n) as top from (select row_id, u, count(*) as n from (select row_id, unnest(ws) as u from b) group by 1, 2) group by 1)
select 'top_word_over_30pct' as counter, count(*) filter (top / len(ws) > 0.30) as docs from b join t using (row_id)
union all select 'uppercase_over_60pct', count(*) filter (len(regexp_extract_all(text, '[A-Z]')) / nullif(length(text), 0) > 0.60) from b
union all select 'digits_over_20pct', count(*) filter (len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0) > 0.20) from b
union all select 'under_10_words', count(*) filter (len(ws) < 10) from b union all select 'over_1000_words', count(*) filter (len(ws) > 1000) from b"""
)
def noise_counters(spark, sf_dir):
    return profile.noise_counters(first_rows(spark, sf_dir), "text")


@query("\nunion all\n".join(f"select '{k}' as label, round(100 * avg(regexp_matches(lower(text), '{p}')::int) filter (label = '{k}'), 1) as in_class_pct, round(100 * avg(regexp_matches(lower(text), '{p}')::int) filter (label <> '{k}'), 1) as elsewhere_pct from x" for k, p in T.CUES.items()))
def cue_precision(spark, sf_dir):
    return profile.cue_precision(labelled(spark, sf_dir), "text", "label")


@query(
    r""", s as (select row_id, regexp_extract(text, '(?s)\Ab''(.*)''\n?\z', 1) as a, regexp_extract(text, '(?s)\Ab"(.*)"\n?\z', 1) as b, regexp_matches(text, '(?s)\A(b''.*''|b".*")\n?\z') as hit, text from c)
select row_id, md5(case when not hit then text else replace(replace(replace(case when text[2] = '''' then a else b end, '\n', chr(10)), '\''', ''''), '\"', '"') end) as bare_md5, hit as wrapped from s"""
)
def strip_wrapper(spark, sf_dir):
    c = complaints(spark, sf_dir)
    return c.select("row_id", F.md5(T.strip_wrapper(F.col("text")).cast("binary")).alias("bare_md5"), F.col("text").rlike(r"(?sd)^b(?:'.*'|\".*\")$").alias("wrapped"))


@query(r"select row_id, substr(regexp_replace(regexp_replace(text, '\S+@\S+\.\w+', '[email]', 'g'), '[0-9]{6,}', '[number]', 'g'), 1, 180) as excerpt from d")
def mask_pii_excerpt(spark, sf_dir):
    return first_rows(spark, sf_dir).select("row_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("select label, split_part(split_part(label, ',', 1), ' or ', 1) as short from labels", views=False)
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("label", T.short_label(F.col("label")).alias("short"))


@query("select count(*) as n, count(distinct row_id) = count(*) as unique_ids, count(*) filter (text is null) = 0 as no_null_text, count(*) filter (\"Product\" is null) = 0 as no_null_label from c")
def combine_invariants(spark, sf_dir):
    c = complaints(spark, sf_dir)
    ids = c.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("text").isNull()).alias("t"), F.count_if(F.col("Product").isNull()).alias("p"))
    return ids.agg(F.sum("k").alias("n"), (F.sum("k") == F.count(F.lit(1))).alias("unique_ids"), (F.sum("t") == 0).alias("no_null_text"), (F.sum("p") == 0).alias("no_null_label"))


@query("select d.row_id, l.class_id, l.short_name from d join l on l.lkey = d.pkey where l.class_id is not null")
def class_ids(spark, sf_dir):
    from corpuslab.functions.labels import class_ids as ids

    names = table(spark, sf_dir, "labels")
    d = labelled(spark, sf_dir).select("row_id", "label", "short_name")
    return ids(d, "label", names).select("row_id", "class_id", "short_name")


@query(", n as (select label, count(*) as n from x group by 1) select max(n) as largest, min(n) as smallest, round(max(n) / min(n), 6) as ratio from n")
def class_ratio(spark, sf_dir):
    n = labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.round(F.try_divide(F.max("n"), F.min("n")), 6).alias("ratio"))


@query("select row_id from d order by md5(row_id || '-42'), row_id limit 100")
def hash_sample(spark, sf_dir):
    """A sample of fixed size in the order of a hash, the same on every run."""
    return first_rows(spark, sf_dir).select("row_id").orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit("-42")).cast("binary")), "row_id").limit(100)


@query(", r as (select row_id, label, row_number() over (partition by label order by md5(row_id || '-7')) - 1 as r, count(*) over (partition by label) as n from x) select row_id, label, case when r < floor(n * 0.8) then 'train' else 'test' end as part from r")
def stratified_split(spark, sf_dir):
    """Four fifths of each class by hash, without groups."""
    from corpuslab.operators.vocab import ranked

    x = labelled(spark, sf_dir).select("row_id", "label").withColumn("h", F.md5(F.concat(F.col("row_id").cast("string"), F.lit("-7")).cast("binary")))
    r = ranked(x, [F.asc("label"), F.asc("h")])
    n = r.groupBy("label").agg(F.min("rank").alias("lo"), F.count(F.lit(1)).alias("n"))
    return r.join(small(n), "label").select("row_id", "label", F.when(F.col("rank") - F.col("lo") < F.floor(F.col("n") * 0.8), "train").otherwise("test").alias("part"))


@query("select d.row_id, d.text = c.text as same from d join c using (row_id) where d.row_id in (select row_id from x)")
def positional_select(spark, sf_dir):
    """Rows by their ids, as a join with the table of ids."""
    ids = labelled(spark, sf_dir).select("row_id")
    a = first_rows(spark, sf_dir).join(ids, "row_id", "left_semi").select("row_id", F.col("text").alias("a"))
    return a.join(complaints(spark, sf_dir).select("row_id", F.col("text").alias("b")), "row_id").select("row_id", (F.col("a") == F.col("b")).alias("same"))


@query("select 'raw' as part, pkey as product, count(*) as n from c group by all union all select 'dedup', pkey, count(*) from d group by all")
def keyed_union(spark, sf_dir):
    n = lambda df: df.groupBy(F.col("pkey").alias("product")).agg(F.count(F.lit(1)).alias("n"))
    return profile.union_all([n(complaints(spark, sf_dir)), n(first_rows(spark, sf_dir))], "part", ["raw", "dedup"])

"""TF-IDF, similarity joins and clusters over the labelled complaints, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import cosine, tfidf
from corpuslab.plans.core import complaints, first_ids, first_rows, labelled, query, table
from corpuslab.session import Stage

THRESHOLD = 0.7

_BARE = "lower(translate(text, '{}', '{}'))".format(*T.accents())
_P = rf""", tc as (select row_id as doc, unnest(regexp_extract_all({_BARE}, '[\p{{L}}\p{{N}}_]{{2,}}')) as term from d),
tf as (select doc, term, count(*) as tf from tc group by 1, 2), nn as (select count(*) as n from d),
df as (select term, count(*) as df from tf group by 1 having count(*) >= 3),
wt as (select doc, term, (1 + ln(tf)) * (ln((1.0::double + n) / (1.0::double + df)) + 1) as w from tf join df using (term), nn),
post as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as w from wt)"""
_PAIRS = _P + ", pairs as (select a.doc as a, b.doc as b, sum(a.w * b.w) as cos from post a join post b on a.term = b.term and a.doc < b.doc group by 1, 2 having sum(a.w * b.w) >= 0.7)"
_CL = _PAIRS + """, sym as (select a, b from pairs union select b, a from pairs), reach(n, r) as (select row_id, row_id from d union select reach.n, sym.b from reach join sym on reach.r = sym.a),
cl as (select n as row_id, min(r) as root from reach group by 1)"""


def _terms():
    """Terms of a text without accents."""
    return T.terms(T.strip_accents(F.col("text")))


def _postings(spark, sf_dir, min_df: int = 3):
    d = Stage(spark, "postings").put(first_rows(spark, sf_dir).select("row_id", "text"))
    return tfidf.weigh(tfidf.term_counts(d, "row_id", _terms()), tfidf.fit(d, _terms(), d.count(), min_df))


@query(_P + "select doc, term, round(w, 9) as w from post")
def tfidf_weights(spark, sf_dir):
    return _postings(spark, sf_dir).select("doc", "term", F.round("w", 9).alias("w"))


def _pairs(spark, sf_dir):
    stage = Stage(spark, "vectors")
    d = first_rows(spark, sf_dir).select("row_id", _terms().alias("terms"))
    groups = stage.put(cosine.coded(d, "row_id", "terms"), "coded", "zstd")
    model = stage.put(tfidf.fit_coded(groups, 3))
    v = cosine.of_coded(groups, model)
    if v is None:
        v = cosine.of_postings(tfidf.weigh(tfidf.term_counts(d, "row_id", "terms"), model))
    found = cosine.pairs(v, THRESHOLD)
    stage.only()
    return found


@query(_PAIRS + "select a, b, round(cos, 6) as cos from pairs")
def near_dup_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round("cos", 6).alias("cos"))


def _clusters(spark, sf_dir):
    return tfidf.clusters(first_ids(spark, sf_dir), "row_id", _pairs(spark, sf_dir))


@query(_CL + "select row_id, root, dense_rank() over (order by root) - 1 as cluster_id from cl")
def near_dup_clusters(spark, sf_dir):
    from corpuslab.operators.vocab import ranked

    c = _clusters(spark, sf_dir)
    ids = ranked(c.select("root").distinct(), [F.asc("root")]).select("root", (F.col("rank") - 1).alias("cluster_id"))
    return c.join(ids, "root").select("row_id", "root", "cluster_id")


@query(
    _CL
    + ", s as (select root, count(*) as n from cl group by 1) select count(*) as clusters, count(*) filter (n = 1) as singletons, count(*) filter (n > 1) as multi, coalesce(sum(n) filter (n > 1), 0)::bigint as multi_rows, round(100.0 * coalesce(sum(n) filter (n > 1), 0) / sum(n), 2) as multi_pct, floor(quantile_cont(n, 0.5) filter (n > 1))::bigint as median, floor(quantile_cont(n, 0.9) filter (n > 1))::bigint as p90, floor(quantile_cont(n, 0.95) filter (n > 1))::bigint as p95, floor(quantile_cont(n, 0.99) filter (n > 1))::bigint as p99, max(n) as largest from s"
)
def cluster_stats(spark, sf_dir):
    s = _clusters(spark, sf_dir).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    multi = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return s.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") > 1).alias("multi"),
        multi.alias("multi_rows"),
        F.round(100.0 * multi / F.sum("n"), 2).alias("multi_pct"),
        *[F.floor(F.percentile(F.when(F.col("n") > 1, F.col("n")), F.lit(q))).alias(k) for k, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))],
        F.max("n").alias("largest"),
    )


@query(_CL + ", s as (select root, count(*) as n from cl group by 1) select case when n > 10 then '>10' else n::varchar end as size, count(*) as clusters from s group by 1")
def cluster_histogram(spark, sf_dir):
    s = _clusters(spark, sf_dir).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy(F.when(F.col("n") > 10, ">10").otherwise(F.col("n").cast("string")).alias("size")).agg(F.count(F.lit(1)).alias("clusters"))


@query(_CL + "select root, count(distinct d.pkey) as labels, count(*) as n from cl join d using (row_id) group by 1 having count(distinct d.pkey) > 1")
def mixed_clusters(spark, sf_dir):
    c = _clusters(spark, sf_dir).join(complaints(spark, sf_dir).select("row_id", "pkey"), "row_id")
    return c.groupBy("root").agg(F.count_distinct("pkey").alias("labels"), F.count(F.lit(1)).alias("n")).filter("labels > 1")


@query(
    _PAIRS
    + ", best as (select q, max(cos) as best from (select a as q, cos from pairs union all select b, cos from pairs) group by 1), t as (select unnest([0.7, 0.8, 0.9]::double[]) as threshold) select threshold, round(100.0 * count(*) filter (best >= threshold) / count(*), 4) as rate_pct from (select d.row_id, coalesce(best, 0) as best from d left join best on q = d.row_id), t group by 1"
)
def near_dup_rate(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    best = p.select(F.explode(F.array("a", "b")).alias("row_id"), "cos").groupBy("row_id").agg(F.max("cos").alias("best"))
    every = first_ids(spark, sf_dir).join(best, "row_id", "left")
    ts = [0.7, 0.8, 0.9]
    a = every.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("best") >= t).alias(f"t{i}") for i, t in enumerate(ts)])
    return a.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(100.0 * F.try_divide(f"t{i}", "n"), 4).alias("rate_pct")) for i, t in enumerate(ts)])).alias("x")).select("x.*")


_BENCH = rf""", bt as (select item_id as doc, unnest(regexp_extract_all({_BARE}, '[\p{{L}}\p{{N}}_]{{2,}}')) as term from benchmark where text is not null), btf as (select doc, term, count(*) as tf from bt group by 1, 2),
bw as (select doc, term, (1 + ln(tf)) * (ln((1.0::double + n) / (1.0::double + df)) + 1) as w from btf join df using (term), nn), bp as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as w from bw)"""


@query(_P + _BENCH + ", s as (select bp.doc as q, post.doc, sum(bp.w * post.w) as cos from bp join post using (term) group by 1, 2) select q as item_id, round(max(cos), 6) as best from s group by 1")
def max_similarity_benchmark(spark, sf_dir):
    """Each held-out passage and its nearest complaint, by the model fitted on the complaints."""
    d = Stage(spark, "postings").put(first_rows(spark, sf_dir).select("row_id", "text"))
    model = tfidf.fit(d, _terms(), d.count(), 3)
    b = table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", "text")
    q = tfidf.weigh(tfidf.term_counts(b, "item_id", _terms()), model)
    return tfidf.max_similarity(q, tfidf.weigh(tfidf.term_counts(d, "row_id", _terms()), model)).select(F.col("doc").alias("item_id"), F.round("best", 6).alias("best"))


@query(
    "with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 0), i as (select vec_id, embedding::double[] as e from embeddings) select q.vec_id, round(max(list_cosine_similarity(q.e, i.e)), 6) as best from q join i on q.vec_id <> i.vec_id group by 1",
    views=False,
)
def max_similarity_dense(spark, sf_dir):
    """Vectors whose id is divisible by 20 as queries against all others, in blocks."""
    from corpuslab.operators.dense import max_cosine

    e = table(spark, sf_dir, "embeddings")
    return max_cosine(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").withColumn("best", F.round("best", 6))


@query(
    r""", lt as (select x.label, tf.term, sum(tf) as n from tf0 tf join x on x.row_id = tf.doc group by 1, 2) select label, term, n::bigint as n, row_number() over (partition by label order by n desc, term) as rank from lt qualify rank <= 12""".replace(
        ", lt as", r""", tc as (select row_id as doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from d), tf0 as (select doc, term, count(*) as tf from tc group by 1, 2), lt as"""
    )
)
def top_terms_by_class(spark, sf_dir):
    """The k most frequent terms of each class."""
    x = labelled(spark, sf_dir)
    n = x.select("label", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "term")).cast("long")).filter("rank <= 12")


_BEST = _PAIRS.replace(">= 0.7)", ">= 0.5)") + ", best as (select q, max(cos) as best from (select a as q, cos from pairs union all select b, cos from pairs) group by 1)"


@query(_BEST + ", e as (select d.row_id, d.pkey as product, coalesce(best, 0) as best from d left join best on q = d.row_id) select product, count(*) as n, round(100.0 * count(*) filter (best >= 0.7) / count(*), 4) as rate_pct from e group by 1")
def near_dup_rate_by_class(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("row_id")).distinct().withColumn("near", F.lit(True))
    e = first_rows(spark, sf_dir).select("row_id", F.col("pkey").alias("product")).join(p, "row_id", "left")
    return e.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count("near") / F.count(F.lit(1)), 4).alias("rate_pct"))


@query(
    _BEST
    + """, p0 as (select * from predictions qualify row_number() over (partition by experiment, seed, test_idx order by logged_at desc, y_true desc, y_pred desc nulls last) = 1),
e as (select p0.experiment, p0.seed, y_true, y_pred, case when b >= 0.9 then '0.9-1.0' when b >= 0.8 then '0.8-0.9' when b >= 0.7 then '0.7-0.8' when b >= 0.6 then '0.6-0.7' when b >= 0.5 then '0.5-0.6' else 'below 0.5' end as band from p0 join (select d.row_id, coalesce(best, 0) as b from d left join best on q = d.row_id) on row_id = test_idx where y_pred is not null),
ids as (select unnest(range(5))::int as i), pc as (select experiment, seed, band, i, count(*) filter (y_true = i) as s, count(*) filter (y_pred = i) as q, count(*) filter (y_true = i and y_pred = i) as tp from e, ids group by all)
select experiment, seed, band, sum(s)::bigint as n, round(avg(2.0::double * tp / (s + q)) filter (s + q > 0), 9) as macro_f1 from pc group by all"""
)
def similarity_bands(spark, sf_dir):
    """Macro-F1 of test rows by the cosine of the nearest other text: the test rows are queries against all."""
    from corpuslab.operators import evaluate

    b = F.col("best")
    band = F.when(b >= 0.9, "0.9-1.0").when(b >= 0.8, "0.8-0.9").when(b >= 0.7, "0.7-0.8").when(b >= 0.6, "0.6-0.7").when(b >= 0.5, "0.5-0.6").otherwise("below 0.5")
    p = evaluate.latest(table(spark, sf_dir, "predictions"), ["experiment", "seed", "test_idx"], ["logged_at"]).filter("y_pred is not null")
    posts = Stage(spark, "bands").put(_postings(spark, sf_dir))
    q = posts.join(p.select(F.col("test_idx").alias("doc")).distinct(), "doc", "left_semi")
    best = first_rows(spark, sf_dir).select(F.col("row_id").alias("test_idx")).join(tfidf.max_similarity(q, posts, exclude_self=True).withColumnRenamed("doc", "test_idx"), "test_idx", "left")
    e = p.join(best.withColumn("best", F.coalesce("best", F.lit(0.0))).select("test_idx", band.alias("band")), "test_idx")
    by = ["experiment", "seed", "band"]
    m = evaluate.macro(evaluate.per_class(evaluate.confusion(e, by, 5), by), by)
    return m.select(*by, "n", F.round("macro_f1", 9).alias("macro_f1"))


@query(
    _PAIRS
    + """, tst as (select distinct test_idx from predictions), near as (select q, max(cos) as best from (select a as q, b as o, cos from pairs union all select b, a, cos from pairs) where q in (from tst) and o not in (from tst) group by 1),
p0 as (select * from predictions qualify row_number() over (partition by experiment, seed, test_idx order by logged_at desc, y_true desc, y_pred desc nulls last) = 1),
e as (select p0.experiment, p0.seed, y_true, y_pred, threshold, coalesce(best, 0) >= threshold as hit from p0 join d on d.row_id = test_idx left join near on q = test_idx, (select unnest([0.8, 0.9, 0.95]::double[]) as threshold) where y_pred is not null),
ids as (select unnest(range(5))::int as i), pc as (select experiment, seed, threshold, hit, i, count(*) filter (y_true = i) as s, count(*) filter (y_pred = i) as q, count(*) filter (y_true = i and y_pred = i) as tp from e, ids group by all),
m as (select experiment, seed, threshold, hit, sum(s)::bigint as n, avg(2.0::double * tp / (s + q)) filter (s + q > 0) as f from pc group by all)
select experiment, seed, threshold, coalesce(sum(n) filter (hit), 0)::bigint as contaminated, round(100.0 * coalesce(sum(n) filter (hit), 0) / sum(n), 2) as pct, round(max(f) filter (hit), 9) as f1_contaminated, round(max(f) filter (not hit), 9) as f1_clean from m group by all"""
)
def contamination_by_threshold(spark, sf_dir):
    """Macro-F1 apart for test rows that have a near-duplicate among the rows outside the test set, by the cosine that counts as near."""
    from corpuslab.operators import evaluate
    from corpuslab.operators.joins import small

    p = evaluate.latest(table(spark, sf_dir, "predictions"), ["experiment", "seed", "test_idx"], ["logged_at"])
    test = small(p.select("test_idx").distinct())
    x = _pairs(spark, sf_dir)
    x = x.select(F.explode(F.array(F.struct(F.col("a").alias("q"), F.col("b").alias("o")), F.struct(F.col("b").alias("q"), F.col("a").alias("o")))).alias("x"), "cos").select("x.*", "cos")
    x = x.join(test, F.col("q") == F.col("test_idx"), "left_semi").join(test, F.col("o") == F.col("test_idx"), "left_anti")
    best = x.groupBy(F.col("q").alias("test_idx")).agg(F.max("cos").alias("best"))
    e = p.filter("y_pred is not null").join(first_ids(spark, sf_dir).withColumnRenamed("row_id", "test_idx"), "test_idx").join(best, "test_idx", "left")
    e = e.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.8, 0.9, 0.95))))).withColumn("hit", F.coalesce("best", F.lit(0.0)) >= F.col("threshold"))
    by = ["experiment", "seed", "threshold", "hit"]
    m = evaluate.macro(evaluate.per_class(evaluate.confusion(e, by, 5), by), by)
    n = F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0))
    return m.groupBy("experiment", "seed", "threshold").agg(
        n.alias("contaminated"),
        F.round(100.0 * n / F.sum("n"), 2).alias("pct"),
        F.round(F.max(F.when(F.col("hit"), F.col("macro_f1"))), 9).alias("f1_contaminated"),
        F.round(F.max(F.when(~F.col("hit"), F.col("macro_f1"))), 9).alias("f1_clean"),
    )

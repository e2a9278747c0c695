"""Vocabulary, sequences, coverage and term statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import vocab
from corpuslab.plans.core import query, table, words

_V = ", t as (select row_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from w), v as (select word, count(*) as n, count(distinct row_id) as docs, min(row_id * 1000000 + pos) as first from t group by 1)"
_I = _V + ", i as (select word, n, row_number() over (order by n desc, first) + 1 as idx from v)"
_B = r""", bw as (select distinct unnest(list_filter(string_split(translate(lower(text), '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 34)), ' '), lambda q: q <> '')) as word from benchmark where text is not null)"""


def _counts(spark, sf_dir):
    return vocab.word_counts(words(spark, sf_dir), "row_id", "words")


def _known(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").filter("text is not null")
    return b.select(F.explode(T.split_words(F.col("text"))).alias("word")).distinct()


@query(_V + "select word, n, docs from v order by n desc, word limit 50")
def vocab_topk(spark, sf_dir):
    return _counts(spark, sf_dir).select("word", "n", "docs").orderBy(F.desc("n"), "word").limit(50)


@query(_V + "select count(*) as types, sum(n)::bigint as tokens, count(*) filter (n = 1) as hapax, round(100.0 * count(*) filter (n = 1) / count(*), 2) as hapax_pct from v")
def vocab_stats(spark, sf_dir):
    return _counts(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("hapax"), F.round(100.0 * F.count_if(F.col("n") == 1) / F.count(F.lit(1)), 2).alias("hapax_pct")
    )


@query(_V + ", r as (select n, row_number() over (order by n desc, word) as rank from v), k as (select unnest([100, 500, 1000, 2000]) as size) select size, round(100.0 * sum(n) filter (rank <= size) / sum(n), 2) as corpus_pct from r, k group by 1")
def vocab_coverage_curve(spark, sf_dir):
    r = vocab.ranked(_counts(spark, sf_dir).select("word", "n"), [F.desc("n"), F.asc("word")])
    sizes = [100, 500, 1000, 2000]
    a = r.agg(F.sum("n").alias("t"), *[F.sum(F.when(F.col("rank") <= s, F.col("n"))).alias(f"s{s}") for s in sizes])
    return a.select(F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.round(100.0 * F.try_divide(f"s{s}", "t"), 2).alias("corpus_pct")) for s in sizes])).alias("x")).select("x.*")


@query(_I + "select word, n, idx::int as idx from i")
def word_index(spark, sf_dir):
    return vocab.word_index(_counts(spark, sf_dir))


@query(_I + "select t.row_id, list(case when i.idx < 2000 then i.idx else 1 end::int order by pos) as seq from t join i using (word) group by 1 union all select row_id, []::int[] from w where len(words) = 0")
def texts_to_sequences(spark, sf_dir):
    df = words(spark, sf_dir)
    return vocab.to_sequences(df, "row_id", "words", vocab.word_index(vocab.word_counts(df, "row_id", "words")), 2000)


_S = _I + ", s as (select t.row_id, list(case when i.idx < 2000 then i.idx else 1 end::int order by pos) as seq from t join i using (word) group by 1 union all select row_id, []::int[] from w where len(words) = 0)"


@query(_S + "select row_id, list_concat(list_transform(range(greatest(0, 128 - len(seq))), lambda q: 0), seq[1:128])::int[] as padded from s")
def pad_pre_post(spark, sf_dir):
    return texts_to_sequences(spark, sf_dir).select("row_id", T.pad(F.col("seq"), 128, "pre", "post").alias("padded"))


@query(_S + "select row_id, list_concat(seq[greatest(len(seq) - 127, 1):], list_transform(range(greatest(0, 128 - len(seq))), lambda q: 0))::int[] as padded from s")
def pad_post_pre(spark, sf_dir):
    return texts_to_sequences(spark, sf_dir).select("row_id", T.pad(F.col("seq"), 128, "post", "pre").alias("padded"))


@query(
    _V
    + _B
    + """, r as (select v.word, n, row_number() over (order by n desc, v.word) as rank, bw.word is not null as hit from v left join bw using (word)), k as (select unnest([100, 500, 1000, 0]) as size), cs as (select sum(n) as corpus from v)
select size::int as size, round(100.0 * count(*) filter (hit) / count(*), 1) as type_pct, round(100.0 * coalesce(sum(n) filter (hit), 0) / sum(n), 2) as token_pct, round(100.0 * sum(n) / any_value(corpus), 2) as corpus_pct from r, k, cs where size = 0 or rank <= size group by 1"""
)
def pretrained_coverage(spark, sf_dir):
    return vocab.coverage(_counts(spark, sf_dir), _known(spark, sf_dir), [100, 500, 1000, 0])


@query(_V + _B + ", r as (select word, n from v order by n desc, word limit 500) select word, n from r anti join bw using (word) order by n desc, word limit 25")
def missing_terms(spark, sf_dir):
    return vocab.missing_terms(_counts(spark, sf_dir), _known(spark, sf_dir), 500, 25)


# the vocabulary is learned from the training part alone, which a hash of the id decides
_TRAIN = "('0x' || substr(md5(row_id::varchar), 1, 2))::int < 204"


def _is_train():
    return F.conv(F.substring(F.md5(F.col("row_id").cast("string").cast("binary")), 1, 2), 16, 10).cast("int") < 204


@query(
    f", t as (select row_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos, {_TRAIN} as train from w), v as (select word, count(*) as n, min(row_id * 1000000 + pos) as first from t where train group by 1), i as (select word, row_number() over (order by n desc, first) + 1 as idx from v), o as (select t.train, i.idx from t left join i using (word)) select case when train then 'train' else 'held_out' end as part, count(*) as tokens, count(*) filter (idx is null or idx >= 2000) as unknown, round(count(*) filter (idx is null or idx >= 2000) / count(*), 6) as rate from o group by 1"
)
def oov_rate(spark, sf_dir):
    df = words(spark, sf_dir)
    train = df.filter(_is_train())
    index = vocab.word_index(vocab.word_counts(train, "row_id", "words"))
    a = vocab.oov_rate(train, "row_id", "words", index, 2000).withColumn("part", F.lit("train"))
    return a.unionByName(vocab.oov_rate(df.filter(~_is_train()), "row_id", "words", index, 2000).withColumn("part", F.lit("held_out")))


@query(_I + _B + "select count(*) as vocab_size, count(*) filter (bw.word is not null) as matched, count(*) - count(*) filter (bw.word is not null) as unmatched, round(100.0 * count(*) filter (bw.word is not null) / count(*), 2) as matched_pct from i left join bw using (word) where idx < 2000")
def embedding_coverage(spark, sf_dir):
    index = vocab.word_index(_counts(spark, sf_dir)).filter("idx < 2000")
    e = vocab.embedding_rows(index, _word_vectors(spark, sf_dir), 4)
    return e.agg(F.count(F.lit(1)).alias("vocab_size"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), F.round(100.0 * F.count_if("matched") / F.count(F.lit(1)), 2).alias("matched_pct"))


def _word_vectors(spark, sf_dir):
    """Vectors of the benchmark's words, four digits of their MD5 each."""
    digit = lambda i: (F.conv(F.substring(F.md5(F.col("word").cast("binary")), i, 1), 16, 10).cast("int") / 16.0).cast("float")
    return _known(spark, sf_dir).select("word", F.array(*[digit(i) for i in range(1, 5)]).alias("vec"))


@query(_I + _B + "select idx::int as idx, word, list_transform([1, 2, 3, 4], lambda q: (('0x' || substr(md5(word), q, 1))::int / 16.0)::double) as vec from i join bw using (word) where idx < 2000")
def embedding_matrix(spark, sf_dir):
    """Rows of the embedding matrix that come from pretrained vectors."""
    e = vocab.embedding_rows(vocab.word_index(_counts(spark, sf_dir)).filter("idx < 2000"), _word_vectors(spark, sf_dir), 4)
    return e.filter("matched").select("idx", "word", F.col("vec").cast("array<double>").alias("vec"))


@query(_S + ", lens as (select unnest([128, 256]) as max_len) select max_len, count(*) as n, count(*) filter (len(seq) >= max_len) as full_windows, round(100.0 * count(*) filter (len(seq) >= max_len) / count(*), 2) as full_pct, round(100.0 * count(*) filter (len(seq) > max_len) / count(*), 2) as truncated_pct from s, lens group by 1")
def full_windows(spark, sf_dir):
    """Rows whose mask is set throughout, a stand-in for truncation where only masks are kept, beside those that are truncated."""
    s = texts_to_sequences(spark, sf_dir)
    size = F.size("seq")
    some = []
    for n in (128, 256):
        mask = F.aggregate(F.transform(T.pad(F.col("seq"), n, "post", "post"), lambda x: (x > 0).cast("int")), F.lit(0), lambda a, x: a + x)
        some.append(F.struct(F.lit(n).alias("max_len"), (mask == n).alias("full"), (size > n).alias("cut")))
    x = s.select(F.explode(F.array(*some)).alias("x")).select("x.*").groupBy("max_len").agg(F.count(F.lit(1)).alias("n"), F.count_if("full").alias("full_windows"), F.count_if("cut").alias("cut"))
    return x.select("max_len", "n", "full_windows", F.round(100.0 * F.col("full_windows") / F.col("n"), 2).alias("full_pct"), F.round(100.0 * F.col("cut") / F.col("n"), 2).alias("truncated_pct"))


@query(_V + _B + ", parts as (select part as word, sum(n) as n from (select unnest(list_filter(string_split(word, chr(39)), lambda q: len(q) > 0)) as part, n from v) group by 1), both_ as (select 'whole' as words, word, n from v union all select 'split at apostrophes', word, n from parts) select words, round(100.0 * count(*) filter (bw.word is not null) / count(*), 1) as type_pct, round(100.0 * coalesce(sum(n) filter (bw.word is not null), 0) / sum(n), 2) as token_pct from both_ left join bw using (word) group by 1")
def apostrophe_coverage(spark, sf_dir):
    """Coverage by known words as they are, and with words split at apostrophes."""
    c = _counts(spark, sf_dir).select("word", "n")
    parts = c.select(F.explode(F.filter(F.split("word", "'"), lambda p: p != "")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    both = c.withColumn("words", F.lit("whole")).unionByName(parts.withColumn("words", F.lit("split at apostrophes")))
    j = both.join(_known(spark, sf_dir).withColumn("hit", F.lit(True)), "word", "left")
    hit = F.col("hit").isNotNull()
    return j.groupBy("words").agg(F.round(100.0 * F.count_if(hit) / F.count(F.lit(1)), 1).alias("type_pct"), F.round(100.0 * F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)) / F.sum("n"), 2).alias("token_pct"))


_BI = ", g as (select row_id, label, list_transform(range(1, len(words)), lambda q: words[q] || ' ' || words[q + 1]) as gs from w), b as (select row_id, label, unnest(gs) as gram from g)"


@query(_BI + "select gram, count(distinct row_id) as docs from b group by 1 having count(distinct row_id) >= 20")
def bigrams_df(spark, sf_dir):
    df = words(spark, sf_dir)
    g = df.select("row_id", F.explode(F.array_distinct(T.bigrams(F.col("words")))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).filter("docs >= 20")


_LN = ", t as (select row_id, label, unnest(words) as word from w), keep as (select word from t group by 1 having count(distinct row_id) >= 20 order by count(*) desc, word limit 30000), n as (select label, word, count(*) as n from t semi join keep using (word) group by 1, 2)"


def _class_counts(spark, sf_dir):
    per = vocab.exploded(words(spark, sf_dir).withColumn("k", F.struct("row_id", "label")), "k", "words").groupBy(F.col("k.row_id").alias("row_id"), F.col("k.label").alias("label"), "word").agg(F.count(F.lit(1)).alias("n"))
    keep = per.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("k")).filter("docs >= 20")
    keep = keep.orderBy(F.desc("k"), "word").limit(30_000).select("word")  # the feature limit of the bag of words
    return per.groupBy("label", "word").agg(F.sum("n").alias("n")).join(F.broadcast(keep), "word", "left_semi")


@query(
    _LN
    + ", total as (select word, sum(n) as a from n group by 1), ins as (select label, sum(n) as s from n group by 1), g as (select sum(n) as g from n), p as (select ins.label, total.word, coalesce(n.n, 0) as n, a, s, g from total cross join ins cross join g left join n on n.word = total.word and n.label = ins.label), sc as (select label, word, round(ln((n + 1) / (s + 1)) - ln((a - n + 1) / (g - s + 1)), 6) as score from p) select *, row_number() over (partition by label order by score desc, word) as rank from sc qualify rank <= 20"
)
def log_odds_terms(spark, sf_dir):
    return vocab.log_odds(_class_counts(spark, sf_dir), "label", 20)


@query(
    _LN
    + ", r as (select label, word from n qualify row_number() over (partition by label order by n desc, word) <= 200), sets as (select label, list(word) as ws from r group by 1) select a.label as a, b.label as b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) as jaccard from sets a cross join sets b"
)
def class_jaccard(spark, sf_dir):
    w = Window.partitionBy("label").orderBy(F.desc("n"), "word")
    sets = _class_counts(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 200").groupBy("label").agg(F.collect_set("word").alias("ws"))
    every = sets.agg(F.collect_list(F.struct("label", "ws")).alias("s"))  # one entry per label
    pairs = every.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y"))
    j = F.size(F.array_intersect("x.ws", "y.ws")) / F.size(F.array_union("x.ws", "y.ws"))
    return pairs.select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), F.round(j, 6).alias("jaccard"))

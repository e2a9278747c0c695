import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import dedup, profile, split, tfidf, vocab
from corpuslab.session import Stage


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("words", T.split_words(F.col("text")))


def index(spark, texts, oov=True):
    return {r.word: r.idx for r in vocab.word_index(vocab.word_counts(corpus(spark, texts), "row_id", "words"), oov).collect()}


def test_index_order(spark):
    assert index(spark, ["a a a b b c", "a b"], oov=False) == {"a": 1, "b": 2, "c": 3}
    assert index(spark, ["zebra apple mango"], oov=False) == {"zebra": 1, "apple": 2, "mango": 3}
    assert index(spark, ["a a b"]) == {"a": 2, "b": 3}


def test_sequences(spark):
    df = corpus(spark, ["a a a a a b b b b c c c d", "", "d z"])
    ix = vocab.word_index(vocab.word_counts(df.filter("row_id = 0"), "row_id", "words"))
    test = corpus(spark, ["a b c d", "", "z"])
    got = {r.row_id: r.seq for r in vocab.to_sequences(test, "row_id", "words", ix, 3).collect()}
    assert got == {0: [2, 1, 1, 1], 1: [], 2: [1]}
    plain = vocab.word_index(vocab.word_counts(df.filter("row_id = 0"), "row_id", "words"), oov=False)
    assert {r.row_id: r.seq for r in vocab.to_sequences(test, "row_id", "words", plain, None, False).collect()} == {0: [1, 2, 3, 4], 1: [], 2: []}
    o = vocab.oov_rate(test, "row_id", "words", ix).first()
    assert (o.tokens, o.unknown, o.rate) == (5, 1, 0.2)


def test_embedding_rows(spark):
    ix = spark.createDataFrame([("alpha", 2), ("gamma", 3)], "word string, idx int")
    vec = spark.createDataFrame([("alpha", [1.0, 2.0])], "word string, vec array<float>")
    rows = {r.word: r for r in vocab.embedding_rows(ix, vec, 2).collect()}
    assert rows["alpha"].vec == [1.0, 2.0] and rows["alpha"].matched
    assert not rows["gamma"].matched and all(abs(x) <= 0.05 for x in rows["gamma"].vec)
    assert rows["gamma"].vec == {r.word: r for r in vocab.embedding_rows(ix, vec, 2).collect()}["gamma"].vec


def test_coverage_and_missing(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 1)], "word string, n long")
    known = spark.createDataFrame([("a",), ("c",)], "word string")
    got = {r.size: tuple(r)[1:] for r in vocab.coverage(counts, known, [2, 0]).collect()}
    assert got == {2: (50.0, 62.5, 80.0), 0: (50.0, 60.0, 100.0)}
    assert [r.word for r in vocab.missing_terms(counts, known, 3, 5).collect()] == ["b"]


def test_ranked_is_a_total_order(spark):
    df = spark.range(0, 500).select(F.col("id"), F.pmod(F.hash("id"), F.lit(7)).alias("g"))
    got = [(r.g, r.id) for r in vocab.ranked(df, [F.asc("g"), F.desc("id")]).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda x: (x[0], -x[1]))
    assert vocab.ranked(df.limit(0), [F.asc("id")]).count() == 0


def test_keep_first_and_conflicts(spark):
    df = spark.createDataFrame([(5, "x", "A"), (2, "x", "B"), (3, None, "A"), (9, None, "A"), (4, "y", "A")], "row_id long, text string, label string")
    assert sorted(r.row_id for r in dedup.keep_first(df, "text", "row_id").collect()) == [2, 3, 4]
    assert [r.copies for r in dedup.duplicate_groups(df, "text").collect()] == [2]
    assert [(r.labels, r["rows"]) for r in dedup.label_conflicts(df.filter("text is not null"), "text", "label").collect()] == [(2, 2)]
    assert {r.row_id: r.later for r in dedup.duplicate_flags(df, "text", "row_id").collect()} == {5: True, 2: False, 3: False, 9: True, 4: False}


def test_length_summary(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "k int")
    r = profile.length_summary(df, "k", (0.5, 0.9))
    assert tuple(r.first()) == (1, 2.5, 1.3, 2, 3, 4)
    t = {x.max_len: (x.truncated_pct, x.tokens_kept_pct) for x in profile.truncation_table(df, "k", [2, 9]).collect()}
    assert t == {2: (50.0, 70.0), 9: (0.0, 100.0)}


def test_artifacts_with_null(spark):
    df = spark.createDataFrame([("XXXX paid {$1.00}",), (None,), ("see www.a.b",)], "t string")
    got = {r.artifact: r.docs for r in profile.artifact_counts(df, "t").collect()}
    assert got["XXXX redaction"] == 1 and got["url"] == 1 and got["{$...} amount"] == 1


def postings(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("ts", T.terms(F.col("text")))
    c = tfidf.term_counts(df, "row_id", "ts")
    return df, tfidf.weigh(c, tfidf.fit(df, "ts", len(texts)))


def test_chain_of_similar_texts_is_one_cluster(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta".split()
    b = a[2:] + ["iota", "kappa"]
    c = b[2:] + ["lambda", "mu"]
    df, p = postings(spark, [" ".join(a), " ".join(b), " ".join(c), "nothing like them", ""])
    full = {(r.a, r.b): r.cos for r in tfidf.similar_pairs(p, 0.0001).collect()}
    t = min(full[0, 1], full[1, 2]) - 1e-6
    assert full[0, 2] < t
    pairs = tfidf.similar_pairs(p, t)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (1, 2)}
    assert {r.row_id: r.root for r in tfidf.clusters(df, "row_id", pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_prefix_filter_is_exact(spark, data):
    d = spark.read.parquet(f"{data}/combined_complaints.parquet").select("row_id", F.col("Consumer complaint narrative").alias("t"))
    c = tfidf.term_counts(d.select("row_id", T.terms(F.col("t")).alias("ts")), "row_id", "ts")
    p = tfidf.weigh(c, tfidf.fit(d, T.terms(F.col("t")), d.count()))
    a, b = p.select(F.col("doc").alias("a"), "term", F.col("w").alias("x")), p.select(F.col("doc").alias("b"), "term", F.col("w").alias("y"))
    plain = a.join(b, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("c")).filter("c >= 0.5")
    want = {(r.a, r.b) for r in plain.collect()}
    for rare in (1, 8, 400):
        assert {(r.a, r.b) for r in tfidf.similar_pairs(p, 0.5, 0.4, rare).collect()} == want


def grouped(spark):
    return spark.createDataFrame([(i, f"t{i}", f"L{i % 5}", i // 4 if i < 200 else i) for i in range(1000)], "row_id long, text string, label string, grp long")


def test_split_holds_its_invariants(spark):
    df = grouped(spark)
    s = split.group_split(df, "row_id", "grp", "label")
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(n.values()) == 1000 and abs(n["train"] - 800) <= 15 and abs(n["test"] - 100) <= 15
    checks = split.validate(s, df, "row_id", "text", "grp", "label")
    split.require_valid(checks)


def test_split_violations_are_all_reported(spark):
    df = grouped(spark)
    bad = df.select("row_id", F.when(F.col("row_id") % 2 == 0, "train").otherwise("test").alias("split")).filter("row_id > 0").unionByName(spark.createDataFrame([(5, "train"), (7777, "test")], "row_id long, split string"))
    got = {r.check: r.violations for r in split.validate(bad, df, "row_id", "text", "grp", "label").collect()}
    assert got["row_without_split"] == 1 and got["row_in_several_splits"] == 1 and got["unknown_row"] == 1
    assert got["group in train/test"] == 50 and got["ratio"] >= 2
    with pytest.raises(ValueError, match="ratio"):
        split.require_valid(split.validate(bad, df, "row_id", "text", "grp", "label"))


def test_fold_ratios():
    assert split.folds_for(0.8, 0.1, 0.1) == (10, 1, 1)
    with pytest.raises(ValueError):
        split.folds_for(0.8, 0.1, 0.2)
    with pytest.raises(ValueError):
        split.folds_for(0.83, 0.1, 0.07)


def test_frequent_keys_are_split(spark, monkeypatch):
    """One word, digest and term in a third of the rows, with a dictionary too large to broadcast."""
    from corpuslab.operators import dedup, joins, tfidf, vocab

    n = 6000
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"w{i % 700}") for i in range(n)], "k long, t string")

    def results():
        words = df.withColumn("ws", F.array("t", F.lit("the")))
        seq = {r.k: tuple(r.seq) for r in vocab.to_sequences(words, "k", "ws", vocab.word_index(vocab.word_counts(words, "k", "ws"))).collect()}
        flags = {r.k: (r.copies, r.later) for r in dedup.duplicate_flags(df, "t", "k").collect()}
        counts = tfidf.term_counts(words, "k", "ws")
        w = {(r.doc, r.term): round(r.w, 9) for r in tfidf.weigh(counts, tfidf.fit(words, "ws", n)).collect()}
        return seq, flags, w

    first = results()
    used = []
    real = joins.lookup
    monkeypatch.setattr(joins, "SMALL_BYTES", 0)
    monkeypatch.setattr(joins, "lookup", lambda *a, **k: used.append(a[2]) or real(*a, **k))
    for f in (joins.attach,):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 0))
    assert results() == first and used == [["word"], ["_d"], ["term"]]
    assert first[1][0] == (2000, False) and first[1][3] == (2000, True)


def test_salted_join(spark):
    from corpuslab.operators import joins

    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(9000)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, v long")
    counts = left.groupBy("k").count()
    got = sorted(map(tuple, joins.salted(left, right, ["k"], counts, "count", 9000, F.col("i")).select("i", "k", "v").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("i", "k", "v").collect()))


def test_small_goes_by_bytes(spark):
    from corpuslab.operators import joins

    df = spark.createDataFrame([(1, "x" * 5000)], "i int, t string")
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(joins.small(df)) and "broadcast" not in plan(joins.small(df, 4000))


def test_search_in_blocks(spark, monkeypatch):
    """Every block size gives what all pairs give, with and without the query itself."""
    import numpy as np

    from corpuslab.operators import dense, tfidf

    rng = np.random.default_rng(5)
    docs = [(i, [f"t{x}" for x in rng.integers(0, 60, 12)]) for i in range(80)] + [(900, ["zz", "zz"]), (901, [])]
    df = spark.createDataFrame(docs, "k long, ts array<string>")
    p = Stage(spark, "t").put(tfidf.weigh(tfidf.term_counts(df, "k", "ts"), tfidf.fit(df, "ts", len(docs))))
    q = p.filter("doc % 7 = 0 or doc = 900")
    by = {}
    for r in p.collect():
        by.setdefault(r.doc, {})[r.term] = r.w
    for bytes_ in (64 << 20, 8 * 60 * 3):
        monkeypatch.setattr(tfidf, "BLOCK_BYTES", bytes_)
        for alone in (False, True):
            got = {r.doc: r.best for r in tfidf.max_similarity(q, p, exclude_self=alone).collect()}
            assert set(got) == {d for d in by if d % 7 == 0 or d == 900}
            for d, best in got.items():
                want = max(sum(w * by[o].get(t, 0) for t, w in by[d].items()) for o in by if not alone or o != d)
                assert best == pytest.approx(want)
    assert tfidf.max_similarity(q.limit(0), p).count() == 0
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(50)] + [(60, [0.0] * 6), (61, None), (None, [1.0] * 6)], "k long, e array<float>")
    one = {r.k: r.best for r in dense.max_cosine(v.filter("k % 5 = 0"), v, "k", "e").collect()}
    monkeypatch.setattr(dense, "BLOCK", 3)
    two = {r.k: r.best for r in dense.max_cosine(v.filter("k % 5 = 0"), v, "k", "e").collect()}
    assert one == pytest.approx(two) and set(one) == {0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 60} and one[60] == 0
    m = np.array([r.e for r in v.filter("k < 50").orderBy("k").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T - 3 * np.eye(50)
    assert one[5] == pytest.approx(max(c[5].max(), 0))


def test_validation_does_not_move_texts(spark):
    """The checks joined and grouped whole texts, which were shuffled again for each of them."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    long = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: F.md5(F.concat_ws("-", "row_id", k).cast("binary"))))
    df = Stage(spark, "t").put(spark.range(40).select(F.col("id").alias("row_id"), F.col("id").alias("grp"), F.lit("x").alias("label")).withColumn("text", long))
    s = Stage(spark, "t").put(split.group_split(df, "row_id", "grp", "label"))
    before = written()
    got = {r.check: r.violations for r in split.validate(s, df, "row_id", "text", "grp", "label").collect()}
    assert written() - before < 500_000
    assert got["duplicate_text"] == got["row_without_split"] == got["text in train/test"] == 0

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpuslab.llm import neardup, wordhash
from corpuslab.llm.neardup import near_duplicates

W = re.compile(r"[^\W_]+")


def shingles(t, k):
    w = [x.lower() for x in W.findall(t)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold):
    s = [(i, t, shingles(t, k)) for i, t in rows if t is not None]
    par = {i: i for i, *_ in s}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for x, (i, t, a) in enumerate(s):
        for j, u, b in s[:x]:
            if t == u or a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                p, q = find(i), find(j)
                par[max(p, q)] = min(p, q)
    return {(find(i), i) for i in par if find(i) != i}


def run(spark, rows, k=3, threshold=0.6, **kw):
    df = spark.createDataFrame(rows, "row_id long, t string")
    return {(r.first_row_id, r.row_id) for r in near_duplicates(df, "row_id", "t", k, threshold).collect() if r.first_row_id != r.row_id}


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
    return " ".join(w)


def corpus(seed, bases=25, each=6, words=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        rows += [edited(rng, base, rng.randrange(0, 14)) for _ in range(each)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k, threshold", [(3, 0.6), (5, 0.8)])
def test_against_brute_force(spark, k, threshold):
    rows = corpus(k)
    assert run(spark, rows, k, threshold) == brute(rows, k, threshold)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, ""), (4, "two words"), (5, "Two words"), (6, "two words"), (7, "one two three"), (8, "ONE, two; three!"), (9, "a " * 40_000), (10, "a " * 40_000 + "."), (2, "")]
    assert run(spark, rows) == {(2, 3), (4, 6), (7, 8), (9, 10)}
    assert run(spark, []) == set()
    df = spark.createDataFrame(rows[:8], "row_id long, t string").selectExpr("row_id", "t", "1 as key", "2 as i", "3 as j", "4 as kind", "5 as sketch", "6 as first_row_id")
    assert near_duplicates(df, "row_id", "t", 3, 0.6).count() == 6


@pytest.mark.parametrize("parts", [1, 9])
def test_large_buckets_lose_no_link(spark, monkeypatch, parts):
    """A template that a third of all rows share: buckets far beyond the lag, folded within batches or met after the shuffle, and
    links between rows that are not near neighbours in any of them."""
    monkeypatch.setattr(neardup, "HOT_ROWS", 5)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):  # two families that share the template but not enough to be linked, and bridges
        own = [f"{'xy'[i % 2]}{j}" for j in range(45)]
        rows.append(" ".join(base + own[: 45 - i % 3]) + f" {rng.randrange(10**6)}")
    rows += [" ".join(f"r{rng.randrange(10**5)}" for _ in range(80)) for _ in range(200)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "row_id long, t string").repartition(parts)
    got = {(r.first_row_id, r.row_id) for r in near_duplicates(df, "row_id", "t", 3, 0.6, lag=2).collect() if r.first_row_id != r.row_id}
    assert got == brute(rows, 3, 0.6)


def test_a_group_sends_few_rows_of_a_hot_key():
    base = " ".join(f"b{i}" for i in range(80))
    batch = neardup._key_group(np.arange(500), [base + f" x{i}" for i in range(500)], 3, 8)
    kind = batch.column(2).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    key, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    _, n = np.unique(key[kind == -1], return_counts=True)
    assert n.max() == 1
    hot = batch.column(2).filter(pa.array(kind == neardup._LARGE)).flatten().to_numpy()[::3]
    by = {x: set(row[kind == neardup._LARGE][hot == x]) for x in np.unique(hot)}
    assert any(len(v) > 300 for v in by.values())
    # every row of a bucket is tied to its first row
    ties = set(zip(key[kind == neardup._PAIR], row[kind == neardup._PAIR]))
    for v in by.values():
        s = sorted(v)
        assert all((s[0], j) in ties for j in s[1:])


def test_closing_round_finds_the_left_out_pair(spark, monkeypatch):
    from corpuslab.session import Stage

    df = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon {'zeta eta theta iota' if i in (1, 5) else f'p{i} q{i} r{i} s{i} t{i} u{i}'}") for i in range(8)], "row_id long, t string")
    met = df.mapInArrow(neardup._keyed(3), neardup._KEYED)
    sk = Stage(spark, "t").put(met.filter("size(sketch) > 1").select("row_id", "sketch"))
    large = spark.createDataFrame([(7, i) for i in range(8)], "key long, row_id long")
    comp = spark.createDataFrame([], "node long, component long")
    done = spark.createDataFrame([], "i long, j long")
    more = {(r.i, r.j) for r in neardup._close(large, comp, sk, done, 0.6).collect()}
    assert (1, 5) in more
    one = spark.createDataFrame([(i, 0) for i in range(8)], "node long, component long")
    assert neardup._close(large, one, sk, done, 0.6).count() == 0


def test_estimates(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)] + [edited(rng, base, n) for n in (0, 5, 20, 40)]
    h, _, _, first = wordhash.words(texts)
    s, off = wordhash.shingles(h, first, 3)
    sk = neardup.odd_sketches(neardup.minhashes(s, off))
    a = shingles(texts[0], 3)
    rows = [([int(x) for x in sk[0].view(np.int64)], [int(x) for x in v.view(np.int64)], len(a & shingles(t, 3)) / len(a | shingles(t, 3))) for v, t in zip(sk, texts)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, j double")
    from pyspark.sql import functions as F

    for r in df.select(neardup.estimate(F.col("a"), F.col("b")).alias("e"), "j").collect():
        assert abs(r.e - r.j) < neardup.MARGIN


def test_real_rows(spark, data):
    d = spark.read.parquet(f"{data}/combined_complaints.parquet").selectExpr("row_id", "`Consumer complaint narrative` as t")
    rows = [tuple(r) for r in d.collect()]
    assert run(spark, rows) == brute(rows, 3, 0.6)


def test_words_follow_python():
    texts = ["Ünal’s CAFÉ_no1 — x² 中文 \U0001f621a İx", "", "   ", "a", "ab́c"]
    h, a, b, first = wordhash.words(texts)
    for i, t in enumerate(texts):
        spans = [m.span() for m in W.finditer(t)]
        assert list(zip(a[first[i] : first[i + 1]], b[first[i] : first[i + 1]])) == spans

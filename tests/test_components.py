import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpuslab.operators import components, joins
from corpuslab.operators.components import connected_components
from corpuslab.operators.quota import take_quota


def brute(edges):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            if a != b:
                par[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(par)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r.node: r.component for r in connected_components(df).collect()}


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1)],
        [(3, 2), (2, 1)],
        [(i, i + 1) for i in range(60)],  # a long path
        [(0, i) for i in range(1, 200)],  # a hub
        [(5, 4), (4, 5), (5, 4), (9, 7)],
    ],
)
def test_cases(spark, edges):
    assert run(spark, edges) == brute(edges)


def test_random(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    assert run(spark, edges) == brute(edges)


def test_null_ends_and_strings(spark):
    df = spark.createDataFrame([("b", "a"), (None, "a"), ("c", None)], "src string, dst string")
    assert {r.node: r.component for r in connected_components(df).collect()} == {"a": "a", "b": "a"}


def test_hot_key_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 2)
    rows = [(0, i) for i in range(3000)] + [(i, i) for i in range(1, 500)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(0, "hot", 3000)] + [(i, f"x{i}", 1) for i in range(1, 400)], "k long, name string, n long")
    got = joins.lookup(left, right, ["k"], len(rows), "n")
    assert got.count() == 3000 + 399
    assert joins.lookup(left, right, ["k"], len(rows), "n", "left").filter("name is null").count() == 100


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 400), take=st.integers(0, 500), buckets=st.sampled_from([1, 7, 4096]))
def test_quota_is_exact(spark, n, take, buckets):
    rows = spark.createDataFrame([("a", i) for i in range(n)] + [("b", i) for i in range(50)], "g string, id long")
    quota = spark.createDataFrame([("a", take)], "g string, take long")
    got = [r.id for r in take_quota(rows, quota, ["g"], ["id"], 3, buckets).collect()]
    assert len(got) == len(set(got)) == min(n, take)


def test_stages_can_be_dropped(spark):
    import pathlib

    from corpuslab.session import Stage, drop_stages

    st = Stage(spark, "x")
    t = st.put(spark.range(3).toDF("a"))
    where = pathlib.Path(st.root.removeprefix("file://"))
    assert t.count() == 3 and where.exists()
    assert drop_stages(spark) >= 1 and not where.exists()


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_pairs_in_one_task_or_in_many(spark, monkeypatch, limit):
    rng = random.Random(4)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(280)] + [(i, i + 1) for i in range(1000, 1090)] + [(1090, 7), (5, 5), (None, 3), (4, None)]
    monkeypatch.setattr(components, "SMALL_BYTES", limit)
    df = spark.createDataFrame(edges, "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup(f"pairs{limit}", "pairs")
    got = [(r.node, r.component) for r in components.components_of_pairs(df).collect()]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert dict(got) == brute([e for e in edges if None not in e]) and len(got) == len(dict(got))
    if limit:
        assert len(sc.statusTracker().getJobIdsForGroup(f"pairs{limit}")) <= 5
    assert components.components_of_pairs(df.filter("a is null")).collect() == []

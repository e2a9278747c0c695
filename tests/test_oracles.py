"""Every core query against its SQL over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslab.plans import core


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, data, sql, name):
    df = entry.queries()[name](spark, data)
    cur = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(x) for x in r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


#: Of queries without SQL what their rows must satisfy, over all of them. The classes of these tables hardly follow from their texts;
#: that a classifier learns is tested in test_model_streaming.py.
RULES = {
    "plateau_schedule": lambda rows: len({(r.run, r.epoch) for r in rows}) == len(rows) > 0 and all(r.lr > 0 for r in rows),
    "stream_schedule": lambda rows: len({(r.run, r.epoch) for r in rows}) == len(rows) > 0 and all(b.lr <= a.lr for a, b in zip(sorted(rows, key=lambda r: (r.run, r.epoch)), sorted(rows, key=lambda r: (r.run, r.epoch))[1:]) if a.run == b.run),
    "lr_tfidf_predictions": lambda rows: len({r.row_id for r in rows}) == len(rows) > 100 and all(0 <= r.y_pred < 5 and 0 <= r.y_true < 5 for r in rows),
    "lr_top_features": lambda rows: len(rows) == 60 and {(r.class_id, r.rank) for r in rows} == {(c, k) for c in range(5) for k in range(1, 13)},
    "redaction_probe": lambda rows: {r.probe for r in rows} == {"redaction only", "length only", "redaction + length"} and all(0 <= r.macro_f1 < 0.7 for r in rows),
    "audit_classifier": lambda rows: [r.class_id for r in sorted(rows)] == list(range(5)) and sum(r.support for r in rows) > 100 and max(r.f1 for r in rows) > 0.3,
}


def test_every_query_has_sql_or_a_rule():
    assert set(core.queries()) == set(core.oracle_sql()) | set(RULES)


@pytest.mark.parametrize("name", sorted(RULES))
def test_queries_without_sql(spark, data, name):
    assert RULES[name](entry.queries()[name](spark, data.replace("sf0.001", "sf0.01")).collect())

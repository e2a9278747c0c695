"""Queries for training data against their SQL over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslab.llm import queries


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    df = entry.queries()[name](spark, data)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_restored_rows_are_found_and_stay_restored(spark, data):
    """p1: a row is restored at most once, differs from what it was unless nothing could be undone, and what is complete needs no more."""
    from corpuslab.llm.encoding import repair_encoding

    rows = entry.queries()["p1_restored"](spark, data).collect()
    assert len({r.row_id for r in rows}) == len(rows)
    assert {r.row_id for r in rows} == {r.row_id for r in entry.queries()["p1_found"](spark, data).collect()}
    text = spark.read.parquet(f"{data}/combined_complaints.parquet").select("row_id", queries.F.col(queries.NARRATIVE).alias("t"), queries.F.col("Submitted via").alias("s"))
    was = {r.row_id: r.t for r in text.collect()}
    assert all(r.restored != was[r.row_id] for r in rows if r.complete)
    back = spark.createDataFrame([(r.row_id, r.restored) for r in rows if r.complete], "row_id long, fixed string")
    again = text.join(back, "row_id", "left").select("row_id", queries.F.coalesce("fixed", "t").alias("t"), "s")
    assert not {r.row_id for r in repair_encoding(again, "row_id", "t", "s").collect()} & {r.row_id for r in rows if r.complete}


def test_leaks_of_both_kinds(spark, data):
    """p7: verbatim leaks are those of p7_found, every pair comes once, and each has a window."""
    rows = entry.queries()["p7_leaks"](spark, data).collect()
    found = {(r.doc_id, r.item_id) for r in entry.queries()["p7_found"](spark, data).collect()}
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows) and {(r.doc_id, r.item_id) for r in rows if r.kind == "verbatim"} == found
    assert all(r.windows >= 1 and r.kind in ("verbatim", "template") for r in rows)


def test_samples_meet_their_report(spark, data):
    """p4: what the report says was drawn is what the sample has."""
    from corpuslab.llm.sampling import category

    sample, report = queries._sampled(spark, data)
    c = spark.read.parquet(f"{data}/combined_complaints.parquet").select(queries.F.col("Complaint ID").alias("id"), category(queries.F.col("Product")).alias("p")).distinct()
    got = {(r.plan_id, r.p): r["count"] for r in sample.join(c, "id").groupBy("plan_id", "p").count().collect()}
    for r in report.withColumn("p", category(queries.F.col("product"))).collect():
        assert got.get((r.plan_id, r.p), 0) == r.drawn and r.short == (r.available < r.wanted) and r.unmet == (r.drawn < r.wanted)

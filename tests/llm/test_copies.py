import re

from corpuslab.llm.copies import collapse_copies


def brute(rows):
    alnum = lambda x: "".join(c for c in x.lower() if c.isalnum())
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    seen = {}
    for i, t in rows:
        if t is None:
            continue
        keys = [("flat", alnum(t))]
        parts = [p for p in re.split(r"[\n\r;|]+", t) if p.strip()]
        if len(parts) > 1 and all(re.match(r"[^:]*\w[^:]*:", p) for p in parts):
            keys.append(("form", tuple(sorted(filter(None, map(alnum, parts))))))
        for k in keys:
            a, b = find(i), find(seen.setdefault(k, i))
            par[max(a, b)] = min(a, b)
    return {i: find(i) for i in par}


ROWS = [
    (5, "Hello, World!"),
    (3, "hello world"),
    (9, "HELLO\n\nWORLD"),
    (1, "helloworlds"),
    (10, "Name: Bob\nFee: 3; Place: Rome"),
    (11, "fee: 3 | place: rome | NAME: bob"),
    (12, "Name Bob Fee 3 Place Rome"),  # the same letters as 10, but no form
    (13, "Name: Bob; Fee: 3; no label here; Place: Rome"),
    (14, "no label here; Name: Bob; Fee: 3; Place: Rome"),
    (20, ""),
    (21, " .,;"),
    (22, None),
    (23, None),
    (30, "A: b; C: d"),
    (31, "A: b C: d"),
    (32, "C: d; A: b"),
    (40, "día señor"),
    (41, "DÍA  SEÑOR!"),
    (50, "x" * 200_000),
    (51, "X" * 200_000 + "."),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "row_id long, t string")
    got = {r.row_id: r for r in collapse_copies(df, "row_id", "t").collect()}
    want = brute(ROWS)
    assert {i: r.first_row_id for i, r in got.items()} == want
    for i, r in got.items():
        assert r.copies == sum(v == want[i] for v in want.values())


def test_hot_copy_repeated_rows_clashing_columns_and_empty(spark):
    rows = [(i, ["Same text!", "same; TEXT", f"own {i}"][i % 3]) for i in range(3000)] + [(0, "Same text!")]
    df = spark.createDataFrame(rows, "row_id long, t string").selectExpr("row_id", "t", "1 as k1", "2 as first_row_id", "3 as flat", "4 as copies", "5 as n", "6 as root")
    got = {r.row_id: r for r in collapse_copies(df, "row_id", "t").collect()}
    assert len(got) == 3000 and got[1].first_row_id == 0 and got[1].copies == 2000 and got[2].copies == 1
    assert collapse_copies(df.limit(0), "row_id", "t").count() == 0


def test_real_rows(spark, data):
    d = spark.read.parquet(f"{data}/combined_complaints.parquet")
    rows = [(r[0], r[1]) for r in d.select("row_id", "Consumer complaint narrative").collect()]
    got = {r.row_id: r.first_row_id for r in collapse_copies(d, "row_id", "Consumer complaint narrative").collect()}
    assert got == brute(rows)

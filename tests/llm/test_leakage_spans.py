import random
import re

import pyarrow as pa
import pytest

from corpuslab.llm import leakage, spans
from corpuslab.llm.leakage import find_leaks
from corpuslab.llm.spans import shared_share, shared_spans

W = re.compile(r"[^\W_]+")
ITEM = "On May 5, Anna Berg paid 300 dollars to Zelmax Bank for 12 months and never got a reply from the office."


def leaks(spark, docs, items, k=13):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in find_leaks(d, "doc_id", "text", i, "item_id", "text", k).collect()}


def test_verbatim_and_templates(spark):
    items = [(1, ITEM), (2, "too short"), (3, None), (1, ITEM), (4, "We told Anna Berg and Zelmax Bank that we know Anna Berg.")]
    docs = [
        (10, "Before. " + ITEM.upper() + " After."),
        (11, ITEM.replace(",", " --").replace(" ", "\n")),
        (12, ITEM.replace("300", "4711").replace("12", "24").replace("Zelmax", "Ostbank").replace("months", "weeks")),
        (13, ITEM.replace(" for ", " within ")),
        (14, None),
        (15, ""),
        (16, "x " * 50_000 + ITEM),
        (10, "Before. " + ITEM.upper() + " After."),
    ]
    got = leaks(spark, docs, items)
    assert {k for k, v in got.items() if v == "verbatim"} == {(10, 1), (11, 1), (16, 1)}
    assert got.get((12, 1)) == "template" and (13, 1) not in got
    assert leaks(spark, [], items) == {} and leaks(spark, docs, []) == {}


def test_slots_must_agree(spark):
    item = [(1, "the 5 of the 5 and the 7 are in the box of the man who came by")]
    ok, bad = "the 8 of the 8 and the 9 are in the box of the man who came by", "the 8 of the 9 and the 9 are in the box of the man who came by"
    got = leaks(spark, [(1, ok), (2, bad)], item, 18)
    assert got == {(1, 1): "template"}


NAMED = "The agent of Zelmax told us in april that it was late today."


@pytest.mark.parametrize(
    "item,doc",
    [
        (NAMED, NAMED.replace("Zelmax", "Ostbank")),
        # the new name is a word of the items, and a sentence starts within the window
        ("A rose is here. " + NAMED, "So it is. " + NAMED.replace("Zelmax", "Rose")),
        # capitals at the start differ
        (NAMED, NAMED.replace("Zelmax", "Ostbank").replace("that it", "that: It")),
        (NAMED, NAMED.replace("Zelmax", "Ostbank").upper()),
    ],
)
def test_new_name_beside_other_capitals(spark, item, doc):
    got = leaks(spark, [(1, doc), (2, doc.replace("late", "early").replace("LATE", "EARLY"))], [(7, item), (8, "WE GOT NO REPLY " * 9)])
    assert got == {(1, 7): "template"}
    assert leaks(spark, [(1, "NO ONE TOLD ME A THING ABOUT THIS OLD LOAN OF MINE")], [(8, NAMED.upper())], 10) == {}


def test_windows_are_counted_once_over_readings(spark):
    d = spark.createDataFrame([(1, NAMED + " My friend saw it.")], "doc_id long, text string")
    assert [tuple(r) for r in find_leaks(d, "doc_id", "text", d, "doc_id", "text").collect()] == [(1, 1, "verbatim", 5)]


def test_names_are_not_cut(spark, monkeypatch):
    item, doc = "we told Anna and Berg that Zelmax and Orlo went home by bus", "we told berg and zelmax that orlo and anna went home by bus"
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", 1)
    assert leaks(spark, [(1, doc)], [(7, item)]) == {(1, 7): "template"}
    monkeypatch.setattr(leakage, "MAX_WORDS", 3)
    with pytest.raises(ValueError, match="distinct words"):
        leaks(spark, [(1, doc)], [(7, item)])


def test_slots_alone_are_no_template(spark):
    numbers = lambda seed: " ".join(str(x) for x in random.Random(seed).sample(range(10**6), 13))
    table = " ".join(map(str, range(100_000)))
    got = leaks(spark, [(1, numbers(1)), (2, numbers(2)), (3, table), (4, "XXXX " * 30), (5, table[:300] + " end " + numbers(2))], [(7, numbers(2)), (8, table[-400:]), (9, "XX " * 13)])
    assert got == {(2, 7): "verbatim", (5, 7): "verbatim", (3, 8): "verbatim"}


@pytest.mark.parametrize("to,kind", [("weeks", "template"), ("quarters", "template"), ("euros", None), ("kilograms", None), ("monday", None), ("months", "verbatim")])
def test_units_keep_their_dimension(spark, to, kind):
    item = "we waited for the answer of the bank for 12 months and then went home"
    assert leaks(spark, [(1, item.replace("months", to))], [(7, item)]).get((1, 7)) == kind


def test_counted_things_are_learned(spark):
    item = "the clerk said that i have 5 apples and 7 apples in the box that came by mail"
    doc = item.replace("5 apples", "8 grapes").replace("7 apples", "2 grapes")
    assert leaks(spark, [(1, doc), (2, item.replace("5 apples", "8 of those").replace("7 apples", "2 grapes"))], [(7, item)]) == {(1, 7): "template"}


@pytest.mark.parametrize("few", [1, 10**8])
def test_templates_against_brute_force(spark, monkeypatch, few):
    """Numbers alone as slots, against all pairs of windows."""
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", few)
    rng = random.Random(9)
    words = [f"w{'abcdefgh'[i]}" for i in range(8)]
    text = lambda n: " ".join(rng.choice([*words, str(rng.randrange(4))]) for _ in range(n))
    items = [(i, text(12)) for i in range(20)]
    docs = [(i, re.sub(r"\d", lambda m: str(9 - int(m[0])), items[i % 20][1]) if i % 3 else text(30)) for i in range(40)] + [(50, items[3][1]), (51, text(4) + " " + items[5][1])]

    def windows(t):
        w = t.split()
        return [w[p : p + 8] for p in range(len(w) - 7)]

    want = {}
    for d, t in docs:
        for i, u in items:
            for x in windows(u):
                for y in windows(t):
                    slots = [(a, b) for a, b in zip(x, y) if a.isdigit()]
                    same = all(a == b or a.isdigit() and b.isdigit() for a, b in zip(x, y))
                    one = len(set(slots)) == len({a for a, _ in slots}) == len({b for _, b in slots})
                    if x == y:
                        want[d, i] = "verbatim"
                    elif same and one and 2 * len(slots) <= 8:
                        want.setdefault((d, i), "template")
    assert "template" in want.values() and leaks(spark, docs, items, 8) == want


def brute_leaks(docs, items, k=13):
    idx = {}
    for i, t in items:
        w = [x.lower() for x in W.findall(t or "")]
        for p in range(len(w) - k + 1):
            idx.setdefault(tuple(w[p : p + k]), set()).add(i)
    out = set()
    for d, t in docs:
        w = [x.lower() for x in W.findall(t or "")]
        for p in range(len(w) - k + 1):
            out |= {(d, i) for i in idx.get(tuple(w[p : p + k]), ())}
    return out


def test_real_leaks(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = leaks(spark, docs, items)
    assert {k for k, v in got.items() if v == "verbatim"} == brute_leaks(docs, items)


def brute_spans(docs, n):
    seen, many = {}, set()
    for d, t in docs:
        for p in range(len(t or "") - n + 1):
            w = t[p : p + n]
            if seen.setdefault(w, d) != d:
                many.add(w)
    out = set()
    for d, t in docs:
        cov = [False] * len(t or "")
        for p in range(len(t or "") - n + 1):
            if t[p : p + n] in many:
                cov[p : p + n] = [True] * n
        p = 0
        while p < len(cov):
            if cov[p]:
                q = p
                while q < len(cov) and cov[q]:
                    q += 1
                out.add((d, p + 1, q - p))
                p = q
            p += 1
    return out


def fixture(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé 中😡\n") for _ in range(n))
    foot = text(90)
    docs = [(i, text(rng.randrange(0, 200)) + (foot if i % 3 == 0 else "") + text(rng.randrange(0, 60))) for i in range(120)]
    docs += [(200 + i, docs[i * 7][1][5:150]) for i in range(12)]  # parts of others
    docs += [(300, "x" * 500), (301, "x" * 45), (302, "x" * 39), (303, docs[4][1]), (304, docs[4][1]), (305, "ab" * 100), (306, None), (307, "")]
    docs += [(310, foot + "-" + foot), (311, text(50) * 3)]
    return docs


@pytest.mark.parametrize("hot", [20_000, 20])
def test_spans_against_brute_force(spark, hot):
    docs = fixture(hot)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in shared_spans(df, "doc_id", "text", 40, hot).collect()}
    assert got == brute_spans(docs, 40)


def test_spans_joined_when_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_WINDOWS", 3)
    docs = fixture(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as m", "2 as doc", "3 as a", "4 as b", "5 as s")
    assert {tuple(r) for r in shared_spans(df, "doc_id", "text", 40, 20).collect()} == brute_spans(docs, 40)


def test_copies_are_found_however_rows_are_batched(spark):
    text = fixture(1)[5][1] + "0123456789" * 9
    batch = pa.RecordBatch.from_arrays([pa.array([3, 9, 3]), pa.array([text, text, text])], names=["doc", "t"])
    got = pa.Table.from_batches(spans._count(40)(iter([batch]))).to_pylist()
    assert got and all(r["lo"] == 3 and r["hi"] == 9 for r in got)


def test_one_text_in_a_third_of_the_rows(spark):
    same, own = "the same long footer of all these letters, " * 3, fixture(2)
    docs = [(i, t) for i, t in own if t] + [(1000 + i, f"{i:05d} " + same) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert {tuple(r) for r in shared_spans(df, "doc_id", "text", 40, 10).collect()} == brute_spans(docs, 40)


def test_share(spark):
    docs = [(1, "q" * 30 + "z" * 10), (2, "q" * 30), (3, ""), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.shared_chars, r.share) for r in shared_share(df, "doc_id", "text", shared_spans(df, "doc_id", "text", 20)).collect()}
    assert got == {1: (30, 0.75), 2: (30, 1.0), 3: (0, None)}
    assert shared_spans(df.limit(0), "doc_id", "text").count() == 0


def test_real_spans(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in d.collect()]
    assert {tuple(r) for r in shared_spans(d, "doc_id", "text", 100).collect()} == brute_spans(docs, 100)

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The bank's fee, again!", ["the", "bank's", "fee", "again"]),
        ("a\tb\nc", ["a", "b", "c"]),
        ("a\rb c\xa0d", ["a\rb", "c\xa0d"]),
        ("", []),
        ("   ", []),
        ("XX/XX/2019 {$12.00}", ["xx", "xx", "2019", "12", "00"]),
    ],
)
def test_words(spark, text, expected):
    assert one(spark, text, T.split_words) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("b'hello world'", "hello world"),
        ('b"it\'s"', "it's"),
        ("b'a\\nb'", "a\nb"),
        ("b'it\\'s'", "it's"),
        ("b'open", "b'open"),
        ("b'x'\n", "x"),
        ("b''", ""),
        ("b'mixed\"", "b'mixed\""),
        ("URGENT XXXX", "URGENT XXXX"),
    ],
)
def test_strip_wrapper(spark, text, expected):
    assert one(spark, text, T.strip_wrapper) == expected


@pytest.mark.parametrize(
    "seq, n, padding, truncating, expected",
    [
        ([1, 2], 4, "pre", "post", [0, 0, 1, 2]),
        ([1, 2], 4, "post", "post", [1, 2, 0, 0]),
        ([1, 2, 3, 4, 5], 3, "pre", "post", [1, 2, 3]),
        ([1, 2, 3, 4, 5], 3, "pre", "pre", [3, 4, 5]),
        ([], 3, "pre", "pre", [0, 0, 0]),
        ([7, 8, 9, 10], 4, "pre", "pre", [7, 8, 9, 10]),
    ],
)
def test_pad(spark, seq, n, padding, truncating, expected):
    assert one(spark, seq, lambda c: T.pad(c, n, padding, truncating), "array<int>") == expected


def test_pad_rejects_modes():
    with pytest.raises(ValueError):
        T.pad(None, 3, "left")


def test_bigrams(spark):
    assert one(spark, ["a", "b", "c"], T.bigrams, "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], T.bigrams, "array<string>") == []
    assert one(spark, [], T.bigrams, "array<string>") == []


def test_mask_and_accents(spark):
    assert one(spark, "write x@y.org or 1234567, not 12345", T.mask_pii) == "write [email] or [number], not 12345"
    assert one(spark, "Zürner señor Ł", T.strip_accents) == "Zurner senor Ł"


def test_formats(spark):
    df = spark.createDataFrame([(0.016, None), (-0.0004, 0.002), (None, None)], "d double, s double")
    got = [(r.a, r.b) for r in df.select(T.format_delta(F.col("d")).alias("a"), T.format_metric(F.coalesce("d", F.lit(0.5)), F.col("s")).alias("b")).collect()]
    assert got == [("+0.0160", "0.0160"), ("-0.0004", "-0.0004 ± 0.0020"), ("—", "0.5000")]


def test_accents_follow_unicode(spark):
    import unicodedata

    texts = ["señora Ångström Ÿ й ά ² ½ ﬁ", "e\u0301te\u0301 ñandú", "", None, "中文 😡"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip_accents(F.col("t")).alias("t")).collect()]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    # characters that decompose into several stay
    assert got == [None if t is None else "".join(c if c in "½ﬁ" else plain(c) for c in t) for t in texts]

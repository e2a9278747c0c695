import random

import pytest

from corpuslab.llm import encoding
from corpuslab.llm.encoding import repair_encoding

CLEAN = [
    "“The manager” said – after a café visit – that señor Ibrañez perdió £45.",
    "Según la carta, pagué $20 y la señora retiró €30 dos veces. ¿Por qué?",
    "The bank’s naïve clerk in Zürich can’t explain the fee – nobody called.",
    "Después de 16 llamadas, el banco cerró la cuenta y dañó mi historial.",
    "SÃO AÇÃO Ânima Torre wrote to Østerlund about рынок Зимка and 中文 forms 😡.",
]


def corpus(spark, damaged, n=60):
    rows = [(i, CLEAN[i % len(CLEAN)] + f" Ref {i}.", "Web") for i in range(n)]
    rows += [(1000 + i, t, "Web") for i, t in enumerate(damaged)]
    return spark.createDataFrame(rows, "row_id long, t string, src string")


def found(df):
    return {r.row_id: r for r in repair_encoding(df, "row_id", "t", "src").collect()}


PAGES = ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"]


@pytest.mark.parametrize("page", PAGES)
def test_utf8_as_page_is_restored(spark, page):
    texts = [CLEAN[1], CLEAN[3]]
    bad = [t.encode("utf-8").decode(page, "surrogateescape") for t in texts]
    bad = ["".join(c if not 0xDC80 <= ord(c) < 0xDD00 else chr(ord(c) - 0xDC00) for c in t) for t in bad]
    got = found(corpus(spark, bad))
    assert set(got) == {1000, 1001}
    assert [got[1000].restored, got[1001].restored] == texts and got[1000].complete


@pytest.mark.parametrize("read", ["mac_roman", "cp437", "cp850", "cp1251"])
def test_page_as_page_is_restored(spark, read):
    text = CLEAN[3] + " " + CLEAN[3]
    got = found(corpus(spark, [text.encode("cp1252").decode(read)], n=200))
    assert set(got) == {1000} and got[1000].restored == text


def test_double_lost_bytes_and_one_place(spark):
    twice = CLEAN[2].encode("utf-8").decode("latin_1").encode("utf-8").decode("latin_1")
    one_place = CLEAN[3] + " y nadie contestÃ³ nada."
    lost = "na�ve work"
    printed = " b'na\\xc3\\xafve \\'x\\'\\n' "
    got = found(corpus(spark, [twice, one_place, lost, printed, "b'cause nobody", "b'a' and 'b'", "b''"]))
    assert set(got) == {1000, 1001, 1002, 1003, 1006}
    assert got[1000].restored == CLEAN[2]
    assert got[1001].restored == CLEAN[3] + " y nadie contestó nada."
    assert not got[1002].complete and got[1002].kind == "lost"
    assert got[1003].restored == "naïve 'x'\n" and got[1003].kind == "bytes" and got[1006].restored == ""


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "plain", None), (4, "é" * 5000, None), (None, "cafÃ©", None)], "row_id long, t string, src string")
    assert {r.row_id for r in repair_encoding(df, "row_id", "t", "src").collect()} <= {None}
    assert repair_encoding(df.limit(0), "row_id", "t", "src").count() == 0
    clash = df.selectExpr("row_id", "t", "src", "1 as source", "2 as text", "3 as kind", "4 as l", "5 as n")
    assert repair_encoding(clash, "row_id", "t").count() <= 1


def test_tables_follow_from_code_pages():
    names = [c.name for c in encoding.ciphers()]
    assert len(names) == len(set(names)) and "utf8>cp1252" in names and "cp1252>mac_roman" in names
    assert all(len(encoding.symbol(c)) <= 4 for c in ["a", "é", "中", "", " "])


@pytest.mark.parametrize("page", ["gbk", "cp932", "cp949", "cp1255", "cp874"])
def test_utf8_as_other_pages_is_restored(spark, page):
    text = "El señor Ibrañez perdió £45 según la carta."
    got = found(corpus(spark, [text.encode("utf-8").decode(page)], n=200))
    assert set(got) == {1000} and got[1000].restored == text and got[1000].complete
    if page in ("gbk", "cp932"):
        text = "The bank’s clerk can’t explain the fee."
        assert found(corpus(spark, [text.encode("utf-8").decode(page)], n=200))[1000].restored == text


def test_table_of_an_unknown_page_is_learned(spark):
    # symbols that no code page gives for these letters
    page = str.maketrans({"é": "ᚠ", "ñ": "ᛗ", "ó": "ᚦ"})
    words = ["perdió", "cerró", "dañó", "retiró", "pagó", "señora", "señor", "Ibrañez", "pequeño", "año", "compañía", "bebé", "pagué", "llamé", "también", "café"]
    clean = [(i, f"El {w} de la carta {i}.", "Web") for i, w in enumerate(words * 20)]
    bad = [(1000 + i, f"El {w} de la carta.".translate(page), "Fax") for i, w in enumerate(words) if w != "compañía"]
    right = [(2000, "La ᚠᛗᚦ de 中文 y 😡 o ᛗ.", "Fax")]
    got = found(spark.createDataFrame(clean + bad + right, "row_id long, t string, src string"))
    assert {k: r.restored for k, r in got.items()} == {i: f"El {words[i - 1000]} de la carta." for i, *_ in bad}
    assert {r.kind for r in got.values()} == {"learned"}


@pytest.mark.parametrize("page", ["latin_1", "mac_roman"])
def test_long_runs_are_not_cut_within_characters(spark, page):
    text = "これは銀行の請求書についての苦情です" * 12
    got = found(corpus(spark, [text.encode("utf-8").decode(page), "�" + text.encode("utf-8").decode(page)]))
    assert got[1000].restored == text and got[1000].complete
    assert got[1001].restored == "�" + text and not got[1001].complete


def test_five_turns(spark):
    text = CLEAN[3]
    for _ in range(5):
        text = text.encode("utf-8").decode("latin_1")
    r = found(corpus(spark, [text]))[1000]
    assert r.restored == CLEAN[3] and r.complete


SENTENCES = {
    "zh": "我向银行提交了报告和账户材料，但是三个月以来没有人给我任何答复。",
    "ja": "銀行に何度も電話をしましたが、誰も請求書について説明してくれませんでした。",
    "th": "ฉันโทรไปที่ธนาคารหลายครั้งแล้วแต่ไม่มีใครอธิบายค่าธรรมเนียมให้ฉันฟังเลย",
}


def misread(text, page):
    out = text.encode("utf-8").decode(page, "surrogateescape")
    return "".join(c if not 0xDC80 <= ord(c) < 0xDD00 else chr(ord(c) - 0xDC00) for c in out)


def test_scripts_without_blanks_come_back_whole(spark):
    pages = ("latin_1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r")
    want = [((t * 20)[:n], p) for t in SENTENCES.values() for n in (30, 64, 170, 500) for p in pages]
    clean = [(5000 + i, t, "Web") for i, t in enumerate(list(SENTENCES.values()) * 20)]
    rows = [(i, misread(t, p), "Web") for i, (t, p) in enumerate(want)]
    got = found(spark.createDataFrame(clean + rows, "row_id long, t string, src string"))
    assert set(got) == set(range(len(want)))
    assert [want[i] for i in got if got[i].restored != want[i][0]] == []
    assert all(r.complete for r in got.values())


def test_permuted_page_by_source(spark):
    """Two sources with tables of their own, permutations of the accented letters' places that no page has."""
    rng = random.Random(11)
    letters = "áéíóúñü"
    words = "está más rápido allí también perdió cerró llamó dañó año señor señora pequeño compañía país día aquí único número último según después inglés café bebé pagué vergüenza bilingüe pingüino".split()
    pages = {src: dict(zip(map(ord, letters), rng.sample([chr(c) for c in range(first, first + 40)], len(letters)))) for src, first in (("Fax", 0x16A0), ("Post", 0x13A0))}
    clean = [(i, f"El {w} de la carta {i}.", "Web") for i, w in enumerate(words * 12)]
    want = {(k + 1) * 1000 + i: f"El {w} y el {words[i * 7 % len(words)]} de la carta." for k in range(2) for i, w in enumerate(words)}
    bad = [(i, t.translate(pages["Fax" if i < 2000 else "Post"]), "Fax" if i < 2000 else "Post") for i, t in want.items()]
    got = found(spark.createDataFrame(clean + bad, "row_id long, t string, src string"))
    assert not any(i < 1000 for i in got)
    right = sum(i in got and got[i].restored == t for i, t in want.items())
    assert right >= 0.8 * len(want)
    # what came out whole and is called complete is right
    assert all(r.restored == want[i] for i, r in got.items() if r.complete)


def test_too_many_sources_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_SOURCES", 2)
    df = spark.createDataFrame([(i, "café", f"s{i}") for i in range(5)], "row_id long, t string, src string")
    with pytest.raises(ValueError, match="sources"):
        repair_encoding(df, "row_id", "t", "src")

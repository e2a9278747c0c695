import random
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from corpuslab.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.DEFAULT_PATH).exists(), reason="no tokenizer file")


@pytest.fixture(scope="module")
def both():
    ref = Tokenizer.from_file(tokens.DEFAULT_PATH)
    ref.encode_special_tokens = True
    return tokens.load(), ref


def texts():
    rng = random.Random(2)
    out = ["", " ", "\n\n  x", "<|endoftext|> is text", "don't I'll we've", "1234567890" * 30, "中文 😡 İ ﬁ", "a" * 3000, " " * 500, "=-" * 700, "​﻿\x00"]
    out += ["".join(rng.choice("abcdefghij") for _ in range(400)) for _ in range(20)]
    out += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(200)) for _ in range(10)]
    return out


def test_ids_of_the_public_library(both):
    mine, ref = both
    for t in texts():
        assert mine.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_round_trip_and_chunks(both):
    mine, _ = both
    for t in texts():
        ids = mine.encode(t)
        assert "".join(mine.decode(ids)) == t
    raw = ("the cat's " * 900).replace(" ", "").encode()
    whole = list(mine.stream((raw,)))
    assert whole == list(mine.stream(raw[i : i + 7] for i in range(0, len(raw), 7)))


def test_seams_follow_the_merge_list(both):
    mine, _ = both
    rng = random.Random(8)
    ids = sorted(mine.bytes_of)
    short = [i for i in ids if len(mine.bytes_of[i]) <= 3]
    for _ in range(4000):
        a, b = rng.choice(short), rng.choice(rng.choice((ids, short)))
        want = mine.merged(mine.letters(a) + mine.letters(b)) == [a, b]
        assert mine._fits(a, b) == want
    for c in "aoe-= ":  # equal ranks at the seam
        some = [i for i in ids if set(mine.bytes_of[i]) == {ord(c)}]
        assert all(mine._fits(a, b) == (mine.merged(mine.letters(a) + mine.letters(b)) == [a, b]) for a in some for b in some)


def test_ascii_pieces_are_the_same(both):
    mine, _ = both
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice("ab Z09'strvml.-\t\n\r\x0b\x0c\x1c\x1f\x00_") for _ in range(80))
        assert mine.ascii.findall(t) == mine.pieces.findall(t) and "".join(mine.parts(t)) == t


def test_memory_of_a_long_text(both):
    import tracemalloc

    mine, ref = both
    text = "the bank's fee of 300 dollars was never explained to me, and I’ve waited since May. " * 60_000  # 5 MB, above LISTED
    mine.encode(text[:1000])
    tracemalloc.start()
    ids = mine.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * ids.nbytes + (4 << 20)
    assert ids[:500].tolist() == ref.encode(text[:5000], add_special_tokens=False).ids[:500]


def test_other_tokenizers_are_refused_or_read():
    import json

    spec = json.loads(Path(tokens.DEFAULT_PATH).read_text())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"end_of_word_suffix": "</w>"}}):
        with pytest.raises(ValueError):
            tokens._build(json.dumps(spec | change).encode())
    pattern = r"\p{L}+|\p{N}{1,3}|\s+"
    other = spec | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
    mine, ref = tokens._build(json.dumps(other).encode()), Tokenizer.from_str(json.dumps(other))
    for t in ("ab12345 -- ü?!x", "don't\n\n4711"):
        assert mine.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_stream_keeps_little(both):
    mine, _ = both
    seen = 0
    gen = mine.stream(b"antidisestablishment" for _ in range(2000))
    for _ in range(50):
        next(gen)
        seen += 1
    assert seen == 50  # ids come before the input ends


def test_corpus(spark, both, data):
    _, ref = both
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "hello world", 2), (None, "x", 3), (3, "hello world", 2)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df, "doc_id", "text").collect()), key=str)
    hello = ref.encode("hello world").ids
    assert got == sorted([(1, []), (2, []), (3, hello), (None, ref.encode("x").ids), (3, hello)], key=str)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    d = spark.read.parquet(f"{data}/documents.parquet")
    enc = tokens.encode_corpus(d, "doc_id", "text")
    back = {r.doc_id: r.text for r in tokens.decode_corpus(enc, "doc_id", "ids").collect()}
    assert back == {r.doc_id: r.text or "" for r in d.collect()}

import pytest

from corpuslab.operators import wordpiece
from corpuslab.operators.vocab import SequenceEstimator

PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "bank", "un", "##aff", "##able", "##s", "fee", ",", "'", "t", "don", "!", "cafe", "中", "-", "a", "##b"]
TEXTS = ["The bank's unaffable fees, don't!", "CAFÉ 中中 the-fee", "", None, "xyz unaffxable", "a" * 101, "ab\tbank\n\u200b the\ufffd", "unaffables bank " * 30]


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    p = tmp_path_factory.mktemp("wp") / "vocab.txt"
    p.write_text("\n".join(PIECES) + "\n")
    return str(p)


def test_pieces_of_the_public_library(spark, vocabulary):
    from tokenizers.implementations import BertWordPieceTokenizer

    ref = BertWordPieceTokenizer(vocabulary, lowercase=True)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    want = {i: ref.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.k: r.pieces for r in wordpiece.piece_lengths(df, "k", "t", vocabulary).collect()} == {i: len(x) for i, x in want.items()}
    got = {r.k: r for r in wordpiece.encode_pieces(df, "k", "t", vocabulary, 8).collect()}
    for i, x in want.items():
        ids = [2, *x[:6], 3]
        assert got[i].input_ids == ids + [0] * (8 - len(ids)) and got[i].attention_mask == [1] * len(ids) + [0] * (8 - len(ids))
    with pytest.raises(ValueError):
        wordpiece.encode_pieces(df, "k", "t", vocabulary, 1)


def test_estimator_learns_from_training_rows_alone(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([(0, "a a b", "train"), (1, "gamma a", "test")], "k long, t string, split string")
    e = SequenceEstimator("k", "t", "seq", split_col="split")
    with pytest.raises(ValueError, match="training"):
        e.fit(df)
    fitted = Pipeline(stages=[e]).fit(df.filter("split = 'train'"))
    assert {r.k: r.seq for r in fitted.transform(df).collect()} == {0: [2, 2, 3], 1: [1, 2]}

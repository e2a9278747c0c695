"""WordPiece ids and lengths by a given vocabulary, as transformers with word pieces read text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of special pieces, and the letters beyond which a word is unknown.
PAD, UNKNOWN, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
LONGEST = 100
#: A vocabulary file larger than this isn't broadcast.
MAX_FILE = 16 << 20


def _is_mark(c: str) -> bool:
    """Whether a character is a word of its own: punctuation, the other signs of ASCII, and ideographs."""
    o = ord(c)
    signs = 33 <= o <= 47 or 58 <= o <= 64 or 91 <= o <= 96 or 123 <= o <= 126
    han = 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0x20000 <= o <= 0x2CEAF or 0xF900 <= o <= 0xFAFF or 0x2F800 <= o <= 0x2FA1F
    return signs or han or unicodedata.category(c).startswith("P")


def basic_words(text: str, lower: bool = True) -> list[str]:
    """Words between white space and marks, without control characters and, in lower case, without accents."""
    text = "".join(" " if c in "\t\n\r" else c for c in text if c in "\t\n\r" or not (c in "\0\ufffd" or unicodedata.category(c)[0] == "C"))
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    out: list[str] = []
    for word in text.split():
        at = 0
        for i, c in enumerate(word):
            if _is_mark(c):
                out += [w for w in (word[at:i], c) if w]
                at = i + 1
        if at < len(word):
            out.append(word[at:])
    return out


class WordPiece:
    """The longest piece first, from the left; a word with a part that has no piece is unknown."""

    def __init__(self, pieces: list[str], lower: bool = True):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.lower, self.unknown = lower, self.ids[UNKNOWN]
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[w] = self._split(w)
        return got

    def _split(self, w: str) -> tuple[int, ...]:
        out, at = [], 0
        while at < len(w) <= LONGEST:
            end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in self.ids), None)
            if end is None:
                return (self.unknown,)
            out.append(self.ids[("##" if at else "") + w[at:end]])
            at = end
        return tuple(out) if len(w) <= LONGEST else (self.unknown,)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special pieces."""
        return [i for w in basic_words(text or "", self.lower) for i in self.word(w)]


def _shared(df: DataFrame, path: str):
    if (size := Path(path).stat().st_size) > MAX_FILE:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_FILE} are broadcast")
    return df.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8").splitlines())


def _apply(df: DataFrame, key: str, text: str, path: str, lower: bool, schema: str, make) -> DataFrame:
    shared = _shared(df, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = WordPiece(shared.value, lower)
        for b in batches:
            yield make(w, b.column(0), [w.encode(t) for t in b.column(1).to_pylist()])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(work, schema).withColumnRenamed("id", key)


def piece_lengths(df: DataFrame, key: str, text: str, path: str, lower: bool = True) -> DataFrame:
    """``(key, pieces)``: word pieces of each text, without special ones; 0 for a null text."""
    make = lambda w, ids, rows: pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in rows], pa.int32())], names=["id", "pieces"])
    return _apply(df, key, text, path, lower, "id long, pieces int", make)


def encode_pieces(df: DataFrame, key: str, text: str, path: str, max_len: int, lower: bool = True) -> DataFrame:
    """``(key, input_ids, attention_mask)``, both of length ``max_len``: first and last a special piece, texts cut to fit, the rest padded."""

    def make(w: WordPiece, ids: pa.Array, rows: list[list[int]]) -> pa.RecordBatch:
        a = np.full((len(rows), max_len), w.ids[PAD], np.int32)
        m = np.zeros((len(rows), max_len), np.int32)
        for k, r in enumerate(rows):
            r = [w.ids[CLS], *r[: max_len - 2], w.ids[SEP]]
            a[k, : len(r)], m[k, : len(r)] = r, 1
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * max_len)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(a.ravel())), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], names=["id", "input_ids", "attention_mask"])

    if max_len < 2:
        raise ValueError("max_len must hold two special pieces")
    return _apply(df, key, text, path, lower, "id long, input_ids array<int>, attention_mask array<int>", make)

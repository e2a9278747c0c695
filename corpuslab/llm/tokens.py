"""Token ids of a public byte-level BPE tokenizer, by a streaming transducer, and text from token ids.

The split into pieces is the tokenizer's own pattern, read from its file; a file that asks for more than such a split, bytes
and merges is refused. Within a piece the transducer reads bytes one by one and knows for
each position the last token of the encoding that ends there: the longest token that ends there and is compatible
with the last token before it, which is the case if the two, merged together from bytes, stay apart. Every encoding of
a longer input passes through one of the last positions, at most the longest token's length back. So the tokens on
which all of these agree can't change any more, and are emitted; only positions after them are kept. That bound is
the sufficient lookahead of the merge list (``Transducer.lookahead``).

Pieces come one by one from the text, and a long piece goes to the transducer in chunks, so what is held besides a text are its ids. A
piece that a task meets again is looked up.

Defined cases: a null, or empty text has an empty list of ids. Text that looks like a special token is ordinary
text. Blank text is encoded like any other.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pattern that parts text into pieces for this family of tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone.
PIECES_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\v\f\rA-Za-z0-9]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]+"
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: A tokenizer file larger than this isn't sent to the executors.
MAX_FILE = 64 << 20
CACHE = 200_000
CACHED_BYTES = 48
#: Bytes of a long piece that the transducer gets at once, and characters of a text whose pieces are listed at once.
CHUNK = 1 << 16
LISTED = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letters by which vocabulary files of byte-level BPE write bytes: printable Latin-1 bytes as
    themselves, the others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of pieces, encoded when they are first met."""

    def __init__(self, encode: Callable[[bytes], tuple[int, ...]]):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = self.encode(raw)
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Transducer:
    """Incremental encoder over bytes."""

    def __init__(self, vocab: dict[str, int], merges: list, pattern: str = PIECES):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        #: Of each token that is made by merging: the rank of the first merge that makes it, and its parts.
        self.made: dict[int, tuple[int, int, int]] = {}
        for i, (a, b) in enumerate(pairs):
            self.made.setdefault(vocab[a + b], (i, vocab[a], vocab[b]))
        self.single = {raw(c): i for c, i in vocab.items() if len(c) == 1 and c in letters}
        self.bytes_of = {i: raw(s) for s, i in vocab.items() if i in self.made or len(s) == 1 and s in letters}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.suffixes = {b[k:] for b in self.id_of for k in range(len(b))}
        self.lookahead = max(map(len, self.id_of))
        self.pieces = regex.compile(pattern)
        self.ascii = re.compile(PIECES_ASCII) if pattern == PIECES else self.pieces
        self.known = _Known(lambda raw: tuple(self.stream(raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK))))
        self.whole = functools.lru_cache(1 << 18)(self._whole)
        self.fits = functools.lru_cache(1 << 20)(self._fits)

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merge list to a short sequence."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            p = (ids[best[1]], ids[best[1] + 1])
            new, out, k = self.rank[p][1], [], 0
            while k < len(ids):  # all places of the pair, from the left
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == p:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def letters(self, a: int) -> list[int]:
        """The tokens of a token's single bytes."""
        x = self.bytes_of[a]
        return [self.single[x[k : k + 1]] for k in range(len(x))]

    def _whole(self, a: int) -> bool:
        """Whether a token's bytes are encoded as that token, which merges of other tools need not grant."""
        return self.merged(self.letters(a)) == [a]

    def _fits(self, a: int, b: int) -> bool:
        """Whether b can follow a in an encoding: no merge joins what is left of both at the seam while they are put together.
        Merges are undone from the last: of the two parts at the seam the one made later is taken apart. A merge over the seam
        would have come first if it ranks below that one; of equal ranks the leftmost comes first."""
        if not self.whole(a) or not self.whole(b):
            return False
        rank, made, before = self.rank, self.made, len(self.rank) + 1
        while True:
            over = rank.get((a, b))
            if over is not None and over[0] < before:
                return False
            x, y = made.get(a), made.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[0] > y[0]:
                before, a = x[0], x[2]
            else:
                before, b = y[0] + 1, y[1]

    def last_token(self, window: bytes, before: list[int]) -> int:
        """The token that ends the encoding of the window, the longest compatible one; before[k]: that of what precedes its byte k
        (-1: nothing)."""
        n, suffixes, id_of, fits = len(window), self.suffixes, self.id_of, self.fits
        k = 1
        while k <= n and window[n - k :] in suffixes:
            k += 1
        for i in range(n - k + 1, n):
            t = id_of.get(window[i:])
            if t is not None:
                a = before[i]
                if a == -1 and self.whole(t) or a >= 0 and fits(a, t):
                    return t
        raise ValueError("the vocabulary lacks a byte")

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece whose bytes arrive in chunks. Keeps no more than the bytes not yet stable."""
        window, last = b"", [-1]
        for chunk in data:
            for k in range(len(chunk)):
                window += chunk[k : k + 1]
                near = min(len(window), self.lookahead)
                last.append(self.last_token(window[-near:], last[-near:]))
                if len(window) >= 4 * self.lookahead:
                    at = self._agreed(last)
                    if at:
                        yield from self._path(last, at)
                        window, last = window[at:], last[at:]
        yield from self._path(last, len(window))

    def _agreed(self, last: list[int]) -> int:
        """The last position through which the encodings of all inputs that go on from here pass."""
        open_ = set(range(max(0, len(last) - self.lookahead), len(last)))
        while len(open_) > 1:
            p = max(open_)
            open_.discard(p)
            open_.add(p - len(self.bytes_of[last[p]]) if p else 0)
        return open_.pop()

    def _path(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def parts(self, text: str) -> Iterable[str]:
        p = self.ascii if text.isascii() else self.pieces
        return p.findall(text) if len(text) <= LISTED else (m.group() for m in p.finditer(text))

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, self.parts(text or ""))), np.int32)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, by an incremental UTF-8 state machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := machine.decode(self.bytes_of[i]):
                yield s
        if s := machine.decode(b"", True):
            yield s


def _pattern(spec: dict) -> str:
    """The pattern that a tokenizer file splits texts by; anything else that it asks for is an error."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = pre.get("pretokenizers", []) if pre.get("type") == "Sequence" else [pre]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if spec.get("normalizer") or odd or model.get("type", "BPE") != "BPE" or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
        raise ValueError(f"the tokenizer is not plain byte-level BPE: {odd or spec.get('normalizer') or pre}")
    if len(steps) == 1 and steps[0].get("use_regex", True):
        return PIECES
    split = steps[0]
    if len(steps) == 2 and split.get("type") == "Split" and split.get("behavior") == "Isolated" and not split.get("invert") and "Regex" in split["pattern"] and not steps[1].get("use_regex", True):
        # what the pattern leaves out is a piece as well
        return f"{split['pattern']['Regex']}|(?:(?!{split['pattern']['Regex']})(?s:.))+"
    raise ValueError(f"unknown split into pieces: {pre}")


@functools.lru_cache(2)
def _build(raw: bytes) -> Transducer:
    spec = json.loads(raw)
    return Transducer(spec["model"]["vocab"], spec["model"]["merges"], _pattern(spec))


def load(path: str = DEFAULT_PATH) -> Transducer:
    return _build(Path(path).read_bytes())


def _shared(df: DataFrame, path: str):
    raw = Path(path).read_bytes()
    if len(raw) > MAX_FILE:
        raise ValueError(f"{path} has {len(raw)} bytes; at most {MAX_FILE} are broadcast")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_PATH) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row, in one pass without a shuffle."""
    shared = _shared(docs, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _build(shared.value)
        for b in batches:
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return plain.mapInArrow(work, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_corpus(encoded: DataFrame, id_col: str, ids_col: str, path: str = DEFAULT_PATH) -> DataFrame:
    """``(id_col, text)``: the inverse of ``encode_corpus``; null ids give a null text."""
    shared = _shared(encoded, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _build(shared.value)
        for b in batches:
            text = [None if x is None else "".join(t.decode(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["id", "text"])

    plain = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return plain.mapInArrow(work, "id long, text string").withColumnRenamed("id", id_col)

"""Vectorised hashing of words and character windows over a whole batch of texts."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: Bases of the two families of hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Texts are hashed in groups of about this many characters, so that memory does not grow with the batch.
GROUP_CHARS = 1 << 20


def code_point_range() -> np.ndarray:
    """Every code point as a string of one character."""
    return np.arange(0x110000, dtype=np.uint32).view("<U1")


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter or digit, and its lower case (a code point with several is kept apart)."""
    c = code_point_range()
    word, lower = np.strings.isalnum(c), np.arange(len(c), dtype=np.uint32)
    word[0xD800:0xE000] = False  # surrogates
    at = np.flatnonzero(word)
    v = np.strings.lower(c[at].astype("<U3"))
    one = np.strings.str_len(v) == 1
    lower[at[one]] = np.ascontiguousarray(v[one].astype("<U1")).view(np.uint32)
    return word, lower


@functools.lru_cache(4)
def _powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = U(BASES[family]), U(pow(BASES[family], -1, 1 << 64))
    up, down = np.empty(n, U), np.empty(n, U)
    up[0] = down[0] = U(1)
    with np.errstate(over="ignore"):
        k = 1
        while k < n:
            m = min(k, n - k)
            up[k : k + m] = up[:m] * (up[k - 1] * base)
            down[k : k + m] = down[:m] * (down[k - 1] * inverse)
            k += m
    return up, down


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    size = max(GROUP_CHARS * 2, 1 << int(n).bit_length())
    a, b = _powers(size, family)
    return a[:n], b[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def groups(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with about GROUP_CHARS characters together, at least one row each."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > GROUP_CHARS:
            out.append((start, i))
            start, total = i, 0
        total += int(n) + 1
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, each text followed by a NUL, and where each text begins."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return cp, starts


def prefix_hash(values: np.ndarray, family: int = 0) -> np.ndarray:
    """P with (P[j] - P[i]) / base**i the hash of values[i:j], one longer than values. The families differ in base and in how
    values are scrambled."""
    up, _ = powers(len(values) + 1, family)
    p = np.zeros(len(values) + 1, U)
    np.cumsum(mix(values.astype(U) + U(1 + 0x5851F42D4C957F2C * family)) * up[: len(values)], out=p[1:])
    return p


def range_hash(p: np.ndarray, i: np.ndarray, j: np.ndarray, family: int = 0) -> np.ndarray:
    _, down = powers(len(p), family)
    return mix((p[j] - p[i]) * down[i])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each text and the total): every word of the texts, a longest run of letters
    and digits in lower case; start and end are positions in its text."""
    with np.errstate(over="ignore"):
        cp, starts = code_points(texts)
        word, lower = _tables()
        w = word[cp]
        edge = np.flatnonzero(np.diff(w.view(np.int8), prepend=np.int8(0)))
        a, b = edge[0::2], edge[1::2]  # a NUL ends every text, so every word is closed
        h = range_hash(prefix_hash(lower[cp]), a, b) if len(a) else np.empty(0, U)
        first = np.searchsorted(a, starts)
        base = np.repeat(starts[:-1], np.diff(first))
        return h, a - base, b - base, first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first shingle of each text and the total) of k consecutive words, in order and with repetitions."""
    n = np.diff(first)
    count = np.maximum(n - (k - 1), 0)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(first[:-1] - off[:-1], count)
    with np.errstate(over="ignore"):
        s = np.zeros(len(at), U)
        m = U(0xD6E8FEB86659FD93)
        for i in range(k):
            s = (s ^ h[at + i]) * m
            s ^= s >> U(32)
    return s, off

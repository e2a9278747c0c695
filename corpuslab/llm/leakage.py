"""Evaluation passages in a training corpus, verbatim or re-parameterised.

Words are canonicalised into templates: numbers, names and units become typed placeholders. Windows of ``k`` canonical words
of the items and the corpus are joined by hash, and each hit is settled by its slots. Equal slots are a verbatim
passage; slots that can be mapped one to one, item to document, are the same question with other parameters. What a word
becomes in its strict template depends on the lower-cased word alone, so a verbatim passage always has its item's template.
Units are typed by dimension: those of measure follow by rule from base units, SI prefixes and the calendar, and things that are
counted are learned, as words that stand after a number in at least half of their places in the items.
Windows are also read with capitalised words as names, so that names the items don't have count as names: those that stand
within a sentence, all of them, and of the corpus those that no item has. The first two are read so on both sides, as a
capitalised word that starts a sentence would otherwise be a name on one side only.

At least half the words of a template are literal. A window with more slots says too little, so it is keyed by its own words
and found verbatim only; number tables and runs of redactions therefore share no key.

Defined cases: null and short texts (fewer than ``k`` words) match nothing. Repeated rows count once. Items that overlap
are each reported.
"""

from __future__ import annotations

import calendar
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import bitmap, wordhash
from corpuslab.llm.wordhash import U
from corpuslab.operators.joins import salted, text_bytes
from corpuslab.session import Stage

#: Item windows up to this size, as text, are broadcast to the join; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Distinct words of the items, which are collected; more is an error.
MAX_WORDS = 8_000_000
NUMBER, NAME, COUNTED = 1, 2, 3
TIME, MONEY, LENGTH, MASS, VOLUME, DATA, SHARE, MONTH, WEEKDAY = range(4, 13)
#: Places after a number that make a word of the items a counted thing, if they are half of its places too.
COUNTED_PLACES = 2


def units() -> dict[str, int]:
    """Words of measure and their dimension: base units with SI prefixes and plurals, months and weekdays of the calendar."""
    prefixes = ("", "nano", "micro", "milli", "centi", "deci", "kilo", "mega", "giga", "tera")
    scaled = {LENGTH: ("metre", "meter"), MASS: ("gram", "gramme"), VOLUME: ("litre", "liter"), DATA: ("byte", "bit")}
    plain = {
        TIME: "second minute hour day week fortnight month quarter year decade century sec min hr",
        MONEY: "dollar euro pound cent penny yen franc peso usd eur gbp jpy chf",
        LENGTH: "mile yard foot inch km cm mm",
        MASS: "tonne ton ounce lb kg mg",
        VOLUME: "gallon pint quart ml",
        DATA: "kb mb gb tb",
        SHARE: "percent percentage pct bps",
    }
    out = {x: k for k, names in plain.items() for x in names.split()}
    out |= {p + x: k for k, names in scaled.items() for x in names for p in prefixes}
    out |= {x[:-1] + "ies" if x[-1] == "y" and x[-2] not in "aeiou" else x + "es" if x.endswith(("ch", "s")) else x + "s": k for x, k in out.items()}
    out |= {"feet": LENGTH, "pence": MONEY}
    out |= {x.lower(): MONTH for x in calendar.month_name if x} | {x.lower(): WEEKDAY for x in calendar.day_name}
    return out


@functools.lru_cache(1)
def _unit_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of measure, sorted, and their dimensions."""
    of = units()
    h = wordhash.words(list(of))[0]
    order = np.argsort(h)
    return h[order], np.fromiter(of.values(), np.int8)[order]


@functools.lru_cache(1)
def _traits() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a digit, or upper case."""
    c = wordhash.code_point_range()
    digit, upper = np.strings.isdigit(c), np.strings.isupper(c)
    digit[0xD800:0xE000] = upper[0xD800:0xE000] = False
    return digit, upper


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def _inner(cp: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the words at ``at``, in texts that begin at ``start``, stand within a sentence."""
    ends = [ord(c) for c in ".!?:\n“\""]
    out = at > start
    for n in (1, 2):
        out &= ~((at - n >= start) & np.isin(cp[np.maximum(at - n, 0)], ends))
    return out


class Lexicon(NamedTuple):
    """Sorted hashes of words: names, counted things, and all words of the items."""

    names: np.ndarray
    counted: np.ndarray
    known: np.ndarray


NO_WORDS = Lexicon(*[np.empty(0, U)] * 3)


def classify(texts: list[str], lex: Lexicon) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(hash, readings, start, end, first word of each text) of the words of the texts. A reading has each word's class: by
    the word alone; capitalised words as names where they stand within a sentence; wherever they stand; where they are no
    words of the items, as are words after a number then taken as counted things."""
    h, a, b, first = wordhash.words(texts)
    cp, starts = wordhash.code_points(texts)
    base = np.repeat(starts[:-1], np.diff(first))
    digit, upper = _traits()
    d = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(digit[cp], out=d[1:])
    strict = np.zeros(len(h), np.int8)
    strict[_in(lex.counted, h)] = COUNTED
    strict[_in(lex.names, h)] = NAME
    unit, dimension = _unit_hashes()
    at = np.minimum(np.searchsorted(unit, h), len(unit) - 1)
    strict = np.where(unit[at] == h, dimension[at], strict)
    strict[d[b + base] - d[a + base] > 0] = NUMBER
    # redactions such as XXXX stand for a value
    x = np.zeros(len(cp) + 1, np.int64)
    np.cumsum((cp == 88) | (cp == 120), out=x[1:])
    strict[(x[b + base] - x[a + base] == b - a) & (b - a > 1)] = NUMBER
    cap = (strict == 0) & upper[cp[a + base]]
    new = ~_in(lex.known, h)
    last = np.where(cap & new, np.int8(NAME), strict)
    last[(last == 0) & new & _after_number(strict, first)] = COUNTED
    return h, [strict, *(np.where(cap & x, np.int8(NAME), strict) for x in (_inner(cp, a + base, base), True)), last], a, b, first


def _after_number(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(kind), bool)
    out[1:] = kind[:-1] == NUMBER
    out[first[:-1][first[:-1] < len(kind)]] = False
    return out


def _windows(h: np.ndarray, kind: np.ndarray, first: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, first window of each text and the total, whether half the words are literal) of each window;
    without enough literal words the hash is ``own``, that of the words themselves."""
    with np.errstate(over="ignore"):
        canon = np.where(kind > 0, wordhash.mix(kind.astype(U)), h)
        t, off = wordhash.shingles(canon, first, k)
        slots = np.zeros(len(h) + 1, np.int64)
        np.cumsum(kind > 0, out=slots[1:])
        at = np.arange(len(t)) + np.repeat(first[:-1] - off[:-1], np.diff(off))
        literal = 2 * (slots[at + k] - slots[at]) <= k
        return np.where(literal, t, own), off, literal


_WIN = "id long, t long, s long, slots array<string>, kinds array<byte>"


def _scan(k: int, lex: Lexicon, bits: tuple[np.ndarray, int] | None):
    """Windows of a table of texts in each reading, ``s`` the strict template's hash; with ``bits`` only those whose template
    may be an item's. Readings other than the strict one only count with enough literal words. A window that repeats within
    a text comes once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in wordhash.groups(np.fromiter(map(len, all_texts), np.int64, len(all_texts))):
                ids, texts = all_ids[lo:hi], all_texts[lo:hi]
                h, readings, a, b, first = classify(texts, lex)
                rows, seen = {}, []
                with np.errstate(over="ignore"):
                    own = wordhash.mix(wordhash.shingles(h, first, k)[0])
                for kind in readings:
                    t, off, literal = _windows(h, kind, first, own, k)
                    at = np.arange(len(t)) + np.repeat(first[:-1] - off[:-1], np.diff(off))
                    keep = literal if seen else np.full(len(t), True)
                    if bits is not None:
                        keep = keep & bitmap.hit(bits[0], t & U((1 << bits[1]) - 1))
                    for other in seen:
                        keep = keep & (t != other)
                    seen.append(t)
                    pos = np.flatnonzero(keep)
                    text = np.searchsorted(off, pos, side="right") - 1
                    for i, p, x, y in zip(text, at[pos], t[pos].view(np.int64), seen[0][pos].view(np.int64)):
                        rows[ids[i], int(x), int(y), tuple(texts[i][a[q] : b[q]].lower() for q in range(p, p + k)), tuple(map(int, kind[p : p + k]))] = None
                rows = list(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8())))],
                    names=["id", "t", "s", "slots", "kinds"],
                )

    return work


_PLACES = "h long, cap long, low long, after long, n long"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word: how often it stands capitalised within a sentence, how often otherwise, after a number, and at all."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        h, (strict, inner, loose, _), *_, first = classify(texts, NO_WORDS)
        cols = (inner == NAME, loose != NAME, (strict == 0) & _after_number(strict, first), np.ones(len(h)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols)], names=["h", "cap", "low", "after", "n"])


def _bits_of(windows: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Bitmap over the low bits of the template hashes. A window that passes by chance costs its words, hence 256 bits or more each."""
    bits = min(bitmap.MAX_BITS, max(bitmap.MIN_BITS, (256 * max(count, 1)).bit_length()))
    got = windows.select(F.col("t").bitwiseAND(F.lit((1 << bits) - 1)).alias("p")).distinct().select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def _lexicon(items: DataFrame) -> Lexicon:
    n = items.select("text").mapInArrow(_places, _PLACES).groupBy("h").agg(*[F.sum(c).alias(c) for c in ("cap", "low", "after", "n")])
    got = n.select("h", F.expr("cap > 0 and low = 0").alias("name"), F.expr(f"after >= {COUNTED_PLACES} and 2 * after >= n and cap = 0").alias("counted")).limit(MAX_WORDS + 1).toPandas()
    if len(got) > MAX_WORDS:
        raise ValueError(f"items have more than {MAX_WORDS} distinct words")
    return Lexicon(*(np.sort(x["h"].to_numpy(np.int64).view(U)) for x in (got[got["name"]], got[got["counted"]], got)))


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, k: int = 13) -> DataFrame:
    """``(doc_id, item_id, kind, windows)``: each document and item that share a passage of ``k`` or more consecutive words,
    kind ``verbatim``, or else one of their templates with consistent slots, kind ``template``; with the number of
    item windows found. A window that several items have alike is compared once, and its items join the result."""
    stage = Stage(docs.sparkSession, "leakage")
    it = items.filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    lex = _lexicon(it)
    own = stage.put(it.mapInArrow(_scan(k, lex, None), _WIN).distinct(), "items")
    count = own.count()
    bits = _bits_of(own, count)
    d = docs.filter(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text"))
    seen = d.mapInArrow(_scan(k, lex, bits), _WIN).select(F.col("id").alias("doc"), "t", F.col("slots").alias("ds"), F.col("kinds").alias("dk"))
    right = own.select("t", "s", F.col("slots").alias("is"), F.col("kinds").alias("ik")).distinct()
    member = own.select("t", "s", F.col("slots").alias("is"), F.col("kinds").alias("ik"), F.col("id").alias("item"))
    few = text_bytes(own) <= BROADCAST_BYTES
    if few:
        met = seen.join(F.broadcast(right), "t")
    else:
        seen = stage.put(seen, "seen")
        per = seen.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        met = salted(seen, right, ["t"], per, "n", seen.count(), F.col("doc"))
    # the fixed words of both are equal, kinds of slots as well, and slots map one to one
    pairs = F.arrays_zip("ik", "dk", "is", "ds")
    fits = F.forall(pairs, lambda p: (p["ik"] == p["dk"]) & ((p["ik"] > 0) | (p["is"] == p["ds"])))
    literal = 2 * F.size(F.filter("ik", lambda x: x > 0)) <= k
    slot = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["ik"] > 0), lambda p: F.struct(p["is"].alias("a"), p["ds"].alias("b"))))
    one_to_one = (F.size(F.array_distinct(F.transform(slot, lambda p: p["a"]))) == F.size(slot)) & (F.size(F.array_distinct(F.transform(slot, lambda p: p["b"]))) == F.size(slot))
    judged = met.withColumn("v", F.col("is") == F.col("ds")).filter(F.col("v") | (literal & fits & one_to_one))
    # of a document's readings of one item window the best
    judged = judged.groupBy("doc", "t", "s", "is", "ik").agg(F.max("v").alias("v"))
    on = ["t", "s", "is", "ik"]
    if few:
        found = judged.join(F.broadcast(member), on)
    else:
        judged = stage.put(judged, "judged")
        found = salted(judged, member, on, judged.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), "n", judged.count(), F.col("doc"))
    found = found.groupBy("doc", "item").agg(F.max("v").alias("v"), F.count_distinct("s").alias("windows"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.when(F.col("v"), "verbatim").otherwise("template").alias("kind"), "windows")

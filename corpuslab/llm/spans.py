"""Long spans that stand letter for letter in more than one document.

A document's windows of ``span`` characters are cut into super-k-mers: runs of consecutive windows that share a minimiser, the
least hash among the window's short grams. A super-k-mer travels as one packed string to its minimiser's bucket, and
equal windows always meet in one bucket. There its windows' 128-bit hashes are sorted, and windows of two or more documents are
marked. Marked windows come back as intervals, which are merged per document.

Before any text moves, minimisers are counted with map-side combine: a minimiser that occurs in one document alone is
dropped by a bitmap in the scan. A bucket has at most HOT super-k-mers, of less than two spans each, whatever the size of the corpus.
Minimisers with more, such as those of a footer that a third of all documents bear, are not gathered: a second bitmap names them,
and their windows are counted by a plain aggregation with map-side combine. Others that the bitmap takes for them by chance go the
same way, which gives the same result.

Defined cases: null texts and texts shorter than ``span`` have no shared characters. Repetitions within one document don't
count; rows with one document id are one document. Exact copies are shared as a whole, and equal texts of a batch
go to the buckets once. Positions count code points from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import bitmap, wordhash
from corpuslab.llm.wordhash import U
from corpuslab.operators.joins import lookup
from corpuslab.session import Stage

#: Characters of the grams among which the minimiser is chosen.
GRAM = 64
#: A bucket of more super-k-mers is counted by windows instead.
HOT = 20_000
#: Characters handled at once in a bucket task.
CHUNK = 2_000_000
#: Shared windows of hot buckets up to this number (16 MB) are broadcast; beyond it they are joined.
BROADCAST_WINDOWS = 1_000_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values (van Herk)."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, ~U(0), U)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def super_kmers(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimiser, first window, windows) of each super-k-mer of the texts."""
    gram = min(GRAM, span)
    with np.errstate(over="ignore"):
        cp, starts = wordhash.code_points(texts)
        n = np.diff(starts) - 1
        p = wordhash.prefix_hash(cp)
        at = np.arange(max(len(cp) - gram + 1, 0))
        g = wordhash.range_hash(p, at, at + gram)
        if len(cp) < span:
            e = np.empty(0, np.int64)
            return e, e.astype(U), e, e
        m = _sliding_min(g, span - gram + 1)  # minimiser of the window at each position of the whole group
    count = np.maximum(n - span + 1, 0)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=off[1:])
    text = np.repeat(np.arange(len(n)), count)
    pos = np.arange(off[-1]) - off[:-1][text]
    mine = m[starts[:-1][text] + pos]
    new = np.ones(len(mine), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(mine)))
    return text[first], mine[first], pos[first], runs


def _window_hashes(texts: list[str], span: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of packed strings, of which string k has runs[k] windows, and its string."""
    with np.errstate(over="ignore"):
        cp, starts = wordhash.code_points(texts)
        off = np.zeros(len(runs) + 1, np.int64)
        np.cumsum(runs, out=off[1:])
        which = np.repeat(np.arange(len(runs)), runs)
        at = starts[:-1][which] + np.arange(off[-1]) - off[:-1][which]
        a = wordhash.range_hash(wordhash.prefix_hash(cp), at, at + span)
        b = wordhash.range_hash(wordhash.prefix_hash(cp, 1), at, at + span, 1)
    return a, b, which


def _heads(ids: np.ndarray, texts: list[str]) -> np.ndarray:
    """Of each text the index of the first equal one in the batch."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(t, i) for i, t in enumerate(texts)), np.int64, len(texts))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    for lo, hi in wordhash.groups(np.fromiter(map(len, texts), np.int64, len(texts))):
        yield ids[lo:hi], texts[lo:hi]


def _count(span: int):
    """Per minimiser of a batch: smallest and largest document over all texts, equal ones too, and super-k-mers of different texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _groups(batch):
                head, back = np.unique(_heads(ids, texts), return_inverse=True)
                text, mini, _, _ = super_kmers([texts[i] for i in head], span)
                lo, hi = ids[head].copy(), ids[head].copy()
                np.minimum.at(lo, back, ids)
                np.maximum.at(hi, back, ids)
                order = np.argsort(mini, kind="stable")
                mini, text = mini[order], text[order]
                new = np.flatnonzero(np.append(True, mini[1:] != mini[:-1])) if len(mini) else np.empty(0, np.int64)
                lo, hi = (np.minimum.reduceat(lo[text], new), np.maximum.reduceat(hi[text], new)) if len(new) else (lo[:0], hi[:0])
                yield pa.RecordBatch.from_arrays([pa.array(mini[new].view(np.int64)), pa.array(lo), pa.array(hi), pa.array(np.diff(np.append(new, len(mini))).astype(np.int64))], names=["m", "lo", "hi", "n"])

    return work


def _among(bits: tuple[np.ndarray, int], x: np.ndarray) -> np.ndarray:
    return bitmap.hit(bits[0], x & U((1 << bits[1]) - 1))


_PACKED = "m long, doc long, start long, runs long, s string"


def _pack(span: int, bits: tuple[np.ndarray, int], hot: tuple[np.ndarray, int]):
    """Super-k-mers whose minimiser may be shared; m is null for copies within the batch, which are shared whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _groups(batch):
                head = _heads(ids, texts)
                own = np.flatnonzero(head == np.arange(len(ids)))
                text, mini, first, runs = super_kmers([texts[i] for i in own], span)
                keep = _among(bits, mini) & ~_among(hot, mini)
                text, mini, first, runs = own[text[keep]] if len(own) else text[keep], mini[keep], first[keep], runs[keep]
                s = [texts[i][a : a + r - 1 + span] for i, a, r in zip(text, first, runs)]
                c = np.array([i for i in np.flatnonzero(head != np.arange(len(ids))) if len(texts[i]) >= span and ids[i] != ids[head[i]]], np.int64)
                whole = np.unique(np.concatenate([c, head[c]])) if len(c) else c
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([mini.view(np.int64), np.zeros(n, np.int64)]), mask=np.append(np.zeros(len(mini), bool), np.ones(n, bool))),
                        pa.array(np.concatenate([ids[text], ids[whole]])),
                        pa.array(np.concatenate([first, np.zeros(n, np.int64)])),
                        pa.array(np.concatenate([runs, np.array([len(texts[i]) - span + 1 for i in whole], np.int64)])),
                        pa.array(s + [None] * n, pa.string()),
                    ],
                    names=["m", "doc", "start", "runs", "s"],
                )

    return work


_FOUND = "doc long, a long, b long"


def _intervals(doc: np.ndarray, start: np.ndarray, which: np.ndarray, runs: np.ndarray, marked: np.ndarray, span: int) -> pa.RecordBatch:
    """Runs of marked windows as 0-based intervals [a, b) of characters."""
    off = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=off[1:])
    at = np.flatnonzero(marked)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (which[at[1:]] != which[at[:-1]])
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(at)) - 1
        k = which[at[i]]
        a, b = start[k] + at[i] - off[k], start[k] + at[j] - off[k] + span
        return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(a), pa.array(b)], names=["doc", "a", "b"])
    e = pa.array(np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays([e, e, e], names=["doc", "a", "b"])


def _bucket(span: int):
    """Super-k-mers sorted by minimiser: the windows that stand in two documents or more."""

    def settle(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        doc, start, runs = (t.column(i).to_numpy() for i in (1, 2, 3))
        whole = t.column(0).is_null().to_numpy(zero_copy_only=False)
        if whole.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[whole]), pa.array(start[whole]), pa.array(start[whole] + runs[whole] - 1 + span)], names=["doc", "a", "b"])
        texts = [x for x in t.column(4).to_pylist() if x is not None]
        doc, start, runs = doc[~whole], start[~whole], runs[~whole]
        if not len(texts):
            return
        a, b, which = _window_hashes(texts, span, runs)
        order = np.argsort(a)
        sa, sb, sd = a[order], b[order], doc[which[order]]
        if ((sa[1:] == sa[:-1]) & (sb[1:] != sb[:-1])).any():  # the first hash alone doesn't part them
            order = np.lexsort((b, a))
            sa, sb, sd = a[order], b[order], doc[which[order]]
        new = np.ones(len(sa), bool)
        new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(sd, first) != np.maximum.reduceat(sd, first)
        marked = np.zeros(len(sa), bool)
        marked[order] = np.repeat(several, np.diff(np.append(first, len(sa))))
        yield _intervals(doc, start, which, runs, marked, span)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(4).nbytes
            if size >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                m = t.column(0).fill_null(0).to_numpy()
                end = int(np.flatnonzero(m != m[-1])[-1]) + 1 if (m != m[-1]).any() else 0  # the last bucket may go on
                if end:
                    yield from settle(t.slice(0, end).to_batches())
                    held = t.slice(end).to_batches()
                    size = sum(x.column(4).nbytes for x in held)
        if held:
            yield from settle(held)

    return work


def _hot_windows(span: int, bits: tuple[np.ndarray, int], hot: tuple[np.ndarray, int], mode: str, shared: np.ndarray | tuple[np.ndarray, int] | None = None):
    """Windows of hot minimisers: ``count`` gives per batch each distinct one with its smallest and largest document and how often
    it stands there, ``mark`` gives the intervals of those in ``shared``, ``list`` those that a bitmap ``shared`` has, with their place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _groups(batch):
                text, mini, first, runs = super_kmers(texts, span)
                keep = _among(hot, mini) & _among(bits, mini)
                text, first, runs = text[keep], first[keep], runs[keep]
                s = [texts[i][x : x + r - 1 + span] for i, x, r in zip(text, first, runs)]
                doc = ids[text] if len(text) else np.empty(0, np.int64)
                a, b, which = _window_hashes(s, span, runs) if s else (np.empty(0, U), np.empty(0, U), np.empty(0, np.int64))
                if mode == "mark":
                    key = np.empty(len(a), [("a", U), ("b", U)])
                    key["a"], key["b"] = a, b
                    yield _intervals(doc, first, which, runs, np.isin(key, shared), span)
                elif mode == "list":
                    off = np.zeros(len(runs) + 1, np.int64)
                    np.cumsum(runs, out=off[1:])
                    place = first[which] + np.arange(len(a)) - off[which]
                    k = _among(shared, a)
                    yield pa.RecordBatch.from_arrays([pa.array(a[k].view(np.int64)), pa.array(b[k].view(np.int64)), pa.array(doc[which[k]]), pa.array(place[k])], names=["a", "b", "doc", "at"])
                else:
                    d = doc[which]
                    order = np.lexsort((d, b, a))
                    a, b, d = a[order], b[order], d[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    i = np.flatnonzero(new)
                    j = np.append(i[1:], len(a)) - 1 if len(i) else i
                    cols = (a[i].view(np.int64), b[i].view(np.int64), d[i], d[j], j - i + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["a", "b", "lo", "hi", "n"])

    return work


def _hot_spans(base: DataFrame, span: int, bits: tuple[np.ndarray, int], hot: tuple[np.ndarray, int], stage: Stage) -> DataFrame:
    n = base.mapInArrow(_hot_windows(span, bits, hot, "count"), "a long, b long, lo long, hi long, n long")
    n = n.groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    shared = stage.put(n.filter("lo <> hi").select("a", "b", "n"), "hot")
    count, places = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= BROADCAST_WINDOWS:
        got = shared.toPandas()
        key = np.empty(len(got), [("a", U), ("b", U)])
        key["a"], key["b"] = got["a"].to_numpy(np.int64).view(U), got["b"].to_numpy(np.int64).view(U)
        return base.mapInArrow(_hot_windows(span, bits, hot, "mark", np.sort(key)), _FOUND)
    every = base.mapInArrow(_hot_windows(span, bits, hot, "list", _bits(shared.select(F.col("a").alias("m")), count)), "a long, b long, doc long, at long")
    # windows that a large share of the places have are hot keys
    return lookup(every, shared, ["a", "b"], places, "n").select("doc", F.col("at").alias("a"), (F.col("at") + span).alias("b"))


def _bits(minis: DataFrame, count: int, each: int = 16) -> tuple[np.ndarray, int]:
    """Bitmap over the low bits of ``m``, with ``each`` bits or more per key up to 16 MB in all."""
    bits = min(bitmap.MAX_BITS, max(bitmap.MIN_BITS, (each * max(count, 1)).bit_length()))
    got = minis.select(F.col("m").bitwiseAND(F.lit((1 << bits) - 1)).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def shared_spans(docs: DataFrame, id_col: str, text_col: str, span: int = 240, hot_above: int = HOT) -> DataFrame:
    """``(doc_id, span_start, span_len)``: each longest run of characters that lie in a stretch of ``span`` characters
    which also stands in another document."""
    stage = Stage(docs.sparkSession, "spans")
    base = docs.filter((F.length(text_col) >= span) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
    minis = base.mapInArrow(_count(span), "m long, lo long, hi long, n long").groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    minis = stage.put(minis.filter("lo <> hi").select("m", "n"), "minimisers")
    total, many = minis.agg(F.count(F.lit(1)), F.count_if(F.col("n") > hot_above)).first()
    bits, hot = _bits(minis, total), _bits(minis.filter(F.col("n") > hot_above), many, 256)
    packed = base.mapInArrow(_pack(span, bits, hot), _PACKED)
    where = F.coalesce(F.col("m"), F.xxhash64("doc"))
    found = packed.repartition(where).sortWithinPartitions("m").mapInArrow(_bucket(span), _FOUND)
    if many:
        found = found.unionByName(_hot_spans(base, span, bits, hot, stage))
    found = stage.put(found, "intervals")
    stage.only(found)
    w = Window.partitionBy("doc").orderBy("a", "b")
    ends = found.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = ends.withColumn("run", F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(w))
    return runs.groupBy("doc", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(F.col("doc").alias("doc_id"), (F.col("a") + 1).alias("span_start"), (F.col("b") - F.col("a")).alias("span_len"))


def shared_share(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """``(doc_id, chars, shared_chars, share)`` of every document with text; share is null for an empty text."""
    s = spans.groupBy("doc_id").agg(F.sum("span_len").alias("shared_chars"))
    d = docs.filter(F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.length(text_col)).cast("long").alias("chars"))
    out = d.join(s, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return out.withColumn("share", F.try_divide(F.col("shared_chars"), F.col("chars")))

"""Near-duplicate records: MinHash bands for candidates, odd sketches to verify them, components for groups.

The similarity of two texts is the Jaccard coefficient of their sets of ``k`` consecutive words. Each text gets MINHASHES
MinHash values. BANDS groups of ROWS values key its candidates. All values together are folded into an odd sketch, a
bitmap of SKETCH_BITS in which each (index, value) flips one bit: of two texts the population count of the sketches'
XOR tells how many values differ, most precisely where few do. Candidates estimated far above the threshold are
accepted, far below (more than four standard deviations) rejected, and those between are compared exactly.

No bucket is expanded into all of its pairs at once. The first LAG + 1 rows of a bucket all meet one another; rows beyond meet
the bucket's first row and their NEAR neighbours. The pairs that this leaves out of a larger bucket matter only between
rows that did not end up in one group; these are compared in further rounds until none is left (see ``_close``). Before anything
moves, each group of a batch deals with its own rows: it sends equal texts to the buckets once, and of a key that more
than LAG + 1 of its rows bear it sends the first and ties the others to it and to their neighbours. So a bucket that a third of all rows fall into
gets one row of a group, of some thousand. Rows that have many pairs, such as a bucket's first, are parted by salt where pairs meet sketches and texts.

Chance of missing a pair whose similarity is the threshold of 0.6: (1 - 0.6**4)**40 = 0.4 %; at 0.7 0.002 %; a miss
only shows if no other link joins the two groups.

Defined cases: a null text gives no row. Texts with fewer than ``k`` words are grouped only with texts identical to
them, letter for letter. Repeated ids are one record.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import bitmap, wordhash
from corpuslab.llm.wordhash import U
from corpuslab.operators.components import connected_components
from corpuslab.operators.joins import HOT_SHARE, lookup, salted
from corpuslab.session import Stage

MINHASHES = 256
BANDS = 40
ROWS = 4
SKETCH_BITS = 512
LAG = 8
#: Neighbours that rows further back in a bucket meet besides its first row.
NEAR = 2
#: Rows of either side of a large bucket that meet at once in a closing round.
BLOCK = 4096
#: Fewer pairs of one id need no parting.
HOT_ROWS = 100_000
#: Estimates beyond this distance from the threshold are taken at their word: 4.4 standard deviations of 0.046.
MARGIN = 0.2
SEED = 7

PAIR, COPY, SKETCH, LARGE = 0, 1, 2, 3
_KEYED = "key long, row_id long, sketch array<long>"
_MET = "kind byte, i long, j long, sketch array<long>"


@functools.lru_cache(1)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = (rng.integers(0, 2**32, MINHASHES, dtype=np.uint64) | 1).astype(np.uint32)
    return a, rng.integers(0, 2**32, MINHASHES, dtype=np.uint64).astype(np.uint32)


def minhashes(shingle: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash values (texts x MINHASHES) of texts that all have a shingle."""
    a, b = _coefficients()
    x = (shingle >> U(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, MINHASHES), np.uint32)
    step = 1 << 16
    cut = [0]
    while cut[-1] < len(off) - 1:  # pieces that stay in the processor's cache
        cut.append(max(cut[-1] + 1, int(np.searchsorted(off, off[cut[-1]] + step, side="right")) - 1))
    with np.errstate(over="ignore"):
        for lo, hi in zip(cut, cut[1:]):
            part, at = x[off[lo] : off[hi]], off[lo:hi] - off[lo]
            tmp = np.empty_like(part)
            for k in range(MINHASHES):
                np.multiply(part, a[k], out=tmp)
                tmp += b[k]
                out[lo:hi, k] = np.minimum.reduceat(tmp, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key per band; the band is part of the key."""
    with np.errstate(over="ignore"):
        s = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(U)
        key = np.broadcast_to(wordhash.mix(np.arange(1, BANDS + 1, dtype=U)), s.shape[:2]).copy()
        for r in range(ROWS):
            key = wordhash.mix(key * U(0x9E3779B97F4A7C15) + s[:, :, r])
    return key


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps (texts x SKETCH_BITS / 64 words) of all MinHash values with their indices."""
    with np.errstate(over="ignore"):
        h = wordhash.mix(sig.astype(U) + (np.arange(1, MINHASHES + 1, dtype=U) << U(32))) % U(SKETCH_BITS)
    n = len(sig)
    flat = (np.arange(n, dtype=np.int64)[:, None] * SKETCH_BITS + h.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def _keyed(k: int, lag: int = LAG):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(1).to_pylist()
            for lo, hi in wordhash.groups(np.fromiter(map(len, texts), np.int64, len(texts))):
                yield _key_group(ids[lo:hi], texts[lo:hi], k, lag)

    return work


#: What a row of ``_keyed`` is, by the length of its sketch: -1, a null, is a row in a bucket.
_COPY, _SHORT, _PAIR, _LARGE, _SKETCH = 0, 1, 2, 3, SKETCH_BITS // 64


def _fold(key: np.ndarray, row: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group's rows with their keys: those that travel, those in a bucket of more than lag + 1 (both as indices), and the pairs
    (i, j) that the latter form with the bucket's first row here, which travels for them, and with their neighbours."""
    order = np.lexsort((row, key))
    ks, rs = key[order], row[order]
    new = np.flatnonzero(np.append(True, ks[1:] != ks[:-1])) if len(ks) else np.empty(0, np.int64)
    size = np.diff(np.append(new, len(ks)))
    place, many = np.arange(len(ks)) - np.repeat(new, size), np.repeat(size > lag + 1, size)
    tied = np.flatnonzero(many & (place > 0))
    near = [tied[place[tied] > n] for n in range(1, NEAR + 1)]  # beyond the first row itself
    i = np.concatenate([np.repeat(rs[new], size)[tied], *(rs[x - n] for n, x in enumerate(near, 1))])
    return order[~many | (place == 0)], order[many], i, np.concatenate([rs[tied], *(rs[x] for x in near)])


def _key_group(ids: np.ndarray, texts: list[str], k: int, lag: int) -> pa.RecordBatch:
    h, _, _, first = wordhash.words(texts)
    shingle, off = wordhash.shingles(h, first, k)
    full = np.diff(off) > 0
    # texts of the same words in the same order count once; the others are tied to the first of them
    with np.errstate(over="ignore"):
        p = wordhash.prefix_hash(h)
        same = wordhash.range_hash(p, first[:-1], first[1:])
    for i in np.flatnonzero(~full):
        same[i] = xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "surrogatepass"), SEED)
    _, head, back = np.unique(same, return_index=True, return_inverse=True)
    heads = head[back]
    copy = heads != np.arange(len(ids))
    keep = np.flatnonzero(~copy & full)
    short = np.flatnonzero(~copy & ~full)
    n = np.diff(off)[keep]
    koff = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(n, out=koff[1:])
    sub = shingle[np.arange(koff[-1]) + np.repeat(off[keep] - koff[:-1], n)]
    sig = minhashes(sub, koff)
    bands, rows = band_keys(sig).ravel(), np.repeat(ids[keep], BANDS)
    go, large, i, j = _fold(bands, rows, lag)
    c = np.flatnonzero(copy)
    routed = wordhash.mix(rows[large].view(U))  # not by the bucket, which is hot
    parts = (
        (-1, bands[go], rows[go], np.empty(0, U)),
        (_SHORT, same[short], ids[short], np.zeros(len(short), U)),
        (_COPY, ids[heads[c]].view(U), ids[c], np.empty(0, U)),
        (_PAIR, i.view(U), j, np.zeros(2 * len(i), U)),
        (_LARGE, routed, rows[large], np.repeat(bands[large], 3)),
        (_SKETCH, wordhash.mix(ids[keep].view(U)), ids[keep], odd_sketches(sig).ravel()),
    )
    width = np.concatenate([np.full(len(r), w) for w, _, r, _ in parts])
    loff = np.zeros(len(width) + 1, np.int32)
    np.cumsum(np.maximum(width, 0), out=loff[1:])
    values = np.concatenate([v for *_, v in parts]).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(loff, pa.int32(), mask=np.append(width < 0, False)), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for _, x, *_ in parts]).view(np.int64)), pa.array(np.concatenate([r for *_, r, _ in parts])), lists], names=["key", "row_id", "sketch"])


def _meet(lag: int = LAG):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _meet_rows(batches, lag)

    return work


def _meet_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: pairs of neighbours and of each row with its bucket's first. Of the rows before, only the last
    ``most`` and the current bucket's first row and size are kept."""
    tail_k, tail_r = np.empty(0, np.int64), np.empty(0, np.int64)
    tail_short = np.empty(0, bool)
    head_key, head_row, head_n = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sk = batch.column(2)
        lengths = sk.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        key, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        out_k, out_i, out_j = [], [], []
        large = lengths == _LARGE
        for kind, c, i in ((COPY, lengths == _COPY, key), (PAIR, lengths == _PAIR, key), (LARGE, large, None)):
            out_k.append(np.full(int(c.sum()), kind, np.int8))
            out_i.append(sk.filter(pa.array(large)).flatten().to_numpy()[::3] if i is None else i[c])
            out_j.append(row[c])
        s = lengths == _SKETCH
        sketches = sk.filter(pa.array(s))
        b = (lengths == -1) | (lengths == _SHORT)
        k, r, sh = np.concatenate([tail_k, key[b]]), np.concatenate([tail_r, row[b]]), np.concatenate([tail_short, lengths[b] == _SHORT])
        old = len(tail_k)
        nk, nr, ns = k[old:], r[old:], sh[old:]
        if len(nk):
            # place of each row within its bucket, and the bucket's first row
            new = np.ones(len(nk), bool)
            new[1:] = nk[1:] != nk[:-1]
            goes_on = head_key is not None and nk[0] == head_key
            if goes_on:
                new[0] = False
            begin = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            at = begin[np.maximum(which, 0)] if len(begin) else np.zeros(len(nk), np.int64)
            heads = np.where(which >= 0, nr[at], head_row)
            place = np.where(which >= 0, np.arange(len(nk)) - at, np.arange(len(nk)) + head_n)
            for lag in range(1, most + 1):
                if lag >= len(k):
                    break
                hit = (k[lag:] == k[:-lag]) & (np.arange(lag, len(k)) >= old)
                if not hit.any():
                    break  # a farther pair would have nearer ones within it
                x = np.flatnonzero(hit)
                if lag > NEAR:
                    x = x[place[x + lag - old] <= most]
                out_k.append(np.where(sh[x + lag], COPY, PAIR).astype(np.int8))
                out_i.append(r[x])
                out_j.append(r[x + lag])
            far = (place > most) & ~ns
            out_k.append(np.full(int(far.sum()), PAIR, np.int8))
            out_i.append(heads[far])
            out_j.append(nr[far])
            # every row of a bucket of more than most + 1 rows is listed: as it passes that place, those before it too
            over = np.flatnonzero((place == most + 1) & ~ns)
            before = (over[:, None] + old - np.arange(most + 1, 0, -1)[None, :]).ravel() if len(over) else np.empty(0, np.int64)
            lk, lr = k[before[before >= 0]], r[before[before >= 0]]
            if goes_on and len(over) and (over[0] + old - (most + 1)) < 0:
                lk, lr = np.append(lk, head_key), np.append(lr, head_row)
            out_k.append(np.full(len(lk) + int(far.sum()), LARGE, np.int8))
            out_i.append(np.concatenate([lk, nk[far]]))
            out_j.append(np.concatenate([lr, nr[far]]))
            head_key, head_row, head_n = nk[-1], heads[-1], int(place[-1]) + 1
        tail_k, tail_r, tail_short = k[-most:], r[-most:], sh[-most:]
        kinds, i, j = np.concatenate(out_k), np.concatenate(out_i), np.concatenate(out_j)
        lo, hi = np.minimum(i, j), np.maximum(i, j)
        large = kinds == LARGE
        i, j = np.where(large, i, lo), np.where(large, j, hi)
        keep = large | (i != j)
        kinds, i, j = kinds[keep], i[keep], j[keep]
        n, m = len(kinds), int(s.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([kinds, np.full(m, SKETCH, np.int8)])),
                pa.array(np.concatenate([i, row[s]])),
                pa.array(np.concatenate([j, np.zeros(m, np.int64)])),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), sketches.cast(pa.list_(pa.int64()))]),
            ],
            names=["kind", "i", "j", "sketch"],
        )


def estimate(a: Column, b: Column) -> Column:
    """Similarity by two odd sketches."""
    # word by word, which is compiled, as functions over arrays are not
    z = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    part = F.least(2.0 * z / SKETCH_BITS, F.lit(1 - 1e-9))
    return 1 + (SKETCH_BITS / 2) * F.log(1 - part) / (2 * MINHASHES)


def jaccard_of_texts(k: int, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for lo, hi in wordhash.groups(np.fromiter((len(x) + len(y) for x, y in zip(ta, tb)), np.int64, len(ta))):
                both = ta[lo:hi] + tb[lo:hi]
                h, _, _, first = wordhash.words(both)
                s, off = wordhash.shingles(h, first, k)
                sets = [np.unique(s[off[x] : off[x + 1]]) for x in range(len(both))]
                n = hi - lo
                for x in range(n):
                    common = len(np.intersect1d(sets[x], sets[x + n], assume_unique=True))
                    union = len(sets[x]) + len(sets[x + n]) - common
                    keep.append(union > 0 and common >= threshold * union - 1e-9)
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], names=["i", "j"])

    return work


def _attach(left: DataFrame, right: DataFrame, col: str, other: str, pairs: DataFrame, stage: Stage) -> DataFrame:
    """Join of ``left``, which has the rows of ``pairs``, with a table that is unique on ``col``. Ids with a large share of the pairs
    are parted by salt."""
    counts = pairs.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    most, rows = counts.agg(F.max("n"), F.sum("n")).first()
    if not rows or most <= max(HOT_ROWS, rows // HOT_SHARE):
        return left.join(right, col)
    hot = stage.put(counts.filter(F.col("n") > rows // HOT_SHARE), "hot")
    return salted(left, right, [col], hot, "n", rows, F.col(other))


def _verify(pairs: DataFrame, sketches: DataFrame, base: DataFrame, k: int, threshold: float, stage: Stage, closing: bool = False) -> DataFrame:
    """Those of the pairs (i, j) that reach the threshold. Before closing rounds no j has many pairs: it met BANDS buckets' first rows and
    its neighbours."""
    a = sketches.select(F.col("row_id").alias("i"), F.col("sketch").alias("si"))
    b = sketches.select(F.col("row_id").alias("j"), F.col("sketch").alias("sj"))
    est = _attach(pairs, a, "i", "j", pairs, stage)
    est = _attach(est, b, "j", "i", pairs, stage) if closing else est.join(b, "j")
    est = est.select("i", "j", estimate(F.col("si"), F.col("sj")).alias("est")).filter(F.col("est") >= threshold - MARGIN)
    est = stage.put(est, "estimated")
    sure = est.filter(F.col("est") >= threshold + MARGIN).select("i", "j")
    open_ = est.filter(F.col("est") < threshold + MARGIN).select("i", "j")
    ids = open_.select(F.explode(F.array("i", "j")).alias("id"))
    bits, width = bitmap.build(ids, "id", 2 * open_.count())
    texts = base.withColumn("at", bitmap.place(F.col("row_id"), width)).mapInArrow(_passing(bits), "row_id long, t string")
    texts = stage.put(texts, "texts")
    ti, tj = texts.select(F.col("row_id").alias("i"), F.col("t").alias("ti")), texts.select(F.col("row_id").alias("j"), F.col("t").alias("tj"))
    joined = _attach(open_, ti, "i", "j", open_, stage)
    joined = _attach(joined, tj, "j", "i", open_, stage) if closing else joined.join(tj, "j")
    exact = joined.select("i", "j", "ti", "tj").mapInArrow(jaccard_of_texts(k, threshold), "i long, j long")
    out = stage.put(sure.unionByName(exact), "links")
    stage.drop(texts)
    stage.drop(est)
    return out


def _passing(bits: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = pa.array(bitmap.hit(bits, b.column(2).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["row_id", "t"])

    return work


def _close(large: DataFrame, comp: DataFrame, sketches: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """Pairs within large buckets whose rows are in different groups and whose sketches come near the threshold.

    Of a bucket whose rows are in several groups, the rows outside its largest group meet all of its rows, in blocks of
    BLOCK rows of either side. Distance to the bucket's first row rules out most before sketches are compared: two rows as
    near as the threshold can't differ by more than that in their distance to a third."""
    here = large.join(comp, F.col("row_id") == F.col("node"), "left").select("key", "row_id", F.coalesce("component", "row_id").alias("c"))
    sizes = here.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("s"), F.sum("n").alias("n"), F.min("lo").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    split = split.select("key", F.col("s.c").alias("main"), (F.col("n") - F.col("s.n")).alias("out"), "n", "first")
    # one row for each bucket, which may hold any share of the rows
    first = split.join(sketches, F.col("first") == F.col("row_id")).select("key", "main", "out", F.col("n").alias("all"), "n", F.col("sketch").alias("fs"))
    x = lookup(here, first, ["key"], max(large.count(), 1), "n").join(sketches, "row_id").withColumn("d", 1 - estimate(F.col("sketch"), F.col("fs"))).drop("fs")
    of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    mine = lambda n: F.pmod(F.hash("row_id"), of(n))
    left = x.filter("c <> main").withColumn("bi", mine("out")).select("key", "bi", every("all").alias("bj"), F.col("row_id").alias("i"), F.col("c").alias("ci"), F.col("d").alias("di"), F.col("sketch").alias("si"))
    right = x.withColumn("bj", mine("all")).select("key", every("out").alias("bi"), "bj", F.col("row_id").alias("j"), F.col("c").alias("cj"), F.col("d").alias("dj"), "main", F.col("sketch").alias("sj"))
    near = F.abs(F.col("di") - F.col("dj")) <= 1 - threshold + 2 * MARGIN
    met = left.join(right, ["key", "bi", "bj"]).filter(
        (F.col("ci") != F.col("cj")) & ((F.col("cj") == F.col("main")) | (F.col("i") < F.col("j"))) & near & (estimate(F.col("si"), F.col("sj")) >= threshold - MARGIN)
    )
    return met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().join(done, ["i", "j"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, lag: int = LAG) -> DataFrame:
    """``(row_id, first_row_id)`` of every row that belongs to a group of near-duplicates: the smallest row of the group.
    Rows that are like no other give no row."""
    spark = docs.sparkSession
    stage = Stage(spark, "neardup")
    base = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("t"))
    keyed = base.mapInArrow(_keyed(k, lag), _KEYED)
    met = stage.put(keyed.repartition("key").sortWithinPartitions("key", "row_id").mapInArrow(_meet(lag), _MET), "met")
    sketches = met.filter(F.col("kind") == SKETCH).select(F.col("i").alias("row_id"), "sketch")
    copies = met.filter(F.col("kind") == COPY).select("i", "j")
    pairs = stage.put(met.filter(F.col("kind") == PAIR).select("i", "j").distinct(), "pairs")
    large = met.filter(F.col("kind") == LARGE).select(F.col("i").alias("key"), F.col("j").alias("row_id")).distinct()
    links = copies.unionByName(_verify(pairs, sketches, base, k, threshold, stage))
    comp = stage.put(connected_components(links, "i", "j"), "groups")
    while not large.isEmpty():
        more = stage.put(_close(large, comp, sketches, pairs, threshold), "closing")
        if more.isEmpty():
            break
        found = _verify(more, sketches, base, k, threshold, stage, closing=True)
        pairs = pairs.unionByName(more)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        comp = stage.put(connected_components(links, "i", "j"), "groups")
    stage.only(comp)
    return comp.select(F.col("node").alias("row_id"), F.col("component").alias("first_row_id"))

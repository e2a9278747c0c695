"""Train, validation and test splits that keep related records together.

Records tied by an entity, directly or through others, form a component, which is never divided. Components of equal
label counts are interchangeable, so the assignment starts from a hash of each component's id and is then improved
over (signature, split) counts alone: parallel annealing chains, spread over the executors, exchange and move whole
components between splits so that split sizes and the labels' shares come nearer to their targets. The best
state of all chains is kept, and which components of a signature move is decided by hash without sorting a signature.

All signatures take part. They are parted by hash into shards of about SEARCHED, each of which is annealed towards the wanted shares of
its own records; if there are several, the signatures with the most components, mostly single records, are then annealed once more
against all the rest as it stands, which evens out what the shards left.

Defined cases: null, blank and unbound keys tie nothing; kinds and keys compare without case and surrounding white
space. Records without an id are left out; an id with several rows is one record, labelled by its smallest label.
Ties to absent records are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.components import connected_components
from corpuslab.operators.joins import lookup
from corpuslab.operators.quota import take_quota
from corpuslab.session import Stage

#: Chains for each shard of signatures, and steps of a chain: so many, and so many more per signature.
CHAINS = 12
STEPS, STEPS_EACH = 20_000, 20
#: Signatures that one chain holds. With more of them they are parted into shards by hash, which are searched side by side.
SEARCHED = 2000
#: More labels than this are an error: a chain holds counts by label.
MAX_LABELS = 10_000
SPLITS = ("train", "validation", "test")


def trimmed(c: Column) -> Column:
    """Lower case without surrounding white space, of any kind."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def tie_components(records: DataFrame, id_col: str, entities: DataFrame, kinds: list[str], unbound: list[str], kind_col: str = "entity_kind", key_col: str = "entity_key") -> DataFrame:
    """``(id, first)`` of each tied record: the smallest id of its component. ``records`` and ``entities`` share
    ``id_col``. A record whose keys are its own alone gives no row."""
    stage = Stage(records.sparkSession, "ties")
    want = [k.strip().lower() for k in kinds if k and k.strip()]
    skip = [""] + [u.strip().lower() for u in unbound or [] if u is not None]
    e = entities.select(F.col(id_col).alias("id"), trimmed(F.col(kind_col)).alias("kind"), trimmed(F.col(key_col)).alias("key"))
    e = e.filter(F.col("kind").isin(want) & F.col("key").isNotNull() & ~F.col("key").isin(skip) & F.col("id").isNotNull()).distinct()
    ids = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    e = stage.put(e.join(ids, "id", "left_semi"), "entities")
    hub = e.groupBy("kind", "key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = lookup(e, hub, ["kind", "key"], e.count(), "n").filter("id <> hub").select(F.col("id").alias("src"), F.col("hub").alias("dst"))
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("first"))


def _cost(have: np.ndarray, want: np.ndarray) -> float:
    """Squared deviation of split sizes and of labels in splits, relative to what is wanted."""
    size, goal = have.sum(1), want.sum(1)
    total = max(want.sum(), 1.0)
    label = np.maximum(want.sum(0), 1.0)
    return float((((size - goal) / total) ** 2).sum() + (((have - want) / label) ** 2).mean(1).sum())


def anneal(sig: np.ndarray, counts: np.ndarray, fixed: np.ndarray, shares: np.ndarray, seed: int, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Lower the cost by moving or exchanging components. ``sig``: label counts of each signature; ``counts``: its components
    by split; ``fixed``: label counts by split of what is not searched."""
    rng = np.random.default_rng(seed)
    counts = counts.copy()
    have = fixed + np.einsum("sk,sl->kl", counts, sig)
    want = shares[:, None] * have.sum(0)[None, :]
    cost = _cost(have, want)
    best, kept = cost, counts.copy()
    if not len(sig):
        return best, kept
    heat = max(cost, 1e-9)
    pick = rng.integers(0, len(sig), (steps, 2))
    way = rng.integers(0, len(shares), (steps, 2))
    jump = rng.random((steps, 2))
    for t in range(steps):
        s, u = pick[t]
        a, b = way[t]
        if a == b or counts[s, a] <= 0:
            continue
        # many interchangeable components may move at once, at most as many as would level the split
        m = 1 + int(counts[s, a] ** jump[t, 0]) - 1 if counts[s, a] > 1 else 1
        m = max(1, min(m, counts[s, a]))
        move = sig[s] * m
        back = None
        if t & 1 and u != s and counts[u, b] > 0:
            back = max(1, min(int(counts[u, b]), int(m * sig[s].sum() / max(sig[u].sum(), 1))))
            move = move - sig[u] * back
        have[a] -= move
        have[b] += move
        new = _cost(have, want)
        temp = heat * 0.3 * (1 - t / steps) ** 4 + 1e-15
        if new <= cost or jump[t, 1] < math.exp(-(new - cost) / temp):
            cost = new
            counts[s, a] -= m
            counts[s, b] += m
            if back:
                counts[u, b] -= back
                counts[u, a] += back
            if cost < best:
                best, kept = cost, counts.copy()
        else:
            have[a] += move
            have[b] -= move
    return best, kept


#: One row of a pass: what a chain made of a shard.
_PASS = "shard long, chain long, cost double, have array<double>, sigs array<string>, counts array<long>"


def _signature(sig: str, at: dict[str, int]) -> np.ndarray:
    """Label counts of a signature."""
    out = np.zeros(len(at))
    for p in sig.split("\x1f"):
        label, n = p.rsplit("\x1e", 1)
        out[at[label]] += int(n)
    return out


def _pass(shards: DataFrame, names: list[str], share: np.ndarray, seed: int, stage: Stage, rest: np.ndarray | None = None) -> DataFrame:
    """The best of CHAINS chains for each shard, a group of rows (shard, sig, counts), as of _PASS. A shard is annealed towards the
    wanted shares of itself and ``rest``, label counts by split of what it leaves alone. Chains run on the executors."""
    at = {x: i for i, x in enumerate(names)}
    fixed = np.zeros((len(share), len(names))) if rest is None else rest

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("sig")
        sig = np.array([_signature(x, at) for x in f["sig"]])
        counts = np.array(f["counts"].tolist(), np.int64)
        shard, chain = int(f["shard"].iloc[0]), int(f["chain"].iloc[0])
        cost, best = anneal(sig, counts, fixed, share, (seed * 1000 + shard) * 1000 + chain, STEPS + STEPS_EACH * len(f))
        have = np.einsum("sk,sl->kl", best, sig)
        return pd.DataFrame({"shard": [shard], "chain": [chain], "cost": [cost], "have": [have.ravel().tolist()], "sigs": [f["sig"].tolist()], "counts": [best.ravel().tolist()]})

    each = shards.withColumn("chain", F.explode(F.array(*[F.lit(i).cast("long") for i in range(CHAINS)])))
    done = each.groupBy("shard", "chain").applyInPandas(run, _PASS)
    cols = ["shard", "chain", "cost", "have", "sigs", "counts"]
    best = done.groupBy("shard").agg(F.min_by(F.struct(*cols), F.struct("cost", "chain")).alias("b")).select("b.*")
    return stage.put(best, "pass")


def _placed_counts(best: DataFrame, k: int) -> DataFrame:
    """``(sig, final)``: the components of each signature by split."""
    x = best.select(F.posexplode("sigs").alias("i", "sig"), "counts")
    return x.select("sig", F.slice("counts", F.col("i") * k + 1, k).alias("final"))


def assign_components(records: DataFrame, id_col: str, label_col: str, ties: DataFrame, shares: list[float], seed: int = 42) -> DataFrame:
    """``(id, component, label, hashed, split)`` of every record, with the split its component's hash gave it and the one it has after the
    search; ``ties`` as of ``tie_components``. Reaches the driver: label names and their counts by split."""
    stage = Stage(records.sparkSession, "split")
    label = F.trim(F.regexp_replace(F.lower(F.col(label_col)), r"[\s\p{Z}]+", " "))
    one = records.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"))
    one = one.withColumn("label", F.translate(F.coalesce("label", F.lit("")), "\x1e\x1f", "  "))
    placed = stage.put(one.join(ties, "id", "left").select("id", "label", F.coalesce("first", "id").alias("component")), "records")
    names = sorted(r.label for r in placed.select("label").distinct().limit(MAX_LABELS + 1).collect())
    if len(names) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    share = np.asarray(shares, float) / sum(shares)
    k = len(share)
    edge = np.cumsum(share)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("component")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        start = F.when(u < float(edge[i]), i).otherwise(start)
    per = placed.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    sig = per.groupBy("component").agg(F.concat_ws("\x1f", F.array_sort(F.collect_list(F.concat_ws("\x1e", "label", F.col("n").cast("string"))))).alias("sig"), F.sum("n").alias("size"))
    comps = stage.put(sig.withColumn("split", start), "components")
    by = comps.groupBy("sig").agg(F.array(*[F.count_if(F.col("split") == i) for i in range(k)]).alias("counts"), F.count(F.lit(1)).alias("all"))
    by = stage.put(by, "signatures")
    total, rows = by.agg(F.count(F.lit(1)), F.coalesce(F.sum("all"), F.lit(0))).first()
    shards = -(-total // SEARCHED)
    best = _pass(by.select(F.pmod(F.xxhash64(F.lit(seed), "sig"), F.lit(max(shards, 1))).alias("shard"), "sig", "counts"), names, share, seed, stage)
    final = _placed_counts(best, k)
    if shards > 1:
        # the shards' remainders are evened out by what is easiest to move: the signatures with the most components
        final = stage.put(final, "final")
        have = np.zeros(k * len(names))
        for r in best.select(F.posexplode("have").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
            have[r.i] = r.n
        top = by.orderBy(F.desc("all"), "sig").limit(SEARCHED).select("sig")
        top = stage.put(final.join(F.broadcast(top), "sig").select(F.lit(0).cast("long").alias("shard"), "sig", F.col("final").alias("counts")), "top")
        at = {x: i for i, x in enumerate(names)}
        rest = have.reshape(k, len(names)) - sum(np.outer(r.counts, _signature(r.sig, at)) for r in top.toLocalIterator())
        last = _placed_counts(_pass(top, names, share, seed + 1, stage, rest), k).withColumnRenamed("final", "last")
        final = final.join(F.broadcast(last), "sig", "left").select("sig", F.coalesce("last", "final").alias("final"))
    flows = stage.put(by.join(final, "sig").mapInPandas(_flows, "sig string, split int, to int, take long, n long, turn int"), "flows")
    moved = _apply(comps.select("component", "sig", "split", "size"), flows, stage, seed)
    moved = stage.put(moved.join(comps.select("component", F.col("split").alias("hashed")), "component"), "assigned")
    stage.only(placed, moved)
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in SPLITS]), F.col(c) + 1).alias(c)
    return lookup(placed, moved, ["component"], placed.count(), "size").select("id", "component", "label", name("hashed"), name("split"))


def split_by_components(records: DataFrame, id_col: str, label_col: str, ties: DataFrame, shares: list[float], seed: int = 42) -> DataFrame:
    """``(id, component, label, split)`` of every record (see ``assign_components``)."""
    return assign_components(records, id_col, label_col, ties, shares, seed).select("id", "component", "label", "split")


def split_report(assigned: DataFrame, shares: list[float]) -> DataFrame:
    """``(split, label, wanted, total, hashed, n, share, cost_hashed, cost)`` per split and label: the share of the label wanted in the split, the
    label's records in all, those in the split by the hashed start and after the search; the costs are those of the whole assignment. One
    aggregation; what follows has a row per split and label."""
    goal = np.asarray(shares, float) / sum(shares)
    per = assigned.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c) == s).alias(f"{c}_{s}") for c in ("hashed", "split") for s in SPLITS]
    )
    cells = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(float(g)).alias("wanted"), F.col(f"hashed_{s}").alias("hashed"), F.col(f"split_{s}").alias("n")) for s, g in zip(SPLITS, goal)])
    x = per.select("label", "total", F.explode(cells).alias("x")).select("label", "total", "x.*")
    every, mine = Window.partitionBy(), Window.partitionBy("split")
    for c, to in (("hashed", "cost_hashed"), ("n", "cost")):
        size = (F.sum(c).over(mine) / F.sum("total").over(mine) - F.col("wanted")) / F.count(F.lit(1)).over(mine)
        # the same for each label of a split, so that its square times the labels adds up to the split's part
        part = size * size * F.count(F.lit(1)).over(mine) + F.pow(F.col(c) / F.col("total") - F.col("wanted"), F.lit(2)) / F.count(F.lit(1)).over(mine)
        x = x.withColumn("_p", part).withColumn(to, F.sum("_p").over(every)).drop("_p")
    return x.select("split", "label", "wanted", "total", "hashed", "n", (F.col("n") / F.col("total")).alias("share"), "cost_hashed", "cost")


def _flows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many components of each signature go from one split to another. From one split they go to two others at most, and
    ``turn`` numbers these."""
    for f in frames:
        out = []
        for sig, a, b in zip(f["sig"], f["counts"], f["final"]):
            a, b = np.asarray(a), np.asarray(b)
            give, take = np.maximum(a - b, 0), np.maximum(b - a, 0)
            for i in np.flatnonzero(give):
                turn = 0
                for j in np.flatnonzero(take):
                    if n := int(min(give[i], take[j])):
                        out.append((sig, int(i), int(j), n, int(a[i]), turn))
                        turn += 1
                        give[i] -= n
                        take[j] -= n
        yield pd.DataFrame(out, columns=["sig", "split", "to", "take", "n", "turn"])


def _apply(comps: DataFrame, flows: DataFrame, stage: Stage, seed: int) -> DataFrame:
    """Move, of each signature and split, the wanted number of components to another split, chosen by hash."""
    out = comps.withColumn("moved", F.lit(False))
    for turn in range(len(SPLITS) - 1):
        quota = flows.filter(F.col("turn") == turn)
        if quota.isEmpty():
            continue
        gone = take_quota(out.filter(~F.col("moved")).drop("moved"), quota, ["sig", "split"], ["component"], seed + turn, counted="n", stage=stage)
        gone = lookup(gone, quota.select("sig", "split", "to", "take"), ["sig", "split"], quota.agg(F.sum("take")).first()[0], "take").select("component", "to")
        out = out.join(gone, "component", "left").select("component", "sig", "size", F.coalesce("to", "split").alias("split"), (F.col("moved") | F.col("to").isNotNull()).alias("moved"))
        out = stage.put(out, f"moved{turn}")
    return out.select("component", "size", "split")

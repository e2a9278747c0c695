"""A sample whose share of each category matches target proportions, with a minimum from small categories.

Records are grouped by category signature, the set of targeted categories a record bears; a draw is then a number of
records per signature. It starts as a random draw that satisfies the floors, and is repaired by exchanging
counts between signatures as long as that lowers the deviation from the targets. Records are picked only at the end,
at random by hash, without sorting a category (see ``take_quota``).

Defined cases: categories compare without case, surrounding white space and the kind and number of blanks within; a
null category is met by no record. Records without an id are left out; an id with several rows is one record that
bears the categories of all of them. Null target, minimum and size count as 0. A category with fewer records than
wanted is reported as short, one with fewer drawn than wanted as unmet. An empty table gives a report in which all wanted
categories are short. Of a category that a plan names twice the larger wish counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.joins import salted
from corpuslab.operators.quota import take_quota
from corpuslab.session import Stage

#: Larger tables of sampling plans are refused, and more category signatures: a plan's task holds all signatures and their counts.
MAX_TARGETS = 10_000
MAX_SIGNATURES = 100_000
#: Weight of a missed floor beside a missed target.
FLOOR = 1000
#: Rows of the matrix of swaps that are held at once.
BLOCK = 1024
MARK = "\x1f"


def category(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


def _best_swap(x: np.ndarray, room: np.ndarray, member: np.ndarray, got: np.ndarray, cost, m: int) -> tuple[float, int, int]:
    """The exchange of ``m`` records of one signature for ``m`` of another that changes the cost most for the better. Categories
    add to the cost one by one, so all exchanges follow from what m more and m less of each category change."""
    now = cost(got)
    more, less = cost(got + m) - now, cost(got - m) - now
    out, into = np.flatnonzero(x >= m), np.flatnonzero(room >= m)
    best = (0.0, -1, -1)
    if not len(out) or not len(into):
        return best
    gain = member[into] @ more
    for i in range(0, len(out), BLOCK):
        a = out[i : i + BLOCK]
        change = (member[a] @ less)[:, None] + gain[None, :] - (member[a] * (more + less)) @ member[into].T
        change[a[:, None] == into[None, :]] = 0.0
        k = int(change.argmin())
        if change.flat[k] < best[0] - 1e-9:
            best = (float(change.flat[k]), int(a[k // len(into)]), int(into[k % len(into)]))
    return best


def solve(have: np.ndarray, member: np.ndarray, goal: np.ndarray, floor: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Records per signature: ``have`` there are, ``member[s, c]`` whether signature s has category c, ``goal`` and ``floor``
    wanted of each category, ``size`` in all. Signatures that have the same of these categories are one until the end."""
    rng = np.random.default_rng(seed)
    size = int(min(size, have.sum()))
    if not size:
        return np.zeros(len(have), np.int64)
    rows, which = np.unique(member, axis=0, return_inverse=True)
    which = which.ravel()
    pool = np.bincount(which, weights=have, minlength=len(rows)).astype(np.int64)
    there = rows.T @ pool
    x = np.zeros(len(rows), np.int64)
    # floors first, the rest at random in proportion to what is left
    for c in np.argsort(there, kind="stable"):
        for s in np.flatnonzero(rows[:, c]):
            need = int(min(floor[c] - rows[:, c] @ x, pool[s] - x[s], size - x.sum()))
            if need > 0:
                x[s] += need
    if size > x.sum():
        x += rng.multivariate_hypergeometric(pool - x, int(size - x.sum()), method="marginals")
    least = np.minimum(floor, there)
    cost = lambda got: np.abs(got - goal) + FLOOR * np.maximum(least - got, 0)
    m = 1 << max(0, size.bit_length() - 1)
    while m:
        change, a, b = _best_swap(x, pool - x, rows, rows.T @ x, cost, m)
        if change < 0:
            x[a] -= m
            x[b] += m
        else:
            m //= 2
    # of signatures that are one here, records are drawn in proportion
    out = np.zeros(len(have), np.int64)
    order = np.argsort(which, kind="stable")
    for s, part in enumerate(np.split(order, np.searchsorted(which[order], np.arange(1, len(rows))))):
        out[part] = rng.multivariate_hypergeometric(have[part], int(x[s]), method="marginals") if len(part) > 1 else x[s]
    return out


_SOLVED = "plan int, plan_id long, product string, target_bp long, min_rows long, sample_size long, wanted long, available long, drawn long, share double, short boolean, unmet boolean, sig string, take long, n long"


def _solver(sigs: Broadcast, seed: int):
    """One plan: its report rows, which have no sig, and how many records of each signature to take."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, have = sigs.value
        total = int(have.sum())
        sets = [set(s.split(MARK)) for s in names]
        rows = list(f.astype(object).where(f.notna(), None).itertuples())
        size = total * max(int(t.sample_bp or 0) for t in rows) // 10_000
        cats = sorted({t.category for t in rows if t.category is not None})
        at = {c: i for i, c in enumerate(cats)}
        goal, floor = np.zeros(len(cats)), np.zeros(len(cats))
        wants = [int(max(t.min_rows or 0, size * (t.target_bp or 0) // 10_000)) for t in rows]
        for t, w in zip(rows, wants):
            if t.category is not None:
                goal[at[t.category]] = max(goal[at[t.category]], w)
                floor[at[t.category]] = max(floor[at[t.category]], t.min_rows or 0)
        member = np.array([[c in s for c in cats] for s in sets], np.int64).reshape(len(sets), len(cats))
        x = solve(have, member, goal, floor, size, seed + int(rows[0].plan))
        got, there = member.T @ x, member.T @ have
        out = []
        for t, w in zip(rows, wants):
            i = at.get(t.category, -1)
            available, drawn = (int(there[i]), int(got[i])) if i >= 0 else (0, 0)
            out.append((t.plan, t.plan_id, t.product, t.target_bp, t.min_rows, size, w, available, drawn, drawn / size if size else None, available < w, drawn < w, None, None, None))
        head = (rows[0].plan, rows[0].plan_id, *[None] * 10)
        out += [(*head, names[i], int(x[i]), int(have[i])) for i in np.flatnonzero(x)]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _SOLVED.split(", ")], dtype=object)

    return run


def sample_to_targets(records: DataFrame, id_col: str, category_col: str, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)``. Sample: ``(plan_id, id)``. Report, one row per row of ``targets`` (columns plan_id, product,
    target_bp, min_rows, sample_bp): with the plan's sample size, the records wanted, available and drawn, the share
    reached, ``short`` where fewer are available than wanted, and ``unmet`` where fewer were drawn, be it that there are no more or
    that the plan asks for more than its sample holds. Plans are solved side by side on the executors."""
    spark = records.sparkSession
    stage = Stage(spark, "sample")
    plan = targets.select("plan_id", "product", category(F.col("product")).alias("category"), *[F.col(c).cast("long") for c in ("target_bp", "min_rows", "sample_bp")])
    plan = plan.limit(MAX_TARGETS + 1).collect()
    if len(plan) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    named = sorted({t.category for t in plan if t.category is not None})
    c = category(F.col(category_col))
    ids = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.when(c.isin(named), c).alias("c"))
    one = stage.put(ids.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("c")), MARK).alias("sig")), "records")
    counts = stage.put(one.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "signatures")
    sigs = sorted(map(tuple, counts.limit(MAX_SIGNATURES + 1).collect()))
    if len(sigs) > MAX_SIGNATURES:
        raise ValueError(f"more than {MAX_SIGNATURES} sets of categories")
    shared = spark.sparkContext.broadcast(([s for s, _ in sigs], np.array([n for _, n in sigs], np.int64)))
    number = {p: i for i, p in enumerate(sorted({t.plan_id for t in plan}, key=lambda p: (p is not None, p or 0)))}
    rows = spark.createDataFrame([(number[t.plan_id], *t) for t in plan], "plan int, plan_id long, product string, category string, target_bp long, min_rows long, sample_bp long")
    solved = stage.put(rows.groupBy("plan").applyInPandas(_solver(shared, seed), _SOLVED), "solved")
    report = solved.filter("sig is null").drop("plan", "sig", "take", "n")
    quota = solved.filter("sig is not null").select("plan", "plan_id", "sig", "take", "n")
    pool = salted(one, quota.select("sig", "plan", "plan_id"), ["sig"], counts, "n", sum(n for _, n in sigs), F.col("id")).select("plan", "plan_id", "sig", "id")
    return take_quota(pool, quota, ["plan", "sig"], ["plan", "id"], seed, counted="n").select("plan_id", "id"), report

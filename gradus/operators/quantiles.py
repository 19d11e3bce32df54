"""Exact quantiles (linear interpolation) that never need one column in one task.

The built-in ``percentile`` keeps all distinct values of a group in one
aggregation buffer. It is used while the distinct count is known to be small.
Beyond that each wanted order statistic is bracketed with the bounded-memory
``percentile_approx`` sketch, the rows around the bracket are counted exactly,
and the search goes on strictly inside it. One round shrinks the candidates by
three orders of magnitude, so one to three rounds reach a handful of values
whatever the table size. All columns and all quantiles share the jobs of a
round, and repeated values cost nothing because bracket ends are resolved by
their counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.bounds import ONE_TASK_ROWS, collect_small, null_safe_join
from gradus.operators.ordering import running_rank
from gradus.session import checkpointed

SKETCH_ACCURACY = 10_000
DIRECT_VALUES = 50_000
COLLECT_ROWS = 20_000


@dataclass
class _Target:
    """One wanted order statistic: absolute ``rank`` among the non-null rows of ``col``,
    known to lie among the ``n`` rows strictly inside (low, high), which follow ``before`` rows."""

    col: str
    rank: int
    n: int
    before: int = 0
    low: float | None = None
    high: float | None = None

    @property
    def key(self) -> tuple[str, int]:
        return self.col, self.rank

    @property
    def interval(self) -> tuple:
        return self.col, self.low, self.high

    def inside(self) -> Column:
        v = F.col(self.col).cast("double")
        ok = v.isNotNull()
        if self.low is not None:
            ok = ok & (v > self.low)
        if self.high is not None:
            ok = ok & (v < self.high)
        return ok


def slot(value: Column, bounds: Sequence[float]) -> Column:
    """2i for values between bounds i-1 and i, 2i+1 for values equal to bound i: a balanced search tree of CASEs."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        b = F.lit(float(bounds[mid]))
        return F.when(value < b, tree(lo, mid)).when(value == b, F.lit(2 * mid + 1)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], qs: Sequence[float],
    max_distinct: int = DIRECT_VALUES, max_collect: int = COLLECT_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of each column, ignoring nulls, as numpy's linear rule gives them."""
    cols = list(dict.fromkeys(cols))
    qs = [float(q) for q in qs]
    slack = 2.0 / SKETCH_ACCURACY
    probs = F.array(*[F.lit(p) for q in qs for p in (max(0.0, q - slack), min(1.0, q + slack))])
    first = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(F.col(c).cast("double"), probs, F.lit(SKETCH_ACCURACY)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    small = [c for i, c in enumerate(cols) if first[f"d{i}"] <= max_distinct]
    targets, ends = [], []
    for i, c in enumerate(cols):
        if c in small:
            continue
        n = first[f"n{i}"]
        for j, q in enumerate(qs):
            for r in sorted({math.floor(q * (n - 1)), math.ceil(q * (n - 1))}):
                targets.append(_Target(c, r, n))
                ends.append((first[f"s{i}"][2 * j], first[f"s{i}"][2 * j + 1]))
    found = _order_statistics(df, targets, ends, max_collect)
    exact = None
    if small:
        exact = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, qs))).alias(f"q{c}") for c in small]).first()
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        if c in small:
            out[c] = list(exact[f"q{c}"]) if exact[f"q{c}"] is not None else [None] * len(qs)
            continue
        n = first[f"n{i}"]
        out[c] = []
        for q in qs:
            pos = q * (n - 1)
            lo, hi = found[(c, math.floor(pos))], found[(c, math.ceil(pos))]
            out[c].append(lo + (hi - lo) * (pos - math.floor(pos)))
    return out


def _order_statistics(df: DataFrame, open_: list[_Target], ends: list[tuple[float, float]], max_collect: int) -> dict:
    """Narrow every target with counts around its bracket until few rows are left, then read them out."""
    found: dict[tuple[str, int], float] = {}
    ready: list[_Target] = []
    while open_:
        counts = _counts_around(df, open_, ends)
        still: list[_Target] = []
        for t, (lo, hi) in zip(open_, ends):
            below_lo, upto_lo = counts[(t.col, lo)]
            below_hi, upto_hi = counts[(t.col, hi)]
            if t.rank < below_lo:
                t.n, t.high = below_lo - t.before, lo
            elif t.rank < upto_lo:
                found[t.key] = lo
                continue
            elif t.rank < below_hi:
                t.n, t.before, t.low, t.high = below_hi - upto_lo, upto_lo, lo, hi
            elif t.rank < upto_hi:
                found[t.key] = hi
                continue
            else:
                t.n, t.before, t.low = t.n + t.before - upto_hi, upto_hi, hi
            (ready if t.n <= max_collect else still).append(t)
        open_ = still
        ends = _sketch_ends(df, open_) if open_ else []
    if ready:
        found.update(_read_out(df, ready))
    return found


def _counts_around(df: DataFrame, targets: list[_Target], ends: list[tuple[float, float]]) -> dict[tuple[str, float], tuple[int, int]]:
    """(column, bound) -> (rows below the bound, rows up to it); one job for all columns."""
    bounds: dict[str, list[float]] = {}
    for t, pair in zip(targets, ends):
        bounds.setdefault(t.col, []).extend(pair)
    bounds = {c: sorted(set(b)) for c, b in bounds.items()}
    cols = list(bounds)
    places = F.array(*[
        F.struct(F.lit(i).alias("i"), slot(F.col(c).cast("double"), bounds[c]).alias("s"), F.col(c).isNotNull().alias("ok"))
        for i, c in enumerate(cols)
    ])
    rows = collect_small(df.select(F.explode(places).alias("p")).filter("p.ok").groupBy("p.i", "p.s").count(), 1_000_000)
    held = {(r["i"], r["s"]): r["count"] for r in rows}
    out = {}
    for i, c in enumerate(cols):
        seen = 0
        for j, b in enumerate(bounds[c]):
            seen += held.get((i, 2 * j), 0)
            equal = held.get((i, 2 * j + 1), 0)
            out[(c, b)] = (seen, seen + equal)
            seen += equal
    return out


def _sketch_ends(df: DataFrame, targets: list[_Target]) -> list[tuple[float, float]]:
    """A bracket per target; targets of one interval share one sketch."""
    groups: dict[tuple, list[int]] = {}
    for i, t in enumerate(targets):
        groups.setdefault(t.interval, []).append(i)
    slack = 2.0 / SKETCH_ACCURACY
    exprs = []
    for g, members in enumerate(groups.values()):
        probs = []
        for i in members:
            q = (targets[i].rank - targets[i].before) / max(1, targets[i].n - 1)
            probs += [F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))]
        t = targets[members[0]]
        value = F.when(t.inside(), F.col(t.col).cast("double"))
        exprs.append(F.percentile_approx(value, F.array(*probs), F.lit(SKETCH_ACCURACY)).alias(f"g{g}"))
    row = df.agg(*exprs).first()
    ends: list[tuple[float, float]] = [(0.0, 0.0)] * len(targets)
    for g, members in enumerate(groups.values()):
        for j, i in enumerate(members):
            ends[i] = (row[f"g{g}"][2 * j], row[f"g{g}"][2 * j + 1])
    return ends


def _read_out(df: DataFrame, targets: list[_Target]) -> dict[tuple[str, int], float]:
    """Collect the few rows left in each interval, as (value, count), and count up to the rank."""
    intervals: dict[tuple, int] = {}
    for t in targets:
        intervals.setdefault(t.interval, len(intervals))
    first = {intervals[t.interval]: t for t in targets}
    any_hit = reduce(lambda x, y: x | y, [t.inside() for t in first.values()])
    hits = F.array_compact(
        F.array(*[
            F.when(t.inside(), F.struct(F.lit(i).alias("i"), F.col(t.col).cast("double").alias("v"))) for i, t in first.items()
        ])
    )
    counted = df.filter(any_hit).select(F.explode(hits).alias("h")).groupBy("h.i", "h.v").count()
    values: dict[int, list[tuple[float, int]]] = {}
    for r in collect_small(counted, sum(t.n for t in first.values()) + 1):
        values.setdefault(r["i"], []).append((r["v"], r["count"]))
    out = {}
    for t in targets:
        seen = t.before
        for v, m in sorted(values[intervals[t.interval]]):
            seen += m
            if t.rank < seen:
                out[t.key] = v
                break
    return out


def group_quantiles(
    df: DataFrame, key: str, col: str, qs: Sequence[float], names: Sequence[str], max_distinct: int = ONE_TASK_ROWS
) -> DataFrame:
    """Quantiles of ``col`` per value of ``key``; null is a key like others.

    Rows are first collapsed to (key, value, count), so a hot key costs its
    distinct values only. Keys with more distinct values than one buffer should
    hold are solved together: running counts along the values, cut into chunks,
    tell which value holds each wanted rank.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(key, F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    widest = counts.groupBy(key).agg(F.count("*").alias("__d"), F.sum("__n").alias("__all"))
    heavy = checkpointed(widest.filter(F.col("__d") > max_distinct).drop("__d"))
    some = not heavy.isEmpty()
    light = null_safe_join(counts, heavy.select(key), key, "left_anti") if some else counts
    probs = F.array(*[F.lit(float(q)) for q in qs])
    result = light.groupBy(key).agg(F.percentile("__v", probs, F.col("__n")).alias("__q"))
    result = result.select(key, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    if not some:
        return result
    own = null_safe_join(counts, heavy, key, "inner")
    placed = running_rank(own, [key], ["__v", key], "__n", "__before", max_distinct)
    at = lambda rank: F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col("__v")))
    wanted = []
    for q, n in zip(qs, names):
        spot = F.lit(float(q)) * (F.col("__all") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        share = F.max(spot - low)
        wanted.append((at(low) + (at(high) - at(low)) * share).alias(n))
    return result.unionByName(placed.groupBy(key).agg(*wanted))

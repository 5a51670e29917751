"""Fits: one-row aggregates read on the driver, then applied as literals.

Every data-dependent operator is ``fit`` (a bounded one-row result) + ``transform`` (a
stateless expression), so a fitted step also applies to a stream.

Exact quantiles without holding the whole column in one task
-------------------------------------------------------------
Spark's ``percentile`` merges a value->count map of the entire column in a single final
task, which does not survive a column with billions of distinct values. ``quantiles``
computes the same exact, linearly interpolated quantile (pandas ``quantile``, DuckDB
``quantile_cont``) in two passes whose memory is bounded:

1. ``approx_percentile`` at ``p +- margin`` brackets the two order statistics needed,
   together with the non-null count ``n``.
2. Rounds of plain aggregates count the values below and inside each bracket exactly and take
   approximate quantiles of those inside, which narrow it, until at most ``BRACKET_ROWS`` values
   are left in it. A bracket that turns out to miss its rank is opened to that side and
   narrowed again with more slack. Every fit goes through this loop, whatever its size.
3. Only rows inside a bracket are read once more; they are grouped by value (map-side combined,
   so a hot value costs one row per task), and a running count gives each value its rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.contracts import field_type, qcol
from scrubspark.functions.parse import nan_to_null, to_number

DEFAULT_ACCURACY = 10_000
# Most values ranked exactly per quantile; wider brackets are narrowed first.
BRACKET_ROWS = 200_000
# Approximate quantiles taken inside a bracket per refinement round.
REFINE_GRID = 1_000


def numeric_value(df: DataFrame, column: str) -> Column:
    """The column as a double with NaN turned into null."""
    return to_number(F.col(qcol(column)), field_type(df, column))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              accuracy: int = DEFAULT_ACCURACY, exact: bool = True) -> dict[tuple[str, float], float | None]:
    """Linear-interpolated quantiles for every (column, p); None for an empty column."""
    return fit(df, [(c, p) for c in columns for p in probs], [], accuracy, exact)[0]


def fit(df: DataFrame, quantile_requests: Sequence[tuple[str, float]], mean_columns: Sequence[str] = (),
        accuracy: int = DEFAULT_ACCURACY,
        exact: bool = True) -> tuple[dict[tuple[str, float], float | None], dict[str, float | None]]:
    """Quantiles for every (column, p) and means for ``mean_columns``, in passes over ``df`` that
    all columns share (means ride along in the first): a sketch, the counting rounds (one, unless
    a bracket is wide), and the rows inside the brackets.

    ``exact=False`` is the opt-in for very large tables: one pass, ``approx_percentile``
    at p with rank error at most ``n / accuracy`` (no interpolation)."""
    keys = list(dict.fromkeys((c, float(p)) for c, p in quantile_requests))
    means = list(dict.fromkeys(mean_columns))
    if not keys and not means:
        return {}, {}
    columns = list(dict.fromkeys(c for c, _ in keys))
    margin = 3.0 / accuracy
    vals = {c: numeric_value(df, c) for c in set(columns) | set(means)}

    # Pass 1: non-null counts and an approximate bracket per (column, p); the means.
    aggs = [F.count(vals[c]).alias(f"n{i}") for i, c in enumerate(columns)]
    aggs += [F.avg(vals[c]).alias(f"m{i}") for i, c in enumerate(means)]
    for k, (c, p) in enumerate(keys):
        lo_p, hi_p = (max(0.0, p - margin), min(1.0, p + margin)) if exact else (p, p)
        aggs.append(F.approx_percentile(vals[c], F.array(F.lit(lo_p), F.lit(hi_p)), accuracy).alias(f"b{k}"))
    row = df.agg(*aggs).first()
    mean_of = {c: row[f"m{i}"] for i, c in enumerate(means)}
    if not keys:
        return {}, mean_of
    if not exact:
        return {key: (row[f"b{k}"][0] if row[f"b{k}"] is not None else None) for k, key in enumerate(keys)}, mean_of
    n_of = {c: row[f"n{i}"] for i, c in enumerate(columns)}

    plan = {}  # key index -> (lo, hi, rank_a, rank_b, frac)
    out: dict[tuple[str, float], float | None] = {}
    for k, (c, p) in enumerate(keys):
        n = n_of[c]
        if not n:
            out[(c, p)] = None
            continue
        h = p * (n - 1)
        fl = int(math.floor(h))
        rank_b = min(fl + 1, n - 1)
        lo, hi = row[f"b{k}"]
        plan[k] = (lo, hi, fl, rank_b, h - fl)
    if not plan:
        return out, mean_of
    below = _narrow(df, vals, keys, plan, accuracy)

    # Last pass: only the rows inside a bracket, grouped by value and ranked with a running count.
    inside_of = {k: (vals[keys[k][0]] >= F.lit(t[0])) & (vals[keys[k][0]] <= F.lit(t[1])) for k, t in plan.items()}
    items = [F.when(inside, F.struct(F.lit(k).alias("k"), vals[keys[k][0]].alias("v"))) for k, inside in inside_of.items()]
    inside = F.filter(F.array(*items), lambda e: e.isNotNull())
    cells = (df.where(reduce(or_, inside_of.values())).select(F.explode(inside).alias("e")).select("e.k", "e.v")
             .groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("cum", F.sum("cnt").over(w))
    need = {r: F.create_map(*[x for k, t in plan.items() for x in (F.lit(k), F.lit(t[r] + 1 - below[k]))]) for r in (2, 3)}
    picked = ranked.groupBy("k").agg(
        F.min(F.when(F.col("cum") >= need[2][F.col("k")], F.col("v"))).alias("xa"),
        F.min(F.when(F.col("cum") >= need[3][F.col("k")], F.col("v"))).alias("xb")).collect()
    for r in picked:  # one row per (column, p): bounded by the request, not the data
        out[keys[r["k"]]] = r["xa"] + (r["xb"] - r["xa"]) * plan[r["k"]][4]
    return out, mean_of


def _narrow(df: DataFrame, vals, keys, plan: dict, accuracy: int, max_misses: int = 20) -> dict[int, int]:
    """Narrow the brackets of ``plan`` in place; the exact number of values below each of them.

    One pass per round for all open brackets: count the values below and inside, and, of brackets known
    to hold too many, take ``REFINE_GRID`` approximate quantiles of those inside; the grid points around the target
    ranks (plus the sketch's error) are the next bracket. A bracket is done when it holds its
    ranks and few enough values, or when ties keep its ends where they are.
    """
    below, open_, misses = {}, set(plan), dict.fromkeys(plan, 0)
    wide: set[int] = set()      # brackets that were counted and hold too many values: these take the grid
    grid = F.array(*[F.lit(i / REFINE_GRID) for i in range(REFINE_GRID + 1)])
    while open_:
        aggs = []
        for k in sorted(open_):
            v = vals[keys[k][0]]
            inside = (v >= F.lit(plan[k][0])) & (v <= F.lit(plan[k][1]))
            aggs += [F.count_if(v < F.lit(plan[k][0])).alias(f"b{k}"), F.count_if(inside).alias(f"i{k}")]
            if k in wide:
                aggs.append(F.approx_percentile(F.when(inside, v), grid, accuracy).alias(f"g{k}"))
        row = df.agg(*aggs).first()
        for k in sorted(open_):
            lo, hi, ra, rb, frac = plan[k]
            b, n_in = row[f"b{k}"], row[f"i{k}"]
            if b > ra or b + n_in < rb + 1:
                misses[k] += 1
                if misses[k] > max_misses:
                    raise RuntimeError(f"no bracket of {keys[k]} holds its rank; is the input the same at every read?")
                plan[k] = (-math.inf if b > ra else lo, math.inf if b + n_in < rb + 1 else hi, ra, rb, frac)
                continue
            if n_in <= BRACKET_ROWS:
                below[k] = b
                open_.discard(k)
                continue
            if k not in wide:
                wide.add(k)
                continue
            g, err = row[f"g{k}"], (n_in / accuracy + 1) * 2 ** (1 + misses[k])
            low = max(0, math.floor((ra - b - err) / max(n_in - 1, 1) * REFINE_GRID))
            high = min(REFINE_GRID, math.ceil((rb - b + err) / max(n_in - 1, 1) * REFINE_GRID) + 1)
            if (g[low], g[high]) == (lo, hi):
                below[k] = b
                open_.discard(k)
            else:
                plan[k] = (g[low], g[high], ra, rb, frac)
    return below


def quantile(df: DataFrame, column: str, p: float, accuracy: int = DEFAULT_ACCURACY,
             exact: bool = True) -> float | None:
    return quantiles(df, [column], [p], accuracy, exact)[(column, float(p))]


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5, accuracy: int = DEFAULT_ACCURACY,
               exact: bool = True) -> dict[str, tuple[float, float] | None]:
    """Tukey fences ``[q1 - k*iqr, q3 + k*iqr]`` per column; None when a column has no values."""
    q = quantiles(df, columns, [0.25, 0.75], accuracy, exact)
    out = {}
    for c in columns:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None or q3 is None:
            out[c] = None
        else:
            iqr = q3 - q1
            out[c] = (q1 - k * iqr, q3 + k * iqr)
    return out


def mean(df: DataFrame, column: str) -> float | None:
    return df.agg(F.avg(numeric_value(df, column))).first()[0]


def mode(df: DataFrame, column: str):
    """Most frequent non-null value, smallest on ties (pandas ``mode().iloc[0]``).

    Grouping is map-side combined and the final pick is a ``min_by`` aggregate, so
    neither a hot value nor a high-cardinality column lands whole in one task.
    """
    dt = field_type(df, column)
    c = nan_to_null(F.col(qcol(column)), dt)
    counts = df.select(c.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("v", F.struct((-F.col("n")).alias("neg_n"), F.col("v")))).first()[0]

"""Pairwise correlation report over all numeric columns (booleans excluded).

Each pair uses the rows where both columns are present. Output rows: (col_a, col_b, r)
with |r| >= threshold, r rounded to 3 dp.

* pearson — one aggregate holding ``corr(a, b)`` for every pair.
* spearman — Pearson on average ranks. Ranks come from the distinct values of each
  (pair, side) with their counts and a distributed prefix count; the rows are grouped
  into (x, y) cells first so each pair's correlation is a weighted sum over cells.
* kendall — tau-b without an O(n^2) pair join. x and y are cut into strips by approximate
  quantiles; discordant pairs in different strips of both come from the grid of counts, those
  within a strip from one task that counts inversions (``_discordant``).
  Ties in x, in y and in both come from group counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.contracts import field_type, numeric_columns, qcol
from scrubspark.functions.parse import nan_to_null
from scrubspark.plans.ordered import prefix_sums
from scrubspark.session import materialize

METHODS = ("pearson", "spearman", "kendall")
PAIRS_PER_PASS = 200
RANKED_PAIRS_PER_PASS = 45   # all pairs of ten columns
STRIP = 200_000        # cells between two cuts of Kendall's grid, about
STRIP_MAX = 8_000_000  # most cells that one task counts inversions of
GRID = 1024            # most parts of a side of the grid


def _pairs(df: DataFrame) -> list[tuple[str, str]]:
    cols = numeric_columns(df)
    if len(cols) < 2:
        raise ValueError(f"a correlation takes two numeric columns or more; there are {cols}")
    return [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def _v(df: DataFrame, c: str):
    return nan_to_null(F.col(qcol(c)), field_type(df, c)).cast("double")


def _cells(df: DataFrame, pairs, first: int = 0) -> DataFrame:
    """(k, x, y, cnt): complete rows of every pair k (counted from ``first``), grouped into cells (map-side combined)."""
    items = [F.when(_v(df, a).isNotNull() & _v(df, b).isNotNull(),
                    F.struct(F.lit(k).alias("k"), _v(df, a).alias("x"), _v(df, b).alias("y")))
             for k, (a, b) in enumerate(pairs, first)]
    long = df.select(F.explode(F.array(*items)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
    return long.groupBy("k", "x", "y").agg(F.count(F.lit(1)).alias("cnt"))


def _report(values: DataFrame, pairs, threshold: float) -> DataFrame:
    """values: (k, r) -> (col_a, col_b, r) filtered and rounded."""
    names = F.create_map(*[x for k, (a, b) in enumerate(pairs) for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    r = F.col("r")
    out = values.where(r.isNotNull() & ~F.isnan(r) & (F.abs(r) >= F.lit(threshold)))
    strongest = out.orderBy(F.abs(r).desc(), "k")   # at most one row per pair of columns
    return strongest.select(names[F.col("k")][0].alias("col_a"), names[F.col("k")][1].alias("col_b"),
                            F.round(r, 3).alias("r"))


def compute_correlation(df: DataFrame, method: str = "pearson", threshold: float = 0.7) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"correlation method {method!r} is none of {METHODS}")
    pairs = _pairs(df)
    if method == "pearson":
        # one aggregate per batch of pairs keeps generated code small on wide tables
        parts = []
        for start in range(0, len(pairs), PAIRS_PER_PASS):
            ks = range(start, min(start + PAIRS_PER_PASS, len(pairs)))
            wide = df.agg(*[F.corr(_v(df, pairs[k][0]), _v(df, pairs[k][1])).alias(f"r{k}") for k in ks])
            parts.append(wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("r"))
                                                         for k in ks])).alias("e")).select("e.*"))
        values = parts[0]
        for p in parts[1:]:
            values = values.unionByName(p)
        return _report(values, pairs, threshold)
    values = None
    for start in range(0, len(pairs), RANKED_PAIRS_PER_PASS):   # a pass writes at most so many cells a row
        cells = materialize(_cells(df, pairs[start:start + RANKED_PAIRS_PER_PASS], start), "corr-cells")
        part = _spearman(cells) if method == "spearman" else _kendall(cells)
        values = part if values is None else values.unionByName(part)
    return _report(values, pairs, threshold)


def _ranks(cells: DataFrame, sides: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(k, side, value, avg_rank, dense_rank) for the given sides of every pair, from one
    segmented prefix count over the distinct values of each (pair, side)."""
    items = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in sides])
    long = cells.select("k", "cnt", F.explode(items).alias("e")).select("k", "e.side", "e.value", "cnt")
    distinct = long.groupBy("k", "side", "value").agg(F.sum("cnt").alias("c"))
    distinct = distinct.withColumn("one", F.lit(1).cast("long"))
    ps = prefix_sums(distinct, ["value"], ["c", "one"], segment_cols=["k", "side"])
    return ps.select("k", "side", "value", (F.col("c_before") + (F.col("c") + 1) / 2.0).alias("avg_rank"),
                     F.col("one_before").alias("dense_rank"))


def _spearman(cells: DataFrame) -> DataFrame:
    ranks = _ranks(cells)
    rx = ranks.where(F.col("side") == "x").select("k", F.col("value").alias("x"), F.col("avg_rank").alias("rx"))
    ry = ranks.where(F.col("side") == "y").select("k", F.col("value").alias("y"), F.col("avg_rank").alias("ry"))
    ranked = cells.join(rx, ["k", "x"]).join(ry, ["k", "y"])
    w = F.col("cnt").cast("double")
    # center on the exact mean rank (n + 1) / 2 for numerical stability
    per = cells.groupBy("k").agg(((F.sum(w) + 1) / 2.0).alias("mid"))
    centered = ranked.join(per, "k")
    dx, dy = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid")
    mom = centered.groupBy("k").agg(F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"),
                                    F.sum(w * dy * dy).alias("syy"))
    return mom.select("k", F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))).alias("r"))


def discordant_weight(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weight of the pairs with a smaller x and a greater y: counted at the highest bit in which the ranks of
    y differ, over rows kept in the order of x within each prefix of the rank."""
    rank = np.unique(y, return_inverse=True)[1]
    order = np.lexsort((rank, x))
    rank, w, total = rank[order], w[order].astype(np.float64), 0.0
    for level in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        # rows of equal x come with smaller y first: a 1 never stands before a 0 of its own x
        prefix, one = rank >> (level + 1), (rank >> level & 1).astype(bool)
        ones = np.cumsum(np.where(one, w, 0.0))
        head = np.concatenate(([True], prefix[1:] != prefix[:-1]))
        start = np.maximum.accumulate(np.where(head, np.arange(len(rank)), 0))
        before = ones - (ones[start] - np.where(one, w, 0.0)[start])
        total += float((w * before)[~one].sum())
        order = np.argsort(rank >> level, kind="stable")
        rank, w = rank[order], w[order]
    # what was counted has the 1 (greater y) before the 0 (smaller y) in the order of x
    return total


def _grid_discordant(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of cells of one grid that differ in both strips, one right of and below the other."""
    i, j = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in "ij")
    g = np.zeros((i.max() + 1, j.max() + 1))
    g[i, j] = pdf["cnt"].to_numpy()
    above = np.cumsum(np.cumsum(g, axis=0)[:, ::-1], axis=1)[:, ::-1]     # rows up to i, columns from j on
    d = float((g[1:, :-1] * above[:-1, 1:]).sum())
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "d": [d]})


def _strips(cells: DataFrame, strip: int) -> tuple[DataFrame, int]:
    """Cells with the strip of x (``i``) and of y (``j``): of each pair's values so many cuts that about ``strip``
    cells lie between two of them. Cuts are strips of their own (odd numbers), so a value that very many rows
    share is one, and has no discordant pair within."""
    n = cells.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, min(GRID, -(-n // strip)))
    if parts == 1:
        return cells.withColumns({"i": F.lit(0), "j": F.lit(0)}), 1
    at = F.array(*[F.lit(q / parts) for q in range(1, parts)])
    cuts = {r["k"]: (np.unique(r["x"]), np.unique(r["y"])) for r in cells.groupBy("k").agg(
        *[F.approx_percentile(c, at, 10 * parts).alias(c) for c in "xy"]).collect()}     # GRID values a side and pair

    def deal(batches):
        for batch in batches:
            ks = batch.column("k").to_numpy()
            out = []
            for side, c in enumerate("xy"):
                v, strips = batch.column(c).to_numpy(), np.zeros(len(ks), np.int32)
                for k in np.unique(ks):
                    own, cut = ks == k, cuts[int(k)][side]
                    left = np.searchsorted(cut, v[own], "left")
                    strips[own] = left + np.searchsorted(cut, v[own], "right")
                out.append(pa.array(strips))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "i", "j"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    return materialize(cells.mapInArrow(deal, f"{names}, i int, j int"), "corr-strips"), parts


def _discordant(cells: DataFrame, strip: int | None = None, strip_max: int | None = None) -> DataFrame:
    """(k, d): weight of the discordant pairs of each pair of columns, from cells (k, x, y, cnt).

    x and y are cut into strips. Pairs that differ in both strips are counted from the grid of sums; pairs
    within a strip of x, and pairs within a strip of y between different strips of x, by one task a strip:
    each cell is shuffled twice, however many there are. A strip over ``strip_max`` cells (a grid of
    ``GRID`` parts was too coarse) is counted by bit levels over all tasks.
    """
    dealt, parts = _strips(cells, strip or STRIP)
    grid = dealt.groupBy("k", "i", "j").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n"))
    across = None
    if parts > 1:
        grid = materialize(grid, "corr-grid")
        across = grid.groupBy("k").applyInPandas(_grid_discordant, "k int, d double")
    # odd strips hold one value: no discordant pair within
    own = F.when(F.col("i") % 2 == 0, F.struct(F.lit(0).alias("side"), F.col("i").alias("strip"), F.col("x").alias("u")))
    other = F.when((F.col("j") % 2 == 0) & F.lit(parts > 1), F.struct(
        F.lit(1).alias("side"), F.col("j").alias("strip"), F.col("i").cast("double").alias("u")))
    seg = (F.col("k").cast("long") * 2 + F.col("e.side")) * (1 << 20) + F.col("e.strip")
    long = (dealt.select("k", "y", "cnt", F.explode(F.array(own, other)).alias("e")).where("e is not null")
            .select("k", seg.alias("seg"), F.col("e.u").alias("x"), "y", "cnt"))
    big = [r[0] for r in long.groupBy("seg").count().where(F.col("count") > (strip_max or STRIP_MAX)).select(
        "seg").collect()]     # strips of all grids at most

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        d = discordant_weight(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["cnt"].to_numpy())
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "d": [d]})

    small = long.where(~F.col("seg").isin(big)) if big else long
    found = small.groupBy("k", "seg").applyInPandas(within, "k int, d double")
    if big:
        levels = _discordant_by_levels(long.where(F.col("seg").isin(big)).select(F.col("seg").alias("k"), "x", "y", "cnt"))
        found = found.unionByName(levels.select(F.shiftright("k", 21).cast("int").alias("k"), "d"))
    if across is not None:
        found = found.unionByName(across)
    return found.groupBy("k").agg(F.sum("d").alias("d"))


def _discordant_by_levels(cells: DataFrame) -> DataFrame:
    """(k, d) by segmented prefix sums for each bit level of y's dense rank, whatever the size of a segment k."""
    cells = cells.groupBy("k", "x", "y").agg(F.sum("cnt").alias("cnt"))
    ry = _ranks(cells, ("y",)).select("k", F.col("value").alias("y"), F.col("dense_rank").alias("r"))
    top_rank = ry.agg(F.max("r")).first()[0] or 0   # from the (written) rank table, no join
    ranked = cells.join(ry, ["k", "y"])
    levels = max(1, int(top_rank).bit_length())
    bits = ranked.select("k", "x", "cnt", "r", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lvl"))
    bits = bits.select("k", "lvl", F.expr("shiftright(r, lvl + 1)").alias("prefix"), "x", "cnt",
                       F.expr("shiftright(r, lvl) & 1").alias("bit"))
    # one row per value of x at each node: a value that many rows share stays one row per task
    bits = bits.groupBy("k", "lvl", "prefix", "x", "bit").agg(F.sum("cnt").alias("cnt"))
    # order (x, bit): bit-0 rows come before bit-1 rows of equal x, so only strictly smaller x counts
    bits = bits.withColumn("ones", F.when(F.col("bit") == 1, F.col("cnt")).otherwise(F.lit(0)).cast("long"))
    ps = prefix_sums(bits, ["x", "bit"], ["ones"], segment_cols=["k", "lvl", "prefix"])
    return (ps.where(F.col("bit") == 0).groupBy("k")
            .agg(F.sum(F.col("cnt").cast("double") * F.col("ones_before").cast("double")).alias("d")))


def _kendall(cells: DataFrame) -> DataFrame:
    cnt = F.col("cnt").cast("double")
    # totals and ties
    tot = cells.groupBy("k").agg(F.sum(cnt).alias("n"), F.sum(cnt * (cnt - 1) / 2).alias("n3"))
    tx = (cells.groupBy("k", "x").agg(F.sum(cnt).alias("t")).groupBy("k")
          .agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n1")))
    ty = (cells.groupBy("k", "y").agg(F.sum(cnt).alias("t")).groupBy("k")
          .agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n2")))
    allk = tot.join(tx, "k").join(ty, "k").join(_discordant(cells), "k", "left")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    d = F.coalesce(F.col("d"), F.lit(0.0))
    s = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * d
    return allk.select("k", F.try_divide(s, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))).alias("r"))

"""History operators over conversation / event / call logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.contracts import qcol, resolve_column, resolve_columns


def last_n_per_key(df: DataFrame, keys: Sequence[str], order_by: str, n: int) -> DataFrame:
    """The last ``n`` entries of each key by ``order_by`` (recent turns, calls, log lines).

    ``row_number() <= n`` lets Spark put a partial ``WindowGroupLimit`` before the shuffle,
    so every task forwards at most n rows per key: a hot key costs n rows per task.
    """
    ks = resolve_columns(df, keys)
    o = resolve_column(df, order_by)
    w = Window.partitionBy(*[F.col(qcol(k)) for k in ks]).orderBy(F.col(qcol(o)).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def fold_older_turns(df: DataFrame, keys: Sequence[str], order_by: str, role_col: str, text_col: str,
                     trigger: int = 12, keep: int = 6) -> tuple[DataFrame, DataFrame]:
    """Once a conversation has more than ``trigger`` turns, all but the last ``keep`` leave it
    and are joined into a ``role: text`` transcript (one line per turn, in order).

    Returns (kept turns, folded transcripts per key with the number of folded turns).
    The cut-off is the ``keep``-th latest turn of each long conversation (Spark limits each
    group before the shuffle), one small row per conversation, joined to the turns on their
    key: the texts are read once and neither sorted nor ranked. Turns that tie with the
    cut-off stay; turns without a place (null) are the oldest. Each transcript is one output
    cell, so it is assembled per key. A null key is one conversation.
    """
    ks = resolve_columns(df, keys)
    o = resolve_column(df, order_by)
    role, text = resolve_column(df, role_col), resolve_column(df, text_col)
    names = {f"__k{i}": F.col(qcol(k)) for i, k in enumerate(ks)}
    turns = df.select(*[c.alias(n) for n, c in names.items()], F.col(qcol(o)).alias("__o"))
    latest = last_n_per_key(turns, list(names), "__o", keep) if keep > 0 else turns.where(F.lit(False))
    first = F.min(F.struct(F.col("__o").isNotNull().alias("placed"), F.col("__o").alias("o")))
    cut = latest.groupBy(*names).agg(first.alias("__first"))
    counts = turns.groupBy(*names).agg(F.count(F.lit(1)).alias("__cnt")).where(F.col("__cnt") > trigger)
    long_ones = counts.alias("l").join(cut.alias("c"), [F.col(f"l.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names],
                                       "left").select(*[F.col(f"l.{n}").alias(n) for n in names], "__first",
                                                      F.lit(True).alias("__long"))
    ranked = df.join(long_ones, [names[n].eqNullSafe(long_ones[n]) for n in names], "left").drop(*names)
    place = F.struct(F.col(qcol(o)).isNotNull().alias("placed"), F.col(qcol(o)).alias("o"))
    older = F.coalesce(F.col("__long"), F.lit(False)) & (F.col("__first").isNull() | (place < F.col("__first")))
    kept = ranked.where(~older).select(*[F.col(qcol(c)) for c in df.columns])
    lines = ranked.where(older).select(*ks, F.struct(F.col(qcol(o)).alias("o"), F.concat_ws(
        ": ", F.col(qcol(role)), F.col(qcol(text))).alias("line")).alias("e"))
    folded = lines.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_folded"),
                                    F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["line"]),
                                                 "\n").alias("transcript"))
    return kept, folded

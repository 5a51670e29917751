"""Row operators: drop duplicates, drop rows with nulls, filter, remove outliers, sort.

All are lazy DataFrame -> DataFrame transforms. Order-dependent semantics (which copy of a
duplicate is "first") take an explicit ``order_by``, since a Spark table has no row order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import (field_type, is_integral, is_numeric, is_string, qcol, require_numeric, resolve_column,
                                  resolve_columns)
from scrubspark.functions.parse import equals_value, exact_integer, missing, text_form, to_number
from scrubspark.functions.stats import DEFAULT_ACCURACY, iqr_bounds
from scrubspark.sources.parquet import file_order

KEEP_CHOICES = ("first", "last", "none")


def _order_struct(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(qcol(c)).alias(f"o{i}") for i, c in enumerate(order_by)])


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first",
                    order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per key (nulls in the key compare equal).

    * ``keep="first"/"last"``: the row with the smallest / largest ``order_by`` per key.
      Done as ``groupBy(key).agg(min_by(row, order))``: partial aggregation collapses a hot
      key to one row per task before the shuffle. Without ``order_by`` the file order is
      taken, if the source read it; otherwise only a subset of all columns can do without.
    * ``keep="none"``: drop every row whose key occurs more than once; a count and any
      row per key, also map-side combined.
    """
    if keep not in KEEP_CHOICES:
        raise ValueError(f"drop_duplicates: keep is one of {KEEP_CHOICES}, not {keep!r}")
    cols = df.columns
    key = resolve_columns(df, subset) if subset else list(cols)
    rest = [c for c in cols if c not in key]
    if keep == "none":
        agg = [F.count(F.lit(1)).alias("__n")]
        if rest:
            agg.append(F.any_value(F.struct(*[F.col(qcol(c)) for c in rest])).alias("__row"))
        grouped = df.groupBy(*[F.col(qcol(c)) for c in key]).agg(*agg).where(F.col("__n") == 1)
        return grouped.select(*[(F.col(f"__row.{qcol(c)}") if c in rest else F.col(qcol(c))).alias(c) for c in cols])
    if not rest:
        return df.dropDuplicates()
    order = resolve_columns(df, order_by) if order_by else file_order(df)
    pick = F.min_by if keep == "first" else F.max_by
    grouped = df.groupBy(*[F.col(qcol(c)) for c in key]).agg(
        pick(F.struct(*[F.col(qcol(c)) for c in rest]), _order_struct(order)).alias("__row"))
    return grouped.select(*[(F.col(f"__row.{qcol(c)}") if c in rest else F.col(qcol(c))).alias(c) for c in cols])


def drop_missing_rows(df: DataFrame, column: str) -> DataFrame:
    c = resolve_column(df, column)
    return df.where(~missing(F.col(qcol(c)), field_type(df, c)))


FILTER_CONDITIONS = ("greater_than", "less_than", "equals", "not_equals", "contains", "is_null", "not_null")


def filter_rows(df: DataFrame, column: str, condition: str, value=None) -> DataFrame:
    """Remove the rows that match ``condition`` (the reference's filter is a removal).

    Cells that are null or not numbers are kept by greater/less; equality compares numbers
    as numbers on numeric columns and text otherwise; ``contains`` is a case-sensitive
    regular-expression search.
    """
    c = resolve_column(df, column)
    dt = field_type(df, c)
    col = F.col(qcol(c))
    if condition == "is_null":
        return df.where(~missing(col, dt))
    if condition == "not_null":
        return df.where(missing(col, dt))
    if condition not in FILTER_CONDITIONS:
        raise ValueError(f"filter_rows: condition {condition!r} is none of {FILTER_CONDITIONS}")
    if value is None:
        raise ValueError(f"filter_rows: a value is required to test {condition}")
    if condition in ("greater_than", "less_than"):
        try:
            v = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"filter_rows: {condition} compares numbers, not {value!r}") from None
        if is_numeric(dt):
            # Written so the scan can take it: keep = not-matching OR null (OR NaN). On an
            # integer column the bound is an integer literal (c > 2.5 <=> c > 2), so the
            # column is not cast and the predicate reaches Parquet.
            bound, exact = F.lit(v), exact_integer(value)
            if is_integral(dt) and math.isfinite(v) and abs(v) < 2 ** 62:
                whole = exact if exact is not None else math.floor(v) if condition == "greater_than" else math.ceil(v)
                bound = F.lit(whole).cast("long" if abs(whole) >= 2 ** 31 else dt)
            keep = (col <= bound) if condition == "greater_than" else (col >= bound)
            keep = keep | missing(col, dt)
        else:
            num = to_number(col, dt)
            hit = (num > F.lit(v)) if condition == "greater_than" else (num < F.lit(v))
            keep = ~F.coalesce(hit, F.lit(False))
        return df.where(keep)
    if condition in ("equals", "not_equals"):
        match = equals_value(col, dt, value)
        return df.where(~match) if condition == "equals" else df.where(match)
    # contains
    hit = F.coalesce(text_form(col, dt).rlike(str(value)), F.lit(False))
    return df.where(~hit)


def remove_outliers(df: DataFrame, column: str, iqr_multiplier: float = 1.5,
                    accuracy: int = DEFAULT_ACCURACY, exact: bool = True) -> DataFrame:
    """Drop rows outside the Tukey fences; nulls are kept. The quartiles are exact unless
    ``exact=False`` (one approximate pass, for very large tables)."""
    c = resolve_column(df, column)
    require_numeric(df, c)
    bounds = iqr_bounds(df, [c], iqr_multiplier, accuracy, exact)[c]
    if bounds is None:
        return df
    lo, hi = bounds
    col = F.col(qcol(c))
    return df.where(((col >= F.lit(lo)) & (col <= F.lit(hi))) | missing(col, field_type(df, c)))


def sort_dataset(df: DataFrame, column: str, ascending: bool = True,
                 tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Whole-table sort on one column, nulls last in both directions (pandas ``sort_values``)."""
    c = resolve_column(df, column)
    col = F.col(qcol(c))
    keys = [col.asc_nulls_last() if ascending else col.desc_nulls_last()]
    keys += [F.col(qcol(t)).asc_nulls_last() for t in resolve_columns(df, tie_breakers)]
    return df.orderBy(*keys)

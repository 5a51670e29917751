"""Apply a cleaning recipe to a Structured Streaming DataFrame.

Fitted steps (fills by mean/median/mode, outlier caps and removals) are fitted once on a
batch DataFrame and frozen into literals; every other row/cell step is already a
stateless expression. What remains is a plain projection + filter, which a streaming
query runs per micro-batch with no state. Steps that need the whole table at once
(duplicate removal over all time, global sort, reports) are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.contracts import field_type, is_integral, qcol, resolve_column, validate_call
from scrubspark.functions import stats
from scrubspark.functions.parse import missing
from scrubspark.operators import cells
from scrubspark.operators.registry import TRANSFORMS

Step = Callable[[DataFrame], DataFrame]

NOT_STREAMABLE = {"drop_duplicates", "sort_dataset"}


def _fill(column: str, value, widen: bool) -> Step:
    def run(df: DataFrame) -> DataFrame:
        dt = field_type(df, column)
        out_t = "double" if (widen and is_integral(dt)) else dt
        col = F.col(qcol(column))
        return cells._replace(df, column, F.when(missing(col, dt), F.lit(value).cast(out_t)).otherwise(col.cast(out_t)))
    return run


def _clip(column: str, lo: float, hi: float) -> Step:
    def run(df: DataFrame) -> DataFrame:
        return cells._replace(df, column, cells._clip(F.col(qcol(column)), field_type(df, column), lo, hi, widen=True))
    return run


def _keep_inside(column: str, lo: float, hi: float) -> Step:
    def run(df: DataFrame) -> DataFrame:
        col = F.col(qcol(column))
        return df.where(((col >= F.lit(lo)) & (col <= F.lit(hi))) | missing(col, field_type(df, column)))
    return run


def freeze_steps(batch: DataFrame, steps: list[dict]) -> list[Step]:
    """Fit data-dependent steps on ``batch`` (threading the schema through) and return
    stateless transforms that can run on a stream with the same schema."""
    frozen: list[Step] = []
    current = batch
    for step in steps:
        name, args = step["name"], dict(step.get("args") or {})
        if name in NOT_STREAMABLE or name not in TRANSFORMS:
            raise ValueError(f"'{name}' cannot run on a stream (it needs the whole table or is not a transform).")
        validate_call(TRANSFORMS[name], args, name)
        fn: Step
        if name == "handle_missing_values" and args.get("strategy", "mean") in ("mean", "median", "mode"):
            c = resolve_column(current, args["column"])
            strategy = args.get("strategy", "mean")
            value = (stats.mean(current, c) if strategy == "mean" else
                     stats.quantile(current, c, 0.5) if strategy == "median" else stats.mode(current, c))
            fn = _fill(c, value, widen=strategy != "mode") if value is not None else (lambda df: df)
        elif name == "handle_outliers":
            c = resolve_column(current, args["column"])
            bounds = stats.iqr_bounds(current, [c], args.get("iqr_multiplier", 1.5))[c]
            method = args.get("method", "cap")
            if method not in ("cap", "remove"):
                raise ValueError(f"outliers on a stream are capped or removed, not {method!r}")
            if bounds is None:
                fn = (lambda df: df)
            else:
                fn = _clip(c, *bounds) if method == "cap" else _keep_inside(c, *bounds)
        else:
            fn = (lambda df, _f=TRANSFORMS[name], _a=args: _f(df, **_a))
        current = fn(current)
        frozen.append(fn)
    return frozen


def apply_to_stream(df: DataFrame, frozen: list[Step]) -> DataFrame:
    for fn in frozen:
        df = fn(df)
    return df

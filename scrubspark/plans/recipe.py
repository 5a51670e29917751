"""A cleaning recipe: ordered ``{name, args}`` steps folded into one lazy plan.

All checks (unknown operator, missing or unexpected arguments, column names, argument
values) run on the schema before any job. A step that fails is logged and skipped and the
recipe goes on; a step identical to an earlier one is skipped. Row counts per step, and counts
of changed cells, come from ``DataFrame.observe`` and fill in when the final table is computed
(no extra scans).
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import (StepValidationError, UnknownColumn, field_type, qcol, require_numeric,
                                  resolve_column, validate_call)
from scrubspark.functions import stats
from scrubspark.operators import cells
from scrubspark.operators.registry import ANALYSES, TRANSFORMS

AUDIT_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("operator", T.StringType()),
    T.StructField("args", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()), T.StructField("cells_changed", T.LongType()),
    T.StructField("values", T.MapType(T.StringType(), T.DoubleType())), T.StructField("written_at", T.TimestampNTZType()),
])

#: Steps that rewrite the cells of one column: the audit says how many cells came out different.
CELL_STEPS = {"handle_missing_values", "handle_outliers", "standardize_text", "find_and_replace",
              "remove_type_anomalies", "clip_numeric_range"}
_BEFORE = "__cell_before"


@dataclass
class RecipeResult:
    df: DataFrame
    records: list[dict] = field(default_factory=list)
    reports: dict[int, DataFrame] = field(default_factory=dict)
    source: DataFrame | None = None
    applied: list[tuple] = field(default_factory=list)   # (record, function of the table, column rewritten or None)
    rows: dict[int, int] = field(default_factory=dict)   # rows after each step, and before the first (-1)
    cells: dict[int, int] = field(default_factory=dict)  # cells that a step changed
    written_at: _dt.datetime | None = None

    def write(self, path: str, fmt: str = "parquet", log_path: str | None = None) -> None:
        """Compute the cleaned table into ``path``; the per-step counts fill in.

        With ``log_path`` the audit of this write is added to the Parquet table there, which so
        keeps every call with its time.

        The steps are laid out once more with counters of this write between them, so that
        what was shown or counted before can't be mistaken for it; fits keep their values
        where steps were fitted together, others are made again.
        """
        counters = {-1: Observation()}
        current = self.source.observe(counters[-1], F.count(F.lit(1)).alias("rows"))
        for record, apply, column in self.applied:
            counter = counters[record["step"]] = Observation()
            rows = F.count(F.lit(1)).alias("rows")
            if column is None:
                current = apply(current).observe(counter, rows)
                continue
            after = apply(current.withColumn(_BEFORE, F.col(qcol(column))))
            same = F.col(_BEFORE).cast(field_type(after, column)).eqNullSafe(F.col(qcol(column)))
            current = after.observe(counter, rows, F.count_if(~same).alias("cells")).drop(_BEFORE)
        current.write.mode("overwrite").format(fmt).save(path)
        self.rows = {step: c.get["rows"] for step, c in counters.items()}
        self.cells = {step: c.get["cells"] for step, c in counters.items() if "cells" in c.get}
        self.written_at = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        if log_path is not None:
            self.audit().coalesce(1).write.mode("append").parquet(log_path)

    def audit(self) -> DataFrame:
        """One row per step; the counts are set once the table was computed (``write``).

        ``cells_changed`` counts the cells of the step's column that differ from before, in the
        rows that are left; null for steps that rewrite no column's cells. ``values`` names what a step put in
        or cut off at (``fill``; ``lower`` and ``upper``), where it is a number fitted to the data or a bound.
        """
        out = []
        current = self.rows.get(-1)
        for r in self.records:
            after = self.rows.get(r["step"], current)
            out.append((r["step"], r["operator"], r["args"], r["outcome"], r["message"], current, after,
                        self.cells.get(r["step"]), r.get("values"), self.written_at))
            current = after
        return self.df.sparkSession.createDataFrame(out, AUDIT_SCHEMA)


def _frozen(x):
    """``x`` as something that can be hashed and compared, containers included."""
    if isinstance(x, dict):
        return frozenset((k, _frozen(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(_frozen(v) for v in x)
    return (type(x).__name__, x if x.__hash__ else repr(x))


def _batchable(name: str, args: dict) -> bool:
    """Fitted steps that rewrite only their own column: fills by mean/median, outlier caps."""
    if not args.get("exact", True) or "accuracy" in args:
        return False
    if name == "handle_missing_values":
        return args.get("strategy", "mean") in ("mean", "median")
    if name == "handle_outliers":
        return args.get("method", "cap") == "cap"
    return False


def _prefit(df: DataFrame, steps: list[dict], start: int, seen: set[tuple]) -> dict[int, object]:
    """Fit a run of consecutive batchable steps on distinct numeric columns in one go.

    None of them changes another's column or the rows, so fitting all on the table before
    the run equals fitting each in turn, and costs two passes instead of two per step.
    """
    reqs, means, plan, cols, sigs = [], [], {}, set(), set(seen)
    for j in range(start, len(steps)):
        name, args = steps[j].get("name"), dict(steps[j].get("args") or {})
        sig = (name, _frozen(args))
        if not _batchable(name, args) or sig in sigs:
            break
        try:
            validate_call(TRANSFORMS[name], args, name)
            c = resolve_column(df, args["column"])
            require_numeric(df, c)
        except ValueError:
            break
        if c in cols:
            break
        cols.add(c)
        sigs.add(sig)
        if name == "handle_outliers":
            reqs += [(c, 0.25), (c, 0.75)]
            plan[j] = ("iqr", c)
        elif args.get("strategy", "mean") == "mean":
            means.append(c)
            plan[j] = ("mean", c)
        else:
            reqs.append((c, 0.5))
            plan[j] = ("median", c)
    if not plan:
        return {}
    q, m = stats.fit(df, reqs, means)
    return {j: (m[c] if kind == "mean" else q[(c, 0.5)] if kind == "median" else (q[(c, 0.25)], q[(c, 0.75)]))
            for j, (kind, c) in plan.items()}


def _values(name: str, args: dict, fit) -> dict[str, float] | None:
    """What a step put in or cut off at, as numbers: the fill value, or the bounds."""
    def shown(**values) -> dict[str, float] | None:
        return {k: float(v) for k, v in values.items() if v is not None} or None

    if name == "handle_outliers" and fit is not None:
        (q1, q3), k = fit, args.get("iqr_multiplier", 1.5)
        return None if q1 is None else shown(lower=q1 - k * (q3 - q1), upper=q3 + k * (q3 - q1))
    if name == "handle_missing_values":
        return shown(fill=fit)
    if name == "clip_numeric_range":
        return shown(lower=args.get("min_value"), upper=args.get("max_value"))
    return None


def _apply_fitted(df: DataFrame, name: str, args: dict, value) -> DataFrame:
    if name == "handle_outliers":
        return cells.cap_outliers(df, args["column"], args.get("iqr_multiplier", 1.5), fitted=value)
    return cells.fill_missing(df, args["column"], args.get("strategy", "mean"), fitted=value)


def run_recipe(df: DataFrame, steps: list[dict], max_steps: int | None = None) -> RecipeResult:
    """Apply ``steps`` (each ``{"name": ..., "args": {...}}``) in order."""
    result = RecipeResult(df)
    seen: set[tuple] = set()
    fitted: dict[int, object] = {}
    result.source = current = df
    for i, step in enumerate(steps):
        name, args = step.get("name"), dict(step.get("args") or {})
        rec = {"step": i, "operator": name, "args": json.dumps(args, sort_keys=True, default=str)}
        result.records.append(rec)
        if max_steps is not None and i >= max_steps:
            rec.update(outcome="Skipped", message=f"step cap of {max_steps} reached")
            continue
        sig = (name, _frozen(args))
        if sig in seen:
            rec.update(outcome="Skipped", message="same operator and arguments already applied")
            continue
        seen.add(sig)
        try:
            if name in TRANSFORMS:
                validate_call(TRANSFORMS[name], args, name)
                if i not in fitted and _batchable(name, args):
                    fitted.update(_prefit(current, steps[:max_steps] if max_steps else steps, i, seen - {sig}))
                if i in fitted:
                    apply = partial(_apply_fitted, name=name, args=args, value=fitted[i])
                else:
                    apply = partial(TRANSFORMS[name], **args)
                column = resolve_column(current, args["column"]) if name in CELL_STEPS else None
                current = apply(current)
                result.applied.append((rec, apply, column))
                rec.update(outcome="Success", message="applied", values=_values(name, args, fitted.get(i)))
            elif name in ANALYSES:
                validate_call(ANALYSES[name], args, name)
                result.reports[i] = ANALYSES[name](current, **args)
                rec.update(outcome="Result", message="report built")
            else:
                raise StepValidationError(f"no operator is called {name!r}")
        except (StepValidationError, UnknownColumn, ValueError, TypeError) as e:
            rec.update(outcome="Error", message=str(e))
    result.df = current
    return result

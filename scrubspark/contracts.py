"""Contracts shared by every operator: column resolution, argument checks, type tests.

Everything here looks only at the schema on the driver; nothing touches rows.
"""

from __future__ import annotations

import difflib
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class UnknownColumn(ValueError):
    """A name that is no column, or could be several; says which columns there are."""


class StepValidationError(ValueError):
    """A step that cannot run as declared (unknown operator, missing/unexpected args)."""


def resolve_column(df: DataFrame, name: str) -> str:
    """Return the real column name ``name`` refers to.

    Exact match first, then a trimmed, case-folded match. Two columns that fold to the
    same name make the folded lookup ambiguous, so that raises instead of picking one.
    """
    if name in df.columns:
        return name
    alike = [c for c in df.columns if _loose(c) == _loose(name)]
    if len(alike) == 1:
        return alike[0]
    if alike:
        raise UnknownColumn(f"{name!r} is ambiguous: {alike} differ only in case or spaces")
    near = difflib.get_close_matches(str(name), df.columns, n=3, cutoff=0.5)
    raise UnknownColumn(f"no column {name!r}; close matches: {near}; columns: {df.columns}")


def _loose(name: str) -> str:
    """A column name without case and outer spaces."""
    return str(name).casefold().strip()


def require_new(df: DataFrame, names: Sequence[str], replaced: Sequence[str] = ()) -> None:
    """New columns must differ, but for case, from each other and from the columns that stay."""
    taken = {c.lower() for c in df.columns} - {c.lower() for c in replaced}
    for n in names:
        if n.lower() in taken:
            raise ValueError(f"column {n!r} is there already (case aside)")
        taken.add(n.lower())


def resolve_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [resolve_column(df, n) for n in names]


def qcol(name: str) -> str:
    """Back-tick a resolved name so dots or spaces are never parsed as struct access."""
    return "`" + name.replace("`", "``") + "`"


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    """Numbers, not booleans (pandas ``select_dtypes(np.number)``)."""
    return isinstance(dt, NUMERIC)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, FLOATING)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def require_numeric(df: DataFrame, column: str) -> None:
    dt = field_type(df, column)
    if not is_numeric(dt):
        raise ValueError(f"{column!r} is not numeric but {dt.simpleString()}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def validate_call(fn: Callable, args: dict, name: str | None = None) -> None:
    """Check that the operator can be called with the table and these named arguments."""
    try:
        inspect.signature(fn).bind(None, **(args or {}))
    except TypeError as e:
        raise StepValidationError(f"{name or fn.__name__}: {e}") from None

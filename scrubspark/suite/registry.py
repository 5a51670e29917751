"""Registry of named checks: a Spark query plus, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# The number pattern and infinity words of scrubspark.functions.parse, in DuckDB syntax.
_NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INF = "('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')"


def num_sql(x: str) -> str:
    """DuckDB twin of ``to_number`` on a text column."""
    t = f"trim({x})"
    return (f"(CASE WHEN regexp_full_match({t}, '{_NUM_RE}') AND isfinite(TRY_CAST({t} AS DOUBLE)) "
            f"THEN TRY_CAST({t} AS DOUBLE) WHEN lower({t}) IN {_INF} THEN TRY_CAST({t} AS DOUBLE) END)")


_TS_FORMATS = [date + time for date, times in (
    ("%Y-%m-%d", ("", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f", "T%H:%M", "T%H:%M:%S", "T%H:%M:%S.%f", "T%H:%M:%SZ")),
    ("%Y/%m/%d", ("", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f")),
    ("%m/%d/%Y", ("", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f"))) for time in times]


def ts_sql(x: str) -> str:
    """DuckDB twin of ``to_timestamp_ntz`` on a text column (of the zones, Z alone)."""
    return "coalesce(" + ", ".join(f"try_strptime(trim({x}), '{f}')" for f in _TS_FORMATS) + ")"

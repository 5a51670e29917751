"""Checks for the quality reports (each runs over the whole table)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.operators import correlation, reports
from scrubspark.suite.dirty import table, view, with_views
from scrubspark.suite.registry import register

DC = with_views("dirty_customer")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- table metadata -------------------------------------------------------------------

@register("table_shape", with_views("dup_orders") + """
, d AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM dup_orders),
g AS (SELECT count(*) AS n FROM d GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, 4 AS n_columns, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""")
def table_shape(spark, sf):
    return reports.table_shape(view(spark, sf, "dup_orders").drop("copy_no"))


def _nulls_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
            f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 2) AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count FROM dirty_customer")


_DC_COLS = ["c_custkey", "acctbal", "segment", "nation_txt", "segment_gap"]


@register("column_nulls", DC + "\nUNION ALL\n".join(_nulls_sql(c) for c in _DC_COLS))
def column_nulls(spark, sf):
    s = reports.column_summary(view(spark, sf, "dirty_customer"))
    return s.select("column", "null_count", "null_pct", "unique_count")


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("profile_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"count(DISTINCT {c}) AS unique_count FROM lineitem" for c in _LINEITEM))
def profile_lineitem(spark, sf):
    s = reports.column_summary(table(spark, sf, "lineitem").select(*_LINEITEM))
    return s.select("column", "null_count", "unique_count")


@register("column_numeric_stats", DC + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, "
    f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM dirty_customer"
    for c in ["c_custkey", "acctbal"]))
def column_numeric_stats(spark, sf):
    s = reports.column_summary(view(spark, sf, "dirty_customer"))
    return s.where(F.col("mean").isNotNull()).select("column", "min", "max", "mean", "std")


@register("column_datetime_stats", """
SELECT 'o_orderdate' AS column, CAST(min(o_orderdate) AS VARCHAR) AS dt_min, CAST(max(o_orderdate) AS VARCHAR) AS dt_max
FROM orders""")
def column_datetime_stats(spark, sf):
    s = reports.column_summary(table(spark, sf, "orders"))
    return s.where(F.col("dt_min").isNotNull()).select("column", "dt_min", "dt_max")


def _top_sql(c: str, k: int, src: str = "dirty_customer") -> str:
    return (f"SELECT '{c}' AS column, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT {c} AS value, "
            f"count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {src} "
            f"WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}")


@register("top_categories", DC + "\nUNION ALL\n".join(_top_sql(c, 5) for c in ["segment", "nation_txt", "segment_gap"]))
def top_categories(spark, sf):
    s = reports.column_summary(view(spark, sf, "dirty_customer"), max_categories=5)
    e = s.where(F.col("top_categories").isNotNull()).select("column", F.posexplode("top_categories").alias("i", "t"))
    return e.select("column", F.col("t.value").alias("value"), F.col("t.n").alias("n"),
                    (F.col("i") + 1).alias("rank"))


# --- profile_column -------------------------------------------------------------------

def _quality_sql(c: str) -> str:
    pct = f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 2)"
    return (f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
            f"{pct} AS missing_pct, count(DISTINCT {c}) AS n_unique, greatest(0.0::DOUBLE, round(100.0::DOUBLE - {pct}"
            f" - CASE WHEN count(DISTINCT {c}) = 1 THEN 20.0 ELSE 0.0 END, 1)) AS quality_score FROM dirty_customer")


_PROFILED = ["acctbal", "segment", "nation_txt", "segment_gap"]


@register("profile_quality", DC + "\nUNION ALL\n".join(_quality_sql(c) for c in _PROFILED))
def profile_quality(spark, sf):
    d = view(spark, sf, "dirty_customer")
    frames = [reports.profile_column(d, c).select(
        "column", F.col("rows").alias("n_rows"), F.col("missing").alias("n_missing"), "missing_pct",
        F.col("unique").alias("n_unique"), "quality_score") for c in _PROFILED]
    return _union(frames)


@register("profile_numeric", DC + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(min({c})::DOUBLE, 3) AS min, round(max({c})::DOUBLE, 3) AS max, "
    f"round(avg({c}), 3) AS mean, round(quantile_cont({c}, 0.5)::DOUBLE, 3) AS median, "
    f"round(stddev_samp({c}), 3) AS std, round(skewness({c}), 3) AS skewness, round(kurtosis({c}), 3) AS kurtosis "
    f"FROM dirty_customer" for c in ["acctbal", "c_custkey"]))
def profile_numeric(spark, sf):
    d = view(spark, sf, "dirty_customer")
    return _union([reports.profile_column(d, c).select("column", "min", "max", "mean", "median", "std", "skewness",
                                                       "kurtosis") for c in ["acctbal", "c_custkey"]])


@register("profile_top_values", DC + _top_sql("segment", 5))
def profile_top_values(spark, sf):
    p = reports.profile_column(view(spark, sf, "dirty_customer"), "segment")
    e = p.select("column", F.posexplode("top_values").alias("i", "t"))
    return e.select("column", F.col("t.value").alias("value"), F.col("t.n").alias("n"),
                    (F.col("i") + 1).alias("rank"))


# --- correlation ----------------------------------------------------------------------

_PART_PAIRS = [("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice")]


def _corr_sql(threshold: float, expr_of) -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {expr_of(a, b)} AS r_raw FROM src" for a, b in _PART_PAIRS]
    return ("\nUNION ALL\n".join(parts), f"SELECT col_a, col_b, round(r_raw, 3) + 0.0 AS r FROM corr_all "
            f"WHERE r_raw IS NOT NULL AND abs(r_raw) >= {threshold}")


def _pearson_sql() -> str:
    body, tail = _corr_sql(0.4, lambda a, b: f"corr({a}, {b})")
    return f"WITH src AS (SELECT * FROM part), corr_all AS ({body})\n{tail}"


@register("corr_pearson", _pearson_sql())
def corr_pearson(spark, sf):
    return correlation.compute_correlation(table(spark, sf, "part"), "pearson", 0.4)


def _spearman_sql() -> str:
    cols = ["p_partkey", "p_size", "p_retailprice"]
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                      for c in cols)
    body, tail = _corr_sql(0.0, lambda a, b: f"corr({a}, {b})")
    return f"WITH src AS (SELECT {ranks} FROM part), corr_all AS ({body})\n{tail}"


@register("corr_spearman", _spearman_sql())
def corr_spearman(spark, sf):
    return correlation.compute_correlation(table(spark, sf, "part"), "spearman", 0.0)


def _kendall_sql() -> str:
    cols = ["p_partkey", "p_size", "p_retailprice"]
    signs = ", ".join(f"sign(t1.{c}::DOUBLE - t2.{c}::DOUBLE) AS {c}" for c in cols)
    body, tail = _corr_sql(0.0, lambda a, b: (
        f"sum({a} * {b}) / sqrt((count(*) - count(*) FILTER (WHERE {a} = 0))::DOUBLE"
        f" * (count(*) - count(*) FILTER (WHERE {b} = 0))::DOUBLE)"))
    return (f"WITH src AS (SELECT {signs} FROM part t1 JOIN part t2 ON t1.p_partkey < t2.p_partkey), "
            f"corr_all AS ({body})\n{tail}")


@register("corr_kendall", _kendall_sql())
def corr_kendall(spark, sf):
    return correlation.compute_correlation(table(spark, sf, "part"), "kendall", 0.0)


# --- outlier report and value counts --------------------------------------------------

def _outlier_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column, n_outliers, pct AS outlier_pct,
  CASE WHEN n_outliers = 0 THEN 'none' WHEN pct < 2 THEN 'low' WHEN pct < 10 THEN 'moderate' ELSE 'high' END AS severity,
  round(lo, 2) AS lower, round(hi, 2) AS upper
FROM (SELECT count(*) FILTER (WHERE e.{c} < lo OR e.{c} > hi) AS n_outliers,
        round(count(*) FILTER (WHERE e.{c} < lo OR e.{c} > hi) * 100.0::DOUBLE / count(*), 2) AS pct,
        any_value(lo) AS lo, any_value(hi) AS hi
      FROM events e, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)))"""


@register("outlier_report", "\nUNION ALL\n".join(_outlier_sql(c) for c in ["event_id", "user_id", "value"]))
def outlier_report(spark, sf):
    return reports.detect_outliers_report(table(spark, sf, "events"))


@register("value_counts", DC + """
SELECT value, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM dirty_customer), 2) AS pct, CAST(rank AS INTEGER) AS rank
FROM (SELECT nation_txt AS value, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, nation_txt NULLS LAST) AS rank
      FROM dirty_customer GROUP BY nation_txt) WHERE rank <= 10""")
def value_counts(spark, sf):
    return reports.value_counts(view(spark, sf, "dirty_customer"), "nation_txt", 10)


@register("value_counts_double", with_views("odd_numbers") + """
SELECT CAST(d AS VARCHAR) AS value, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM odd_numbers), 2) AS pct,
  CAST(rank AS INTEGER) AS rank
FROM (SELECT d, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, d NULLS LAST) AS rank
      FROM odd_numbers GROUP BY d) WHERE rank <= 40""")
def value_counts_double(spark, sf):
    return reports.value_counts(view(spark, sf, "odd_numbers"), "d", 40)


# --- missing-data pattern -------------------------------------------------------------

def _pattern_sql(c: str) -> str:
    return with_views("gap_events") + f"""
, o AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, {c} IS NULL AS isn FROM gap_events),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE isn) AS m FROM o),
r AS (SELECT pos - (row_number() OVER (ORDER BY pos) - 1) AS island FROM o WHERE isn),
runs AS (SELECT coalesce(max(c), 0) AS longest FROM (SELECT count(*) AS c FROM r GROUP BY island)),
f AS (SELECT count(*) FILTER (WHERE pos < t.n / 3.0) * 1.0::DOUBLE / t.m AS ff,
             count(*) FILTER (WHERE pos >= 2 * t.n / 3.0) * 1.0::DOUBLE / t.m AS fl
      FROM o, t WHERE isn GROUP BY t.n, t.m)
SELECT '{c}' AS column, t.n AS n_rows, t.m AS n_missing, round(t.m * 100.0::DOUBLE / t.n, 2) AS missing_pct,
  round(CASE WHEN t.m = 0 THEN 0.0 WHEN t.m = t.n THEN 1.0 ELSE f.ff END, 4) AS frac_first,
  round(CASE WHEN t.m = 0 THEN 0.0 WHEN t.m = t.n THEN 1.0 ELSE f.fl END, 4) AS frac_last,
  CAST(runs.longest AS BIGINT) AS longest_run,
  CASE WHEN t.m = 0 THEN 'none' WHEN t.m = t.n THEN 'entirely missing'
       WHEN f.ff > 0.6 THEN 'front-loaded' WHEN f.fl > 0.6 THEN 'tail-loaded'
       WHEN runs.longest >= greatest(5, t.m * 0.5) THEN 'systematic block' ELSE 'sporadic' END AS pattern
FROM t CROSS JOIN runs LEFT JOIN f ON true"""


def _pattern_query(c: str):
    def q(spark, sf):
        return reports.detect_missing_pattern(view(spark, sf, "gap_events"), c, ["event_id"])
    return q


for _name, _col in [("missing_front", "v_front"), ("missing_tail", "v_tail"), ("missing_block", "v_block"),
                    ("missing_sporadic", "v_sporadic"), ("missing_all", "v_all"), ("missing_none", "value")]:
    register(_name, _pattern_sql(_col))(_pattern_query(_col))


def _profile_all_sql() -> str:
    parts = []
    for c in _DC_COLS:
        pct = f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 2)"
        head = (f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
                f"{pct} AS missing_pct, count(DISTINCT {c}) AS n_unique, greatest(0.0::DOUBLE, round(100.0::DOUBLE - "
                f"{pct} - CASE WHEN count(DISTINCT {c}) = 1 THEN 20.0 ELSE 0.0 END, 1)) AS quality_score")
        if c in ("c_custkey", "acctbal"):
            tail = (f"round(min({c})::DOUBLE, 3) AS min, round(max({c})::DOUBLE, 3) AS max, round(avg({c}), 3) AS mean, "
                    f"round(quantile_cont({c}, 0.5)::DOUBLE, 3) AS median, round(stddev_samp({c}), 3) AS std, "
                    f"round(skewness({c}), 3) AS skewness, round(kurtosis({c}), 3) AS kurtosis")
        else:
            tail = ", ".join(f"NULL::DOUBLE AS {x}" for x in ["min", "max", "mean", "median", "std", "skewness",
                                                              "kurtosis"])
        parts.append(f"{head}, {tail} FROM dirty_customer")
    return DC + "\nUNION ALL\n".join(parts)


@register("profile_all_columns", _profile_all_sql())
def profile_all_columns(spark, sf):
    p = reports.profile_columns(view(spark, sf, "dirty_customer"))
    return p.select("column", F.col("rows").alias("n_rows"), F.col("missing").alias("n_missing"), "missing_pct",
                    F.col("unique").alias("n_unique"), "quality_score", "min", "max", "mean", "median", "std",
                    "skewness", "kurtosis")

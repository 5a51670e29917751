"""Checks for the row and cell operators (each runs over the whole table)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrubspark.operators import cells, rows
from scrubspark.suite.dirty import table, view, with_views
from scrubspark.suite.registry import num_sql, register, ts_sql

DC = with_views("dirty_customer")
DUP = with_views("dup_orders")
DO = with_views("dirty_orders")
ODD = with_views("odd_numbers")
CUST_COLS = "c_custkey, acctbal, segment, nation_txt, segment_gap"
DUP_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, copy_no"


# --- duplicates -----------------------------------------------------------------------

@register("dedup_first", DUP + f"""
SELECT {DUP_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, copy_no) AS rn
FROM dup_orders) WHERE rn = 1""")
def dedup_first(spark, sf):
    return rows.drop_duplicates(view(spark, sf, "dup_orders"), ["o_custkey"], "first", ["o_orderkey", "copy_no"])


@register("dedup_last", DUP + f"""
SELECT {DUP_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY copy_no DESC) AS rn
FROM dup_orders) WHERE rn = 1""")
def dedup_last(spark, sf):
    return rows.drop_duplicates(view(spark, sf, "dup_orders"), ["o_orderkey"], "last", ["copy_no"])


@register("dedup_all", DUP + """
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM dup_orders""")
def dedup_all(spark, sf):
    return rows.drop_duplicates(view(spark, sf, "dup_orders").drop("copy_no"))


@register("dedup_none", DUP + f"""
SELECT {DUP_COLS} FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM dup_orders) WHERE n = 1""")
def dedup_none(spark, sf):
    return rows.drop_duplicates(view(spark, sf, "dup_orders"), ["o_orderkey"], "none")


# --- row filters ----------------------------------------------------------------------

@register("missing_drop_rows", DC + f"SELECT {CUST_COLS} FROM dirty_customer WHERE acctbal IS NOT NULL")
def missing_drop_rows(spark, sf):
    return rows.drop_missing_rows(view(spark, sf, "dirty_customer"), "acctbal")


@register("filter_gt", DC + f"""
SELECT {CUST_COLS} FROM dirty_customer WHERE NOT coalesce({num_sql('nation_txt')} > 20, false)""")
def filter_gt(spark, sf):
    return rows.filter_rows(view(spark, sf, "dirty_customer"), "nation_txt", "greater_than", "20")


@register("filter_lt", DC + f"SELECT {CUST_COLS} FROM dirty_customer WHERE NOT coalesce(acctbal < 1000, false)")
def filter_lt(spark, sf):
    return rows.filter_rows(view(spark, sf, "dirty_customer"), "acctbal", "less_than", 1000)


_BIG = 9007199254740992  # 2^53: neighbours above it are one number as doubles


@register("filter_equals_long", f"SELECT o_orderkey + {_BIG} AS k FROM orders WHERE o_orderkey <> 1")
def filter_equals_long(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") + F.lit(_BIG)).alias("k"))
    return rows.filter_rows(o, "k", "equals", str(_BIG + 1))


@register("impute_constant_long", f"""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + {_BIG} END, {_BIG + 1}) AS k FROM orders""")
def impute_constant_long(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") + F.lit(_BIG)).alias("k"))
    return cells.fill_missing(o, "k", "constant", str(_BIG + 1))


@register("column_nulls_long", f"""
SELECT 'k' AS column, count(*) FILTER (WHERE k IS NULL) AS null_count, count(DISTINCT k) AS unique_count
FROM (SELECT o_orderkey + {_BIG} AS k FROM orders)""")
def column_nulls_long(spark, sf):
    from scrubspark.operators import reports

    o = table(spark, sf, "orders").select((F.col("o_orderkey") + F.lit(_BIG)).alias("k"))
    return reports.column_summary(o).select("column", "null_count", "unique_count")


@register("filter_equals", DC + f"""
SELECT {CUST_COLS} FROM dirty_customer WHERE segment IS DISTINCT FROM 'BUILDING'""")
def filter_equals(spark, sf):
    return rows.filter_rows(view(spark, sf, "dirty_customer"), "segment", "equals", "BUILDING")


@register("filter_not_equals", DC + f"""
SELECT {CUST_COLS} FROM dirty_customer WHERE segment IS NOT DISTINCT FROM 'machinery'""")
def filter_not_equals(spark, sf):
    return rows.filter_rows(view(spark, sf, "dirty_customer"), "segment", "not_equals", "machinery")


@register("filter_contains", DC + f"""
SELECT {CUST_COLS} FROM dirty_customer WHERE NOT coalesce(regexp_matches(segment, '^ +[A-Z]'), false)""")
def filter_contains(spark, sf):
    return rows.filter_rows(view(spark, sf, "dirty_customer"), "segment", "contains", "^ +[A-Z]")


@register("filter_is_null", DC + f"SELECT {CUST_COLS} FROM dirty_customer WHERE nation_txt IS NOT NULL")
def filter_is_null(spark, sf):
    return rows.filter_rows(view(spark, sf, "dirty_customer"), "nation_txt", "is_null")


@register("filter_not_null", DC + f"SELECT {CUST_COLS} FROM dirty_customer WHERE nation_txt IS NULL")
def filter_not_null(spark, sf):
    return rows.filter_rows(view(spark, sf, "dirty_customer"), "nation_txt", "not_null")


_EVENT_FENCE = """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""


@register("outliers_remove", _EVENT_FENCE + """
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props FROM events e, b
WHERE (e.value >= b.lo AND e.value <= b.hi) OR e.value IS NULL""")
def outliers_remove(spark, sf):
    return rows.remove_outliers(table(spark, sf, "events"), "value")


@register("sort_full", DC + """
SELECT 'up' AS direction, c_custkey, row_number() OVER (ORDER BY acctbal NULLS LAST, c_custkey) - 1 AS position
FROM dirty_customer
UNION ALL
SELECT 'down', c_custkey, row_number() OVER (ORDER BY acctbal DESC NULLS LAST, c_custkey) - 1 FROM dirty_customer""")
def sort_full(spark, sf):
    from scrubspark.plans.ordered import positions

    d = view(spark, sf, "dirty_customer").select("c_custkey", "acctbal")
    out = []
    for name, ascending in (("up", True), ("down", False)):
        done = rows.sort_dataset(d, "acctbal", ascending, tie_breakers=["c_custkey"])
        # the number of a row in the order that the sort gave it, whatever its partition
        placed = positions(done.withColumn("at", F.monotonically_increasing_id()), ["at"])
        out.append(placed.select(F.lit(name).alias("direction"), "c_custkey", "position"))
    return out[0].unionByName(out[1])


@register("sort_desc_topk", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
  CAST(row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank
FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20""")
def sort_desc_topk(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    top = rows.sort_dataset(o, "o_totalprice", ascending=False, tie_breakers=["o_orderkey"]).limit(20)
    w = Window.orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))
    return top.withColumn("rank", F.row_number().over(w))


# --- missing values -------------------------------------------------------------------

@register("impute_mean", DC + """
SELECT c_custkey, round(coalesce(acctbal, (SELECT avg(acctbal) FROM dirty_customer)), 6) AS acctbal
FROM dirty_customer""")
def impute_mean(spark, sf):
    out = cells.fill_missing(view(spark, sf, "dirty_customer"), "acctbal", "mean")
    return out.select("c_custkey", F.round("acctbal", 6).alias("acctbal"))


@register("impute_median", DC + """
SELECT c_custkey, round(coalesce(acctbal, (SELECT quantile_cont(acctbal, 0.5) FROM dirty_customer)), 6) AS acctbal
FROM dirty_customer""")
def impute_median(spark, sf):
    out = cells.fill_missing(view(spark, sf, "dirty_customer"), "acctbal", "median")
    return out.select("c_custkey", F.round("acctbal", 6).alias("acctbal"))


@register("impute_mode", DC + """
SELECT c_custkey, coalesce(segment_gap, (SELECT segment_gap FROM dirty_customer WHERE segment_gap IS NOT NULL
  GROUP BY segment_gap ORDER BY count(*) DESC, segment_gap LIMIT 1)) AS segment_gap
FROM dirty_customer""")
def impute_mode(spark, sf):
    return cells.fill_missing(view(spark, sf, "dirty_customer"), "segment_gap", "mode").select(
        "c_custkey", "segment_gap")


@register("impute_constant", DC + """
SELECT c_custkey, coalesce(acctbal, 0.0) AS acctbal, coalesce(nation_txt, 'unknown') AS nation_txt
FROM dirty_customer""")
def impute_constant(spark, sf):
    d = cells.fill_missing(view(spark, sf, "dirty_customer"), "acctbal", "constant", "0")
    d = cells.fill_missing(d, "nation_txt", "constant", "unknown")
    return d.select("c_custkey", "acctbal", "nation_txt")


# --- columns --------------------------------------------------------------------------

@register("drop_columns", DC + "SELECT c_custkey, acctbal, segment FROM dirty_customer")
def drop_columns(spark, sf):
    return cells.drop_column(view(spark, sf, "dirty_customer"), ["segment_gap", "NATION_TXT "])


@register("rename_column", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS market_segment FROM customer""")
def rename_column(spark, sf):
    return cells.rename_column(table(spark, sf, "customer"), "C_MktSegment", "market_segment")


# --- types ----------------------------------------------------------------------------

@register("cast_int", DC + f"""
SELECT c_custkey, CAST({num_sql('nation_txt')} AS BIGINT) AS nation_txt FROM dirty_customer""")
def cast_int(spark, sf):
    return cells.convert_dtype(view(spark, sf, "dirty_customer"), "nation_txt", "int").select("c_custkey", "nation_txt")


@register("cast_float", DC + f"SELECT c_custkey, {num_sql('nation_txt')} AS nation_txt FROM dirty_customer")
def cast_float(spark, sf):
    return cells.convert_dtype(view(spark, sf, "dirty_customer"), "nation_txt", "float").select(
        "c_custkey", "nation_txt")


@register("cast_str", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def cast_str(spark, sf):
    return cells.convert_dtype(table(spark, sf, "customer"), "c_nationkey", "str").select("c_custkey", "c_nationkey")


@register("cast_datetime", DO + f"SELECT o_orderkey, {ts_sql('orderdate_txt')} AS orderdate_txt FROM dirty_orders")
def cast_datetime(spark, sf):
    return cells.convert_dtype(view(spark, sf, "dirty_orders"), "orderdate_txt", "datetime").select(
        "o_orderkey", "orderdate_txt")


@register("cast_category", DC + """
SELECT c_custkey, segment, CAST(CASE WHEN segment IS NULL THEN -1 ELSE
  dense_rank() OVER (PARTITION BY segment IS NULL ORDER BY segment) - 1 END AS INTEGER) AS segment_code
FROM dirty_customer""")
def cast_category(spark, sf):
    d = cells.convert_dtype(view(spark, sf, "dirty_customer"), "segment", "category")
    return cells.category_codes(d, "segment").select("c_custkey", "segment", "segment_code")


@register("cast_bool", DC + """
SELECT d.c_custkey, c.c_nationkey <> 0 AS c_nationkey, coalesce(length(d.nation_txt) > 0, false) AS nation_txt
FROM dirty_customer d JOIN customer c ON c.c_custkey = d.c_custkey""")
def cast_bool(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    d = view(spark, sf, "dirty_customer").select("c_custkey", "nation_txt")
    both = d.join(c, "c_custkey")
    both = cells.convert_dtype(both, "c_nationkey", "bool")
    return cells.convert_dtype(both, "nation_txt", "bool", truthy=True)


# --- outliers and ranges ---------------------------------------------------------------

@register("outliers_cap", _EVENT_FENCE + """
SELECT e.event_id, round(CASE WHEN e.value < b.lo THEN b.lo WHEN e.value > b.hi THEN b.hi ELSE e.value END, 6)
  AS value FROM events e, b""")
def outliers_cap(spark, sf):
    out = cells.cap_outliers(table(spark, sf, "events"), "value")
    return out.select("event_id", F.round("value", 6).alias("value"))


@register("clip_range", DC + """
SELECT c_custkey, CASE WHEN acctbal < 0 THEN 0.0 WHEN acctbal > 5000 THEN 5000.0 ELSE acctbal END AS acctbal
FROM dirty_customer""")
def clip_range(spark, sf):
    return cells.clip_numeric_range(view(spark, sf, "dirty_customer"), "acctbal", 0, 5000).select(
        "c_custkey", "acctbal")


# --- text -----------------------------------------------------------------------------

@register("text_trim", DC + "SELECT c_custkey, trim(segment) AS segment FROM dirty_customer")
def text_trim(spark, sf):
    return cells.standardize_text(view(spark, sf, "dirty_customer"), "segment").select("c_custkey", "segment")


@register("text_lower", DC + "SELECT c_custkey, lower(trim(segment)) AS segment FROM dirty_customer")
def text_lower(spark, sf):
    return cells.standardize_text(view(spark, sf, "dirty_customer"), "segment", case="lower").select(
        "c_custkey", "segment")


@register("text_upper", DC + "SELECT c_custkey, upper(trim(segment)) AS segment FROM dirty_customer")
def text_upper(spark, sf):
    return cells.standardize_text(view(spark, sf, "dirty_customer"), "segment", case="upper").select(
        "c_custkey", "segment")


@register("text_title", """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(trim(p_name), '([A-Za-z]+|[^A-Za-z]+)'),
  lambda r: upper(r[1]) || lower(r[2:])), '') AS p_name FROM part""")
def text_title(spark, sf):
    return cells.standardize_text(table(spark, sf, "part"), "p_name", case="title").select("p_partkey", "p_name")


@register("replace_exact", DC + """
SELECT c_custkey, CASE WHEN segment = 'BUILDING' THEN 'CONSTRUCTION' ELSE segment END AS segment
FROM dirty_customer""")
def replace_exact(spark, sf):
    return cells.find_and_replace(view(spark, sf, "dirty_customer"), "segment", "BUILDING", "CONSTRUCTION").select(
        "c_custkey", "segment")


@register("replace_nocase", DC + """
SELECT c_custkey, CASE WHEN lower(segment) = 'building' THEN 'CONSTRUCTION' ELSE segment END AS segment
FROM dirty_customer""")
def replace_nocase(spark, sf):
    return cells.find_and_replace(view(spark, sf, "dirty_customer"), "segment", "Building", "CONSTRUCTION",
                                  match_case=False).select("c_custkey", "segment")


@register("split_column", """
SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS p_first,
  CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) END AS p_rest FROM part""")
def split_column(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return cells.split_column(p, "p_name", " ", ["p_first", "p_rest"])


@register("merge_columns", """
SELECT c_custkey, c_acctbal, concat_ws(' | ', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS label
FROM customer""")
def merge_columns(spark, sf):
    c = table(spark, sf, "customer")
    return cells.merge_columns(c, ["c_name", "c_mktsegment", "c_nationkey"], "label", " | ")


@register("datetime_parts", """
SELECT event_id, ts, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
  CAST(day(ts) AS INTEGER) AS ts_day, dayname(ts) AS ts_weekday, CAST(hour(ts) AS INTEGER) AS ts_hour,
  CAST(minute(ts) AS INTEGER) AS ts_minute, CAST(quarter(ts) AS INTEGER) AS ts_quarter FROM events""")
def datetime_parts(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return cells.extract_datetime_parts(e, "ts", ["year", "month", "day", "weekday", "hour", "minute", "quarter"])


@register("anomalies_numeric", DC + f"""
SELECT c_custkey, CASE WHEN nation_txt IS NOT NULL AND {num_sql('nation_txt')} IS NULL THEN NULL
  ELSE nation_txt END AS nation_txt FROM dirty_customer""")
def anomalies_numeric(spark, sf):
    return cells.remove_type_anomalies(view(spark, sf, "dirty_customer"), "nation_txt", "numeric").select(
        "c_custkey", "nation_txt")


@register("anomalies_datetime", DO + f"""
SELECT o_orderkey, CASE WHEN orderdate_txt IS NOT NULL AND {ts_sql('orderdate_txt')} IS NULL THEN NULL
  ELSE orderdate_txt END AS orderdate_txt FROM dirty_orders""")
def anomalies_datetime(spark, sf):
    return cells.remove_type_anomalies(view(spark, sf, "dirty_orders"), "orderdate_txt", "datetime").select(
        "o_orderkey", "orderdate_txt")


# --- numbers as users write them ------------------------------------------------------

@register("filter_double", ODD + """
SELECT p_partkey, d, b FROM odd_numbers
WHERE NOT coalesce(d IN (5, 10000000, 0.0001::DOUBLE, 9007199254740993), false) AND b <> 9007199254740993""")
def filter_double(spark, sf):
    out = view(spark, sf, "odd_numbers")
    for value in ("5", "10000000", "0.0001", 9007199254740993):
        out = rows.filter_rows(out, "d", "equals", value)
    return rows.filter_rows(out, "b", "equals", "9007199254740993")


@register("contains_double", ODD + """
SELECT p_partkey, d, b FROM odd_numbers WHERE NOT coalesce(regexp_matches(CAST(d AS VARCHAR), '^1000|e[-+]'), false)
  AND NOT regexp_matches(CAST(b AS VARCHAR), '993$')""")
def contains_double(spark, sf):
    out = rows.filter_rows(view(spark, sf, "odd_numbers"), "d", "contains", "^1000|e[-+]")
    return rows.filter_rows(out, "b", "contains", "993$")


@register("replace_double", ODD + """
SELECT p_partkey, CASE WHEN d = 0.0001::DOUBLE THEN 7.5::DOUBLE WHEN d = 10000000 THEN 1 ELSE d END AS d,
  CASE WHEN b = 9007199254740993 THEN 'big' ELSE CAST(b AS VARCHAR) END AS b FROM odd_numbers""")
def replace_double(spark, sf):
    out = cells.find_and_replace(view(spark, sf, "odd_numbers"), "d", "10000000.0", "1")
    out = cells.find_and_replace(out, "d", "1e-4", 7.5)
    return cells.find_and_replace(out, "b", "9007199254740993", "big")


@register("merge_double", ODD + """
SELECT p_partkey, concat_ws('/', CAST(d AS VARCHAR), CAST(b AS VARCHAR)) AS both FROM odd_numbers""")
def merge_double(spark, sf):
    return cells.merge_columns(view(spark, sf, "odd_numbers"), ["d", "b"], "both", "/")


@register("cast_str_double", ODD + """
SELECT p_partkey, coalesce(CAST(d AS VARCHAR), 'nan') AS d, CAST(b AS VARCHAR) AS b FROM odd_numbers""")
def cast_str_double(spark, sf):
    out = cells.convert_dtype(view(spark, sf, "odd_numbers"), "d", "str", null_text="nan")
    return cells.convert_dtype(out, "b", "str")

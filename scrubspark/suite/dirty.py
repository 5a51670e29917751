"""Dirty views over the driver's clean tables. The same SQL text runs in Spark (tables
passed as DataFrame arguments to ``spark.sql``) and in DuckDB (inlined as CTEs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "dirty_customer": ("customer", """
SELECT c_custkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
  CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_mktsegment) WHEN 1 THEN lower(c_mktsegment)
    WHEN 2 THEN concat(c_mktsegment, ' ') ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 11 = 0 THEN 'forty' WHEN c_custkey % 13 = 0 THEN NULL
    ELSE CAST(c_nationkey AS STRING) END AS nation_txt,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS segment_gap
FROM {customer}"""),
    "dup_orders": ("orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 0 AS copy_no FROM {orders}
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 1 AS copy_no FROM {orders} WHERE o_orderkey % 10 = 0"""),
    "dirty_orders": ("orders", """
SELECT o_orderkey, o_totalprice,
  CASE WHEN o_orderkey % 17 = 0 THEN 'not a date' WHEN o_orderkey % 19 = 0 THEN NULL
    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS orderdate_txt,
  o_orderpriority
FROM {orders}"""),
    "odd_numbers": ("part", """
SELECT p_partkey,
  CASE p_partkey % 9 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(10000000 AS DOUBLE) WHEN 2 THEN CAST(0.0001 AS DOUBLE)
    WHEN 3 THEN CAST(9007199254740993 AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN CAST('1.5e-05' AS DOUBLE)
    WHEN 6 THEN CAST('2e+16' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) * -1000000 + 0.25 END AS d,
  CASE WHEN p_partkey % 5 = 0 THEN 9007199254740993 ELSE CAST(p_partkey AS BIGINT) % 12 END AS b
FROM {part}"""),
    "gap_events": ("events", """
SELECT event_id, value,
  CASE WHEN event_id >= 4000 AND event_id < 4400 THEN NULL ELSE value END AS v_block,
  CASE WHEN event_id < 900 AND event_id % 2 = 0 THEN NULL ELSE value END AS v_front,
  CASE WHEN event_id >= 9000 AND event_id % 2 = 0 THEN NULL ELSE value END AS v_tail,
  CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS v_sporadic,
  CAST(NULL AS DOUBLE) AS v_all
FROM {events}"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = VIEWS[name]
    return spark.sql(sql, **{base: table(spark, sf_dir, base)})


def with_views(*names: str) -> str:
    """A DuckDB ``WITH`` prefix defining the named dirty views over the registered tables."""
    parts = []
    for n in names:
        base, sql = VIEWS[n]
        parts.append(f"{n} AS ({sql.replace('{' + base + '}', base)})")
    return "WITH " + ",\n".join(parts) + "\n"

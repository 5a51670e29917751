"""Checks for profiles that are kept beside a table and merged (whole tables, written in appends)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.operators import states
from scrubspark.session import scratch_path
from scrubspark.suite.dirty import table, view, with_views
from scrubspark.suite.registry import register

DC = with_views("dirty_customer")


def _appended(df: DataFrame, key: str, appends: int = 3) -> DataFrame:
    """The summary of ``df`` written in appends, states brought up to date after each; only new files are read."""
    spark = df.sparkSession
    path, beside = scratch_path(spark, "appended"), scratch_path(spark, "states")
    for i in range(appends):
        df.where(F.pmod(F.col(key), F.lit(appends)) == i).write.mode("append").parquet(path)
        states.update_states(spark, path, beside)
    return states.summarise(states.current_states(spark, path, beside))


def _moments_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS null_count, "
            f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 4) AS std, round(skewness({c}), 3) + 0.0::DOUBLE AS skewness, round(kurtosis({c}), 3) AS kurtosis "
            f"FROM dirty_customer")


@register("profile_appended", DC + "\nUNION ALL\n".join(_moments_sql(c) for c in ["c_custkey", "acctbal"]))
def profile_appended(spark, sf):
    s = _appended(view(spark, sf, "dirty_customer"), "c_custkey")
    return s.where(F.col("mean").isNotNull()).select("column", F.col("rows").alias("n_rows"), "null_count", "min", "max",
                                                     "mean", "std", "skewness", "kurtosis")


def _top_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column, {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) "
            f"AS INTEGER) AS rank, count(*) OVER () AS unique_count FROM dirty_customer "
            f"WHERE {c} IS NOT NULL GROUP BY {c}")


@register("profile_appended_tops", DC + 'SELECT "column", value, n, rank, unique_count, true AS top_exact FROM (' +
          "\nUNION ALL\n".join(_top_sql(c) for c in ["segment", "nation_txt", "segment_gap"]) + ") WHERE rank <= 5")
def profile_appended_tops(spark, sf):
    s = _appended(view(spark, sf, "dirty_customer"), "c_custkey").where(F.col("top_categories").isNotNull())
    e = s.select("column", "unique_count", "top_exact", F.posexplode("top_categories").alias("i", "t"))
    return e.select("column", F.col("t.value").alias("value"), F.col("t.n").alias("n"), (F.col("i") + 1).alias("rank"),
                    "unique_count", "top_exact")


@register("profile_appended_dates", """
SELECT 'o_orderdate' AS column, count(*) AS n_rows, CAST(min(o_orderdate) AS VARCHAR) AS dt_min,
  CAST(max(o_orderdate) AS VARCHAR) AS dt_max FROM orders""")
def profile_appended_dates(spark, sf):
    s = _appended(table(spark, sf, "orders"), "o_orderkey")
    return s.where(F.col("dt_min").isNotNull()).select("column", F.col("rows").alias("n_rows"), "dt_min", "dt_max")

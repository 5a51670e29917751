"""Parquet with the table order made explicit.

A Spark table has no row order, but "first duplicate" and "where do the nulls sit" are
about table order. For Parquet that order is (file, row within file), which Spark exposes
as hidden metadata columns; reading them costs nothing extra and keeps the scan splittable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_COLUMNS = ["_file", "_row"]


def read_parquet_ordered(spark: SparkSession, path: str) -> DataFrame:
    """All columns plus ``_file`` and ``_row``; ordering by them is file order."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def file_order(df: DataFrame) -> list[str]:
    """The columns that give the order of the source's files, if it was read with them."""
    from scrubspark.sources import csv

    for columns in (ORDER_COLUMNS, csv.ORDER_COLUMNS):
        if all(c in df.columns for c in columns):
            return list(columns)
    raise ValueError("rows have no order here: name columns in order_by, or read the source with its file order")

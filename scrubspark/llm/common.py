"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The word pattern of the query contracts and its white space, as SQL/Java text.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

ID_KEY, TEXT_KEY = "__id_key", "__text_key"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact spelling.

    Other columns, also ones whose names differ only in case or repeat a name, are left out
    (of several columns of the same name the first counts).
    """
    cols = df.columns
    missing = [n for n in names if n not in cols]
    if missing:
        raise ValueError(f"no column {missing}; there are {cols}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return flat.select(*[F.col(f"_c{cols.index(n)}").alias(n) for n in names])


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """A join key that is never null: the id, and a hash of the text.

    Rows that repeat both are the same document; equal ids with different texts are not.
    """
    return [F.coalesce(doc_id, F.lit(-(2**63)).cast("long")).alias(ID_KEY),
            F.xxhash64(text, doc_id.isNull(), text.isNull()).alias(TEXT_KEY)]


def semi_filter(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                anti: bool = False, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose row key is (``anti``: is not) in ``keys``, with all columns as they came.

    ``once`` keeps one row of those that repeat a key.
    """
    cols = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    flat = flat.select("*", *row_keys(F.col(f"_c{cols.index(id_col)}"), F.col(f"_c{cols.index(text_col)}")))
    out = flat.join(keys.select(ID_KEY, TEXT_KEY), [ID_KEY, TEXT_KEY], "left_anti" if anti else "left_semi")
    if once:
        out = out.dropDuplicates([ID_KEY, TEXT_KEY])
    return out.drop(ID_KEY, TEXT_KEY).toDF(*cols)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Text counts by hash and row fingerprints, against counting whole values and rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrubspark.operators import reports


def brute_top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def texts():
    r = random.Random(3)
    head = "the same first words of very many texts, longer than what is kept " * 2
    values = [head + str(r.randrange(40)) for _ in range(200)] + [r.choice("abc") for _ in range(50)] + [None] * 30
    values += [head + "once " + str(i) for i in range(100)] + ["", "", "é" * 70, "é" * 70 + "z", "\U0001F642" * 64, "é" * 64]
    r.shuffle(values)
    return values


@pytest.mark.parametrize("looked_up", [100_000, 3])
@pytest.mark.parametrize("k", [5, 60])
def test_top_texts_with_ties_and_long_heads(spark, monkeypatch, k, looked_up):
    monkeypatch.setattr(reports, "LOOKED_UP", looked_up)
    values = texts()
    df = spark.createDataFrame([(v, v and v[-1:]) for v in values], "a string, b string").repartition(5)
    distinct, tops = reports._text_tops(df, {0: F.col("a"), 1: F.col("b")}, k)
    want = {0: brute_top(values, k), 1: brute_top([v and v[-1:] for v in values], k)}
    got = {i: [(x.value, x.n) for x in tops.where(F.col("i") == i).orderBy("rank").collect()] for i in want}
    assert got == want
    assert {x.i: x.unique_count for x in distinct.collect()} == {0: len(set(values) - {None}),
                                                                 1: len({v and v[-1:] for v in values} - {None})}


def test_value_counts_of_texts_with_nulls(spark):
    values = texts()
    df = spark.createDataFrame([(v,) for v in values], "a string")
    got = [(x.value, x.n) for x in reports.value_counts(df, "a", 7).orderBy("rank").collect()]
    want = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0] is None, (x[0] or "").encode()))[:7]
    assert got == want
    assert reports.value_counts(df.where("a = 'none such'"), "a").count() == 0


def test_no_text_goes_through_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(v,) for v in texts()], "a string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    distinct, tops = reports._text_tops(df, {0: F.col("a")}, 0)
    plan = distinct._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i" in plan and "hashpartitioning(value" not in plan and "a#" not in plan.split("Exchange")[1]


ROWS = [(1, 2.0, "a"), (1, 2.0, "a"), (1, None, "a"), (None, 1.0, "a"), (1, 0.0, None), (1, -0.0, None), (None, None, None),
        (None, None, None), (2, float("nan"), "x"), (2, float("nan"), "x"), (3, 1.0, "a")]


@pytest.mark.parametrize("fingerprint", [None, "7L", "coalesce(i % 2, -9)"])
def test_shape_with_planted_collisions(spark, fingerprint):
    df = spark.createDataFrame(ROWS, "i int, d double, s string").repartition(3)
    fp = None if fingerprint is None else F.expr(fingerprint).cast("long")
    assert tuple(reports.table_shape(df, fp).first()) == (11, 3, 4)
    assert tuple(reports.table_shape(df.distinct(), fp).first()) == (7, 3, 0)
    assert tuple(reports.table_shape(df.where("false"), fp).first()) == (0, 3, 0)


def test_equal_rows_have_equal_fingerprints_and_nulls_count(spark):
    df = spark.createDataFrame(ROWS, "i int, d double, s string")
    fps = [x[0] for x in df.select(reports.row_fingerprint(df)).collect()]
    assert fps[0] == fps[1] and fps[4] == fps[5] and fps[6] == fps[7] and fps[8] == fps[9] and len(set(fps)) == 7

"""The run summaries against a loop over the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubspark.operators import reports
from scrubspark.plans import runs
from scrubspark.plans.runs import Runs, flagged_runs
from scrubspark.sources.parquet import ORDER_COLUMNS, read_parquet_ordered


def brute(flags):
    longest = run = 0
    for f in flags:
        run = run + 1 if f else 0
        longest = max(longest, run)
    return longest


def test_summaries_join_like_the_whole():
    r = random.Random(1)
    for _ in range(500):
        flags = np.array([r.random() < r.choice([0.1, 0.5, 0.95]) for _ in range(r.randrange(0, 40))], bool)
        cuts = sorted(r.randrange(0, len(flags) + 1) for _ in range(r.randrange(0, 6)))
        parts = [Runs.of(flags[a:b]) for a, b in zip([0, *cuts], [*cuts, len(flags)])]
        left = sum(parts, Runs())
        right = Runs()
        for p in reversed(parts):
            right = p + right
        assert left == right == Runs.of(flags)
        assert left.longest == brute(flags)


@pytest.mark.parametrize("least,few", [(1, 1), (7, 2), (1024, 10_000)])
def test_any_order_with_ties_and_nulls(spark, monkeypatch, least, few):
    monkeypatch.setattr(runs, "LEAST_PIECE", least)
    monkeypatch.setattr(runs, "FEW_ROWS", few)
    r = random.Random(least)
    rows = [(r.choice([None, 1, 2, 3, 50]), r.randrange(6), r.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, f boolean").repartition(5)
    flags = [x[2] for x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))]
    ranks = [0, 1, 99, 100, 101, 200, 299, 300]
    whole, below = flagged_runs(df, ["a", "b"], F.col("f"), len(rows), ranks)
    assert whole == Runs.of(np.array(flags))
    assert below == [sum(flags[:k]) for k in ranks]


def _files(spark, path, n=4000, parts=7):
    r = random.Random(3)
    rows = [(i, None if 500 <= i < 900 or r.random() < 0.1 else i) for i in range(n)]
    spark.createDataFrame(rows, "id int, v int").repartition(parts).write.parquet(path)
    return read_parquet_ordered(spark, path)


def test_file_order_moves_no_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "LEAST_PIECE", 100)
    df = _files(spark, str(tmp_path / "t"))
    rows = df.orderBy(*ORDER_COLUMNS).collect()
    flags = [x["v"] is None for x in rows]
    laid = []
    monkeypatch.setattr(type(df), "repartitionByRange", lambda *a: laid.append(a) or pytest.fail("rows are moved"))
    whole, below = flagged_runs(df, ORDER_COLUMNS, F.col("v").isNull(), 4000, [0, 1334, 2667, 4000], files=True)
    assert whole == Runs.of(np.array(flags)) and not laid
    assert below == [sum(flags[:k]) for k in (0, 1334, 2667, 4000)]


@pytest.mark.parametrize("change", [lambda d: d.where("id % 3 <> 0"), lambda d: d.repartition(6),
                                    lambda d: d.repartition(5, "id"), lambda d: d.union(d)])
def test_rows_left_out_or_moved_after_the_scan(spark, tmp_path, monkeypatch, change):
    monkeypatch.setattr(runs, "LEAST_PIECE", 50)
    df = change(_files(spark, str(tmp_path / "t"), 900, 3))
    rows = df.orderBy(*ORDER_COLUMNS).collect()
    flags = [x["v"] is None for x in sorted(rows, key=lambda x: (x["_file"], x["_row"], x["v"] is None))]
    whole, below = flagged_runs(df, ORDER_COLUMNS, F.col("v").isNull(), len(rows), [len(rows) // 3], files=True)
    assert whole == Runs.of(np.array(flags))
    assert below == [sum(flags[: len(rows) // 3])]


def test_pattern_in_file_order_and_by_column(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 3000, 1, 1).selectExpr("id", "if(id between 100 and 700, null, id) as v").write.parquet(path)
    df = read_parquet_ordered(spark, path)
    want = ("v", 3000, 601, 20.03, 1.0, 0.0, 601, "front-loaded")
    assert tuple(reports.detect_missing_pattern(df, "v").first()) == want
    assert tuple(reports.detect_missing_pattern(df, "v", ["id"]).first()) == want
    empty = reports.detect_missing_pattern(df.where("id < 0"), "v").first()
    assert tuple(empty) == ("v", 0, 0, 0.0, 0.0, 0.0, 0, "none")

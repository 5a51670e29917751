"""The distributed algorithms against brute force on small fixtures, including hot keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubspark.functions import stats
from scrubspark.operators import correlation, reports
from scrubspark.plans.ordered import positions, prefix_sums


def test_prefix_sums_segmented_with_hot_segment(spark):
    rnd = random.Random(7)
    # one segment holds most rows, so it spans several range partitions
    data = [(0 if rnd.random() < 0.6 else rnd.randint(1, 20), i, rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "seg int, o long, v long")
    got = {(r["seg"], r["o"]): r["v_before"] for r in prefix_sums(df, ["o"], ["v"], ["seg"], 6).collect()}
    pdf = pd.DataFrame(data, columns=["seg", "o", "v"]).sort_values(["seg", "o"])
    pdf["before"] = pdf.groupby("seg")["v"].cumsum() - pdf["v"]
    want = {(s, o): b for s, o, b in zip(pdf.seg, pdf.o, pdf.before)}
    assert got == want


def test_positions_dense(spark):
    df = spark.range(2500).select((F.col("id") * 7919 % 2500).alias("k"))
    got = sorted((r["k"], r["position"]) for r in positions(df, ["k"], num_partitions=5).collect())
    assert got == [(i, i) for i in range(2500)]


def test_quantiles_exact_with_hot_value(spark):
    rnd = np.random.default_rng(3)
    vals = np.concatenate([rnd.normal(size=4000), np.full(3000, 0.25), rnd.exponential(size=1000)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    got = stats.quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0], accuracy=200)
    for p in [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]:
        assert got[("x", p)] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "s string")
    assert stats.mode(df, "s") == "a"


def _kendall_brute(x, y):
    s = n1 = n2 = n0 = 0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            n0 += 1
            s += dx * dy
            n1 += dx == 0
            n2 += dy == 0
    return s / np.sqrt((n0 - n1) * (n0 - n2))


def test_kendall_and_spearman_with_ties_and_nulls(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(300):
        a = rnd.randint(0, 30)
        b = a + rnd.randint(-10, 10) if rnd.random() < 0.9 else None
        c = float(rnd.randint(0, 5)) if rnd.random() < 0.95 else None
        rows.append((a, b, c))
    df = spark.createDataFrame(rows, "a int, b int, c double")
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"], dtype="float")
    tau = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.compute_correlation(df, "kendall", 0.0).collect()}
    rho = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.compute_correlation(df, "spearman", 0.0).collect()}
    for a, b in [("a", "b"), ("a", "c"), ("b", "c")]:
        m = pdf[[a, b]].dropna()
        assert tau[(a, b)] == pytest.approx(round(_kendall_brute(m[a].to_numpy(), m[b].to_numpy()), 3), abs=1e-9)
        want = m[a].rank().corr(m[b].rank())
        assert rho[(a, b)] == pytest.approx(round(want, 3), abs=1e-9)


def test_missing_pattern_block_spanning_partitions(spark):
    n = 5000
    df = spark.range(n).select(F.col("id").alias("pos"),
                               F.when((F.col("id") >= 2000) & (F.col("id") < 2600), None)
                               .otherwise(F.col("id")).alias("v"))
    r = reports.detect_missing_pattern(df, "v", ["pos"]).first()
    assert r["longest_run"] == 600 and r["pattern"] == "systematic block" and r["n_missing"] == 600


def test_table_shape_and_summary(people):
    shape = reports.table_shape(people).first()
    assert (shape["n_rows"], shape["n_columns"], shape["duplicate_rows"]) == (8, 10, 1)
    summ = {r["column"]: r for r in reports.column_summary(people).collect()}
    assert summ["age"]["null_count"] == 2 and summ["age"]["max"] == 160.0
    assert summ["status"]["top_categories"][0]["value"] == "active"
    assert summ["city"]["unique_count"] == 6


def test_pearson_wide_table_in_batches(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(400, 1))
    data = base + rnd.normal(scale=rnd.uniform(0.1, 3.0, size=25), size=(400, 25))
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(25)])
    df = spark.createDataFrame(pdf)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.compute_correlation(df, "pearson", 0.0).collect()}
    want = pdf.corr()
    assert len(got) == 300
    for (a, b), r in got.items():
        assert r == pytest.approx(round(want.loc[a, b], 3), abs=1e-9)


def test_column_summary_approximate_distinct(people):
    summ = {r["column"]: r for r in reports.column_summary(people, exact_distinct=False).collect()}
    assert summ["city"]["unique_count"] == 6 and summ["status"]["top_categories"][0]["value"] == "active"


def test_approximate_summary_shuffles_no_values(spark, people):
    approx, exact = (reports.column_summary(people, 3, exact_distinct=e) for e in (False, True))
    assert "hashpartitioning" not in approx._jdf.queryExecution().executedPlan().toString()
    assert dict(approx.dtypes) == dict(exact.dtypes)
    assert [r["top_categories"] for r in approx.collect()] == [r["top_categories"] for r in exact.collect()]


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_correlation_in_passes(spark, monkeypatch, method):
    monkeypatch.setattr(correlation, "RANKED_PAIRS_PER_PASS", 2)
    pdf = pd.DataFrame(np.random.default_rng(6).integers(0, 9, (120, 4)).astype(float), columns=list("abcd"))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.compute_correlation(
        spark.createDataFrame(pdf), method, 0.0).collect()}
    want = pdf.rank().corr() if method == "spearman" else None
    assert len(got) == 6
    for (a, b), r in got.items():
        w = want.loc[a, b] if want is not None else tau_b(pdf[a].tolist(), pdf[b].tolist())
        assert r == pytest.approx(round(w, 3), abs=1e-9)


def tau_b(x, y):
    s = tx = ty = 0
    n = len(x)
    for i in range(n):
        for j in range(i):
            a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
            s, tx, ty = s + a * b, tx + (a != 0), ty + (b != 0)
    return s / (tx * ty) ** 0.5


def test_approximate_quantiles_opt_in_is_close(spark):
    vals = np.random.default_rng(9).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = stats.quantiles(df, ["x"], [0.25, 0.5, 0.75], accuracy=1000, exact=False)
    for p in [0.25, 0.5, 0.75]:
        rank = (vals < got[("x", p)]).mean()
        assert abs(rank - p) <= 2 / 1000 + 1 / 5000


def test_reports_on_an_empty_table(spark):
    from scrubspark.operators import cells, rows

    df = spark.createDataFrame([], "id long, x double, s string")
    assert reports.table_shape(df).first()["n_rows"] == 0
    assert {r["column"]: r["null_pct"] for r in reports.column_summary(df).collect()} == {"id": 0.0, "x": 0.0,
                                                                                       "s": 0.0}
    prof = reports.profile_column(df, "x").first()
    assert prof["rows"] == 0 and prof["quality_score"] == 100.0
    assert reports.value_counts(df, "s").count() == 0
    pat = reports.detect_missing_pattern(df, "x", ["id"]).first()
    assert pat["pattern"] == "none" and pat["n_rows"] == 0
    assert reports.detect_outliers_report(df).where("n_outliers > 0").count() == 0
    assert correlation.compute_correlation(df, "pearson", 0.0).count() == 0
    assert cells.fill_missing(df, "x", "median").count() == 0
    assert rows.remove_outliers(df, "x").count() == 0


def test_prefix_sums_null_segment_spans_ranges(spark):
    data = [(None if i % 3 else i % 2, i, 1) for i in range(2000)]
    df = spark.createDataFrame(data, "seg int, o long, v long")
    got = {r["o"]: r["v_before"] for r in prefix_sums(df, ["o"], ["v"], ["seg"], 7).collect()}
    pdf = pd.DataFrame(data, columns=["seg", "o", "v"])
    pdf["seg"] = pdf["seg"].fillna(-1)
    pdf = pdf.sort_values(["seg", "o"])
    pdf["b"] = pdf.groupby("seg")["v"].cumsum() - pdf["v"]
    assert got == dict(zip(pdf.o, pdf.b))


def test_tied_keys_over_many_ranges_keep_the_total(spark, tmp_path):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 2), rnd.randint(0, 4), rnd.randint(0, 9)) for _ in range(4000)]
    spark.createDataFrame(data, "seg int, o long, v long").repartition(9).write.parquet(str(tmp_path / "ties"))
    got = prefix_sums(spark.read.parquet(str(tmp_path / "ties")), ["o"], ["v"], ["seg"], 5).collect()
    for seg in range(3):
        mine = sorted((r["o"], r["v_before"], r["v"]) for r in got if r["seg"] == seg)
        ends = sorted(b + v for _, b, v in mine)
        assert ends[-1] == sum(v for _, _, v in mine)   # the last row of a segment ends at its total
        for o in range(5):   # and each group of ties fills exactly its stretch
            low = sum(v for k, _, v in mine if k < o)
            assert min(b for k, b, _ in mine if k == o) == low
            assert max(b + v for k, b, v in mine if k == o) == low + sum(v for k, _, v in mine if k == o)


def test_profile_columns_equals_profile_column(people):
    fused = {r["column"]: r for r in reports.profile_columns(people).collect()}
    for c in people.columns:
        one = reports.profile_column(people, c).first().asDict()
        got = fused[c].asDict()
        for k, v in one.items():
            assert got[k] == v, (c, k, got[k], v)


def test_wide_table_summary_and_profile_in_chunks(spark):
    rnd = np.random.default_rng(21)
    data = rnd.normal(size=(300, 40)).round(3)
    data[rnd.random(size=data.shape) < 0.05] = np.nan
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(40)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"c{i} double" for i in range(40)))
    summ = {r["column"]: r for r in reports.column_summary(df).collect()}
    prof = {r["column"]: r for r in reports.profile_columns(df).collect()}
    assert len(summ) == 40 and len(prof) == 40
    from decimal import ROUND_HALF_UP, Decimal

    def half_up(x, d):  # the reports round half-up on the decimal form (SURVEY S7), as Spark and DuckDB do
        return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP))

    for c in pdf.columns:
        s = pdf[c]
        assert summ[c]["null_count"] == int(s.isna().sum()) and summ[c]["unique_count"] == s.nunique()
        assert summ[c]["mean"] == pytest.approx(half_up(s.mean(), 4), abs=1.5e-4)
        assert prof[c]["std"] == pytest.approx(half_up(s.std(), 3), abs=1.5e-3)
        assert prof[c]["median"] == half_up(s.median(), 3)
        assert prof[c]["skewness"] == pytest.approx(half_up(s.skew(), 3), abs=1.5e-3)
        assert prof[c]["kurtosis"] == pytest.approx(half_up(s.kurt(), 3), abs=1.5e-3)


def test_quantiles_refinement_rounds_stay_exact(spark, monkeypatch):
    # force brackets to be "too wide" so the refinement rounds run on a small table
    monkeypatch.setattr(stats, "BRACKET_ROWS", 50)
    monkeypatch.setattr(stats, "REFINE_GRID", 20)

    def no_fallback(*a, **k):
        raise AssertionError("the exact pass fell back to percentile")

    monkeypatch.setattr(stats.F, "percentile", no_fallback)
    rnd = np.random.default_rng(13)
    vals = np.concatenate([rnd.normal(size=3000), np.full(2000, 1.5), rnd.exponential(size=2000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.01, 0.25, 0.5, 0.75, 0.999]
    got = stats.quantiles(df, ["x"], probs, accuracy=100)
    for p in probs:
        assert got[("x", p)] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)

"""Property tests: invariants that must hold for any input (few examples: each is a Spark job)."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scrubspark.functions import stats
from scrubspark.operators import cells, reports, rows
from scrubspark.plans.ordered import prefix_sums

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60)


def frame(spark, xs):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "id long, x double")


@SETTINGS
@given(xs=values, lo=st.integers(-30, 0), hi=st.integers(0, 30))
def test_clip_stays_in_bounds_and_keeps_rows(spark, xs, lo, hi):
    out = [r["x"] for r in cells.clip_numeric_range(frame(spark, xs), "x", lo, hi).orderBy("id").collect()]
    assert len(out) == len(xs)
    for a, b in zip(xs, out):
        assert (a is None and b is None) or (lo <= b <= hi and b == min(max(a, lo), hi))


@SETTINGS
@given(xs=values, strategy=st.sampled_from(["mean", "median", "mode"]))
def test_fill_leaves_no_nulls(spark, xs, strategy):
    out = [r["x"] for r in cells.fill_missing(frame(spark, xs), "x", strategy).collect()]
    if any(x is not None for x in xs):
        assert None not in out
    else:
        assert out == [None] * len(xs)


@SETTINGS
@given(xs=values)
def test_quantiles_equal_numpy(spark, xs):
    present = np.array([x for x in xs if x is not None], dtype=float)
    got = stats.quantiles(frame(spark, xs), ["x"], [0.0, 0.25, 0.5, 0.9, 1.0], accuracy=50)
    for p in [0.0, 0.25, 0.5, 0.9, 1.0]:
        want = float(np.quantile(present, p)) if len(present) else None
        assert (want is None and got[("x", p)] is None) or abs(got[("x", p)] - want) < 1e-9


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=80))
def test_prefix_sums_equal_pandas(spark, data):
    rows_ = [(s, i, v) for i, (s, v) in enumerate(data)]
    df = spark.createDataFrame(rows_, "seg int, o long, v long")
    got = {(r["seg"], r["o"]): r["v_before"] for r in prefix_sums(df, ["o"], ["v"], ["seg"], 3).collect()}
    pdf = pd.DataFrame(rows_, columns=["seg", "o", "v"]).sort_values(["seg", "o"])
    pdf["b"] = pdf.groupby("seg")["v"].cumsum() - pdf["v"]
    assert got == {(s, o): b for s, o, b in zip(pdf.seg, pdf.o, pdf.b)}


@SETTINGS
@given(mask=st.lists(st.booleans(), min_size=2, max_size=80))
def test_missing_run_equals_loop(spark, mask):
    xs = [None if m else 1 for m in mask]
    rep = reports.detect_missing_pattern(frame(spark, xs), "x", ["id"]).first()
    run = best = 0
    for m in mask:
        run = run + 1 if m else 0
        best = max(best, run)
    assert rep["n_missing"] == sum(mask) and rep["longest_run"] == best


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3)), min_size=1, max_size=40),
       keep=st.sampled_from(["first", "last", "none"]))
def test_dedup_idempotent_and_unique(spark, data, keep):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k int, v int, o int")
    once = rows.drop_duplicates(df, ["k"], keep, ["o"])
    twice = rows.drop_duplicates(once, ["k"], keep, ["o"])
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    assert len({r[0] for r in a}) == len(a)

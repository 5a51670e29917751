"""Kendall's grid counting against all pairs."""

import random

import numpy as np
import pytest

from scrubspark.operators import correlation


def brute(rows):
    return sum(a[2] * b[2] for a in rows for b in rows if a[0] < b[0] and a[1] > b[1])


def points(r, n, values):
    cells = {}
    for _ in range(n):
        x = 0.0 if r.random() < 0.3 else float(r.randrange(values))      # a third of all rows share one x
        cells[x, float(r.randrange(values)) if r.random() < 0.7 else -x] = r.randrange(1, 9)
    return [(x, y, w) for (x, y), w in cells.items()]


def test_weight_of_discordant_pairs():
    r = random.Random(2)
    for _ in range(200):
        rows = points(r, r.randrange(1, 60), r.choice([2, 5, 100]))
        x, y, w = (np.array(c) for c in zip(*rows))
        assert correlation.discordant_weight(x, y, w) == brute(rows)


@pytest.mark.parametrize("grid,strip,strip_max", [(1024, 10**6, 10**6), (1024, 20, 10**6), (3, 20, 10**6), (4, 10, 30)])
def test_strips_grid_and_levels(spark, monkeypatch, grid, strip, strip_max):
    monkeypatch.setattr(correlation, "GRID", grid)
    r = random.Random(grid + strip)
    by_pair = {k: points(r, n, v) for k, (n, v) in enumerate([(400, 1000), (300, 10), (1, 1), (150, 40)])}
    by_pair[4] = [(float(r.gauss(0, 1)), float(i), 1) for i in range(200)] + [(float("inf"), 0.5, 2)]
    cells = spark.createDataFrame([(k, *c) for k, cs in by_pair.items() for c in cs], "k int, x double, y double, cnt long")
    got = {r["k"]: r["d"] for r in correlation._discordant(cells, strip, strip_max).collect()}
    assert {k: got.get(k, 0.0) for k in by_pair} == {k: float(brute(c)) for k, c in by_pair.items()}


def test_report_equals_all_pairs_and_takes_no_rows(spark):
    import pandas as pd

    r = random.Random(6)
    frame = pd.DataFrame([(i, (i * 7) % 50, r.random() if i % 5 else None, 1.0) for i in range(300)], columns=list("abcd"))
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a long, b long, c double, d double")
    got = {(x.col_a, x.col_b): x.r for x in correlation.compute_correlation(df, "kendall", 0.0).collect()}

    def tau(p, q):
        v = frame[[p, q]].dropna().to_numpy()
        c = d = n1 = n2 = 0
        for i in range(len(v)):
            for j in range(i):
                s = np.sign(v[i, 0] - v[j, 0]) * np.sign(v[i, 1] - v[j, 1])
                c, d = c + (s > 0), d + (s < 0)
                n1, n2 = n1 + (v[i, 0] == v[j, 0]), n2 + (v[i, 1] == v[j, 1])
        n0 = len(v) * (len(v) - 1) / 2
        return round((c - d) / np.sqrt((n0 - n1) * (n0 - n2)), 3)

    assert all(m[0] != "d" and m[1] != "d" for m in [(x.col_a, x.col_b) for x in correlation.compute_correlation(
        df, "spearman", 0.0).collect()])
    assert got == {(p, q): tau(p, q) for p, q in [("a", "b"), ("a", "c"), ("b", "c")]}    # d never changes: no value
    assert correlation.compute_correlation(df.where("a < 0"), "kendall", 0.0).count() == 0

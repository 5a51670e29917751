import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scrubspark.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    import pandas as pd

    d = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    rows = queries.QUERIES["op5_language_id"](spark, SF).collect()
    assert len(rows) == len(d) and {r.lang_pred for r in rows} <= {*d["lang"].unique(), "und"}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == d["lang"][r.doc_id] for r in held)
    assert len(held) > 100 and right / len(held) > 0.97


def test_scores_equal_a_plain_bayes(monkeypatch):
    texts = ["abc abd", "xyz", "ab" * 40, "Ünïcode"]
    rng = np.random.default_rng(1)
    logp = np.hstack([rng.normal(size=(3, langid.BUCKETS)), np.zeros((3, 1))]).astype(np.float32)
    m = langid.Model(["a", "b", "c"], logp, np.log([0.5, 0.3, 0.2]))
    whole = m.score(texts)
    monkeypatch.setattr(langid, "PIECE", 7)   # texts in pieces give the same sums
    parts = m.score(texts)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_language_of_odd_rows(spark, odd, odd_rows, nothing):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "de", "fr"}
    assert langid.identify(nothing).count() == 0
    kept = langid.drop_unidentified(odd)
    assert kept.columns == odd.columns
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in
               (dict(zip(odd.columns, x)) for x in map(tuple, kept.collect())))


def test_nothing_learned_is_undetermined(spark):
    d = spark.createDataFrame([(1, "text here", None)], "doc_id long, text string, lang string")
    assert tuple(langid.identify(d).select("lang_pred", "score").first()) == ("und", 0.0)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_rules_against_brute_force(spark, odd, odd_rows):
    got = sorted((tuple(r)[:7] for r in quality.quality(odd).collect()), key=str)
    want = []
    for i, t, *_ in odd_rows:
        s = brute_statistics(t)
        want.append((i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(want, key=str)


def test_query_against_brute_force(spark):
    import pandas as pd

    d = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")["quality"]
    rows = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op6_quality_outliers"](spark, SF).collect()}
    assert len(rows) == len(d)
    for i, t in zip(d["doc_id"], d["text"]):
        s = brute_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert rows[i][:6] == (*s, failed)
        assert not (failed and rows[i][6])
        if not failed and s[2] > s[0]:
            assert not rows[i][6]          # more symbols than words
        if not failed and labels.get(i) == 1:
            assert rows[i][6]              # clean documents stay


def numpy_mcd(x, steps=quality.C_STEPS, share=quality.SHARE):
    floors = np.array([quality.FLOORS[a] for a in quality.X])
    m = np.array([np.sort(c)[int(np.ceil(0.5 * len(c))) - 1] for c in x.T])
    off = np.abs(x - m)
    s = np.maximum(1.4826 * np.array([np.sort(c)[int(np.ceil(0.5 * len(c))) - 1] for c in off.T]), floors)
    cov = np.diag(s**2)
    for _ in range(steps):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
        d = (y**2).sum(0)
        near = x[d <= np.sort(d)[int(np.ceil(share * len(d))) - 1]]
        m = near.mean(0)
        cov = (near.T @ near / len(near) - np.outer(m, m)) * quality._consistency(share)
        cov[np.diag_indices(4)] = np.maximum(cov.diagonal(), 0) + floors**2
    y = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
    return (y**2).sum(0)


def test_distances_equal_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 4)) * [0.3, 0.5, 0.2, 0.4] + [1, 2, 3, 4]
    x[:, 1] += x[:, 0]
    x[:60] += 5
    points = spark.createDataFrame([("g", *map(float, row)) for row in x], "key string, x1 double, x2 double, x3 double, x4 double")
    model = quality.fit(points)
    got = {tuple(round(v, 9) for v in r_[:4]): r_[4] for r_ in map(tuple, quality._distance(
        points.join(model, "key")).select(*quality.X, "d2").collect())}
    want = numpy_mcd(x)
    for row, d in zip(x, want):
        assert got[tuple(round(float(v), 9) for v in row)] == pytest.approx(d, rel=1e-6)
    assert (want[:60] > quality.CUTOFF).all() and (want[60:] > quality.CUTOFF).mean() < 0.02


def test_quality_of_nothing(spark, nothing):
    assert quality.quality(nothing).count() == 0

"""The pipeline's language stage learns its counts and floors from all labelled documents, not from a sample."""

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from scrubspark.llm import langid


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_model_and_floors_come_from_all_documents(spark, monkeypatch):
    r = random.Random(5)
    letters = {"aa": "abcdefg ", "bb": "efghijk ", "cc": "klmnop "}
    langs = 27_000 * ["aa"] + 9_000 * ["bb"] + 300 * ["cc"]   # cc: too few held out for a floor of its own
    rows = [(i, "".join(r.choices(letters[k], k=r.randrange(4, 30))) + "x", k) for i, k in enumerate(langs)]
    rows += [(10**6 + i, "one text in many copies", "bb") for i in range(500)] + [(7, None, "aa"), (8, "abc", None)]
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "lang"]),
                              "doc_id long, text string, lang string").repartition(3)
    models, predict = [], langid.predict_column
    monkeypatch.setattr(langid, "predict_column", lambda s, m, t: models.append(m) or predict(s, m, t))
    kept = langid.drop_unidentified(d)
    (m,) = models
    assert m.langs == sorted(letters)

    rows = [x for x in rows if None not in x]
    count = np.full((3, langid.BUCKETS), 0.5)
    for k, lang in enumerate(m.langs):
        texts = [t for i, t, x in rows if x == lang and not held_out(i)]
        for _, parts in langid._pieces(texts):
            for g in langid._grams(parts)[0]:
                count[k] += np.bincount(g, minlength=langid.BUCKETS + 1)[:-1]
    assert np.allclose(m.logp[:, :-1], np.log(count / count.sum(axis=1, keepdims=True)), rtol=1e-6)

    means = {}
    for k, lang in enumerate(m.langs):
        texts = [t for i, t, x in rows if x == lang and held_out(i)]
        total, n = m.totals(texts)
        means[lang] = ((total[:, k] - m.prior[k]) / n).tolist()
    assert len(means["cc"]) < langid.MIN_FLOOR_DOCS
    everything = sum(means.values(), [])
    want = [sorted(v)[math.ceil(langid.FLOOR_SHARE * len(v)) - 1] for v in (means["aa"], means["bb"], everything)]
    assert m.floor == pytest.approx(want, rel=1e-9)
    assert kept.count() > 0


@pytest.mark.parametrize("sketch", [10_000, 20])
def test_quantiles_are_exact(spark, monkeypatch, sketch):
    """Also where ties fill the bracket, and where the sketch is coarse."""
    monkeypatch.setattr(langid, "SKETCH", sketch)
    r = random.Random(6)
    values = {"one": [1.5], "ties": 3_000 * [-2.0] + 20 * [-3.0], "many": [r.gauss(0, 1) for _ in range(30_000)],
              "same": 500 * [0.25]}
    d = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "lang string, mean double").repartition(5)
    for p in (0.01, 0.5):
        got = langid._quantiles(d, p)
        for k, v in [*values.items(), (None, sum(values.values(), []))]:
            assert got[k] == (len(v), sorted(v)[math.ceil(p * len(v)) - 1])
    assert langid._quantiles(d.where("false"), 0.01) == {}


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    asked, sketched = [], langid.F.percentile_approx

    def off(column, at, accuracy):
        asked.append(at)
        return langid.F.array(langid.F.lit(7.0), langid.F.lit(8.0)) if len(asked) == 1 else sketched(column, at, accuracy)

    d = spark.createDataFrame([("a", float(i)) for i in range(1_000)], "lang string, mean double")
    monkeypatch.setattr(langid.F, "percentile_approx", off)
    assert langid._quantiles(d, 0.01) == {"a": (1_000, 9.0), None: (1_000, 9.0)} and len(asked) == 2

"""Each stage of the pipeline against a brute-force version over the same input."""

import pandas as pd
import pytest

import corpus_pipeline
from scrubspark.llm import decontam, langid, queries
from scrubspark.session import materialize
from tests_llm_brute import brute_components, brute_fingerprint, brute_infix, brute_shards

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs.toPandas(), after.toPandas())
        docs = after
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert list(after.columns) == list(before.columns) + (["shard"] if name == "sharding" else [])
        assert after["doc_id"].is_unique
        same = before.set_index("doc_id").loc[after["doc_id"]].reset_index()
        pd.testing.assert_frame_equal(same, after[before.columns].reset_index(drop=True))


def test_language_stage(stages):
    before, after = stages["language_id"]
    gone = before[~before["doc_id"].isin(after["doc_id"])]
    assert all(langid.has_letter(t) for t in after["text"])
    assert len(gone) <= 0.02 * len(before)   # clean documents stay


def test_near_duplicate_stage(stages):
    before, after = stages["simhash_dedup"]
    ids = before["doc_id"].tolist()
    assert sorted(after["doc_id"]) == sorted(set(brute_components(ids, [brute_fingerprint(t) for t in before["text"]])))


def test_decontamination_stage(stages, small):
    before, after = stages["decontamination"]
    items = [decontam.words(t) for t in small("benchmark")["text"]]
    clean = []
    for i, t in zip(before["doc_id"], before["text"]):
        w = decontam.words(t)
        if not any(set(zip(x, x[1:])) & set(zip(w, w[1:])) and
                   brute_infix(x, w) <= decontam.edit_bound(len(x)) for x in items):
            clean.append(i)
    assert sorted(after["doc_id"]) == sorted(clean) and len(clean) < len(before)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    n = {i: len(t.split()) for i, t in zip(before["doc_id"], before["text"])}
    chosen, total = sum(n[i] for i in after["doc_id"]), sum(n.values())
    assert 0.7 * total <= chosen <= queries.MIX_BUDGET_PERCENT / 100 * total


def test_sharding_stage(stages):
    before, after = stages["sharding"]
    rows = [(i, len(t.encode())) for i, t in zip(before["doc_id"], before["text"])]
    want = brute_shards(rows, queries.SHARD_BYTES)
    assert dict(zip(after["doc_id"], after["shard"])) == {rows[k][0]: v for k, v in want.items()}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = stages["sharding"][1].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_stages_take_odd_rows(spark, odd, nothing):
    for docs in (odd.toDF("doc_id", "EXTRA", "text", "lang", "source", "n"),
                 nothing.selectExpr("*", "0L as n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), f"odd-{name}")
        docs.count()

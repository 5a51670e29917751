"""Documents in no learned language leave the pipeline's language stage; clean ones stay."""

import random

import pandas as pd
import pytest

from scrubspark.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("unlearned", ["fr", "es"])
def test_unlearned_language_and_noise_go(spark, unlearned):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    good = pd.read_parquet(f"{SF}/labels.parquet").query("quality == 1")["doc_id"]
    r = random.Random(3)
    noise = [(10**6 + i, "".join(" " if r.random() < 0.15 else chr(r.randrange(*span)) for _ in range(400)), None)
             for i, span in enumerate(100 * [(33, 127), (0x430, 0x450)])]
    lang = [None if k == unlearned else k for k in d["lang"]]
    rows = [*zip(d["doc_id"].tolist(), d["text"], lang), *noise]
    kept = {x[0] for x in langid.drop_unidentified(spark.createDataFrame(
        rows, "doc_id long, text string, lang string")).select("doc_id").collect()}
    assert not kept & {i for i, *_ in noise}
    foreign = set(d["doc_id"][d["lang"] == unlearned])
    assert len(kept & foreign) <= 0.05 * len(foreign)
    clean = set(good) & set(d["doc_id"][d["lang"] != unlearned])
    assert clean <= kept, len(clean - kept)

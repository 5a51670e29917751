import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

#: every awkward row a table of documents may hold: nulls, empty and very long texts, ties, repeated rows
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]


def sentence(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    long_text = sentence(1, 30_000)
    base = sentence(2, 90)
    return [
        (1, None, "en", "src0"), (2, "", "en", "src0"), (3, " \n\t ", None, "src0"), (4, base, "en", None),
        (5, base, "en", "src1"), (6, base + " tail1", "en", "src1"), (7, long_text, "de", "src1"),
        (8, "été à la plage, ça va? 🙂", "fr", "src2"), (8, "été à la plage, ça va? 🙂", "fr", "src2"),
        (9, "x", "en", "src2"), (9, "other text of the same id", "en", "src2"), (None, "no id here", None, None),
        (None, None, None, None), (10, "1 2 3 4 5 6 7", "en", "src0"), (11, "?!?!", "en", "src0"),
        (12, sentence(3, 60), "en", "src0"), (13, sentence(4, 60), "de", "src2"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The awkward rows, with columns beside whose names clash but for case."""
    d = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    return d.selectExpr("doc_id", "'clash' as TEXT", "text as t", "lang", "source", "0 as Doc_Id").toDF(
        "doc_id", "TEXT", "text", "lang", "source", "Doc_Id")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables as pandas frames."""
    import pandas as pd

    return lambda name: pd.read_parquet(f"/root/testdata/sf0.001/{name}.parquet")


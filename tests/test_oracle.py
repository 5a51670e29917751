"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from scrubspark import suite
from scrubspark.suite import compare
from scrubspark.suite.compare import digest, duck
from scrubspark.suite.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
suite.load_all()


@pytest.fixture(scope="module")
def con():
    compare.STRICT = True   # doubles compared by their exact repr
    yield duck(SF)
    compare.STRICT = False


def test_every_query_has_an_oracle_or_is_listed():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows) == digest(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["c_custkey", "acctbal", "segment", "nation_txt", "segment_gap"]

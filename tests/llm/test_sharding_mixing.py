from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from scrubspark.llm import mixing, queries, sharding
from scrubspark.suite.compare import digest, duck
from tests_llm_brute import brute_shards

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck(SF).execute(queries.ORACLES[name])
    names, rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(names, rows)


def test_splits_only_what_is_too_large(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.choice([0, 1, 50, 900])) for i in range(3000)]
    docs = spark.createDataFrame([(i, "é" * (n // 2) + "x" * (n % 2)) for i, n in rows], "doc_id long, text string")
    for limit in (100, 5000, 10**9):   # 100: some documents alone are larger
        got = {x["doc_id"]: x for x in sharding.assign(docs, limit).collect()}
        want = brute_shards(rows, limit)
        size = defaultdict(int)
        for k, (i, n) in enumerate(rows):
            assert got[i]["n_bytes"] == n
            if not got[i]["shard"].startswith(want[k]) or "-" not in got[i]["shard"]:
                assert got[i]["shard"] == want[k]
            size[got[i]["shard"]] += n
        for x in got.values():
            assert x["shard_bytes"] == size[x["shard"]] and x["fits"] == (size[x["shard"]] <= limit)


def test_equal_hashes_are_dealt_into_parts(spark):
    docs = spark.createDataFrame([(None, "x" * (k % 7)) for k in range(200)] + [(None, "y" * 500), (None, None)],
                                 "doc_id long, text string")
    rows = sharding.assign(docs, 20).collect()
    assert len(rows) == 202
    sizes = defaultdict(int)
    for x in rows:
        sizes[x["shard"]] += x["n_bytes"]
    assert all(x["shard_bytes"] == sizes[x["shard"]] for x in rows)
    assert sorted(n for n in sizes.values() if n > 20) == [500] and len(sizes) < 80


def test_shards_of_odd_rows(spark, odd, odd_rows, nothing):
    rows = sharding.assign(odd, 1000).collect()
    assert sorted(x["n_bytes"] for x in rows) == sorted(len((t or "").encode()) for _, t, *_ in odd_rows)
    out = sharding.shard(odd.withColumnRenamed("lang", "Shard"), 1000)
    assert out.columns[-1] == "shard_2" and out.count() == len(odd_rows)
    assert sharding.assign(nothing, 1000).count() == 0 and sharding.shard(nothing, 1000).count() == 0


def brute_pour(budget, children):
    """Water-filling one round at a time: exact shares, the capacity of those that are full."""
    given, open_ = {}, dict(children)
    while open_:
        left = budget - sum(given.values())
        weight = sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap * weight <= left * w]
        if not full:
            given.update({k: left * w // weight for k, (_, w) in open_.items()})
            break
        for k in full:
            given[k] = open_.pop(k)[0]
    return given


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 5), ("b", "en", "s4", 400),
              ("b", "fr", "s5", 0), ("c", "en", "s6", 7)]
    weights = {"domain": {"a": 6, "b": 3}, "lang": {"en": 1, "de": 2}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for total in (0, 9, 300, 1000, 2000, 10**6):
        got = {(r["domain"], r["lang"], r["source"]): r["given"] for r in mixing.budgets(
            df, F.lit(total), weights, 2).collect()}
        cap = {x[:3]: 2 * x[3] for x in leaves}

        def level(prefix, n):
            out = defaultdict(int)
            for k, c in cap.items():
                if k[:n - 1] == prefix:
                    out[k[:n]] += c
            return out

        def w(n, name):
            return weights.get(mixing.LEVELS[n - 1], {}).get(name, 1)

        want = {}
        nodes = [((), min(total, sum(cap.values())))]
        for n in (1, 2, 3):
            nodes = [x for prefix, budget in nodes for x in brute_pour(
                budget, {k: (c, w(n, k[-1])) for k, c in level(prefix, n).items()}).items()]
        want = dict(nodes)
        assert got == want
        assert sum(got.values()) <= total and sum(got.values()) >= min(total, sum(cap.values())) - 6


def test_mix_of_odd_rows(spark, odd, odd_rows, nothing):
    rows = mixing.mix(odd, queries.domain_of_source(), queries.MIX_WEIGHTS, 80, 2, 1).collect()
    copies = defaultdict(int)
    for x in rows:
        copies[(x["doc_id"], x["n_tokens"])] += 1
    total = sum(len((t or "").split()) for _, t, *_ in odd_rows)
    assert sum(x["n_tokens"] for x in rows) <= 0.8 * total
    assert {x["domain"] for x in rows} <= {"web", "(none)"} and max(x["epoch"] for x in rows) <= 1
    assert mixing.mix(nothing, queries.domain_of_source(), queries.MIX_WEIGHTS).count() == 0


def test_seed_changes_the_selection_only(spark):
    d = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").df()
    docs = spark.createDataFrame(d)
    a, b = ({(r["doc_id"], r["epoch"]) for r in mixing.mix(
        docs, queries.domain_of_source(), queries.MIX_WEIGHTS, 50, 1, seed).collect()} for seed in (1, 2))
    assert a != b and {e for _, e in a | b} == {0}

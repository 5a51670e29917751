import random
from itertools import combinations

import numpy as np

from scrubspark.llm import queries, simhash
from tests_llm_brute import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_query_against_brute_force(spark, small):
    d = small("documents")
    fps = [brute_fingerprint(t) for t in d["text"]]
    want = {(i, f"{f:016x}", c) for i, f, c in zip(d["doc_id"], fps, brute_components(d["doc_id"], fps))}
    got = {tuple(r) for r in queries.QUERIES["op10_simhash_components"](spark, SF).collect()}
    assert got == want and len(got) == len(d)


def test_odd_rows(spark, odd, odd_rows):
    got = sorted(simhash.simhash_components(odd).select("doc_id", "fingerprint", "component_id").collect(), key=str)
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    comp = brute_components([r[0] for r in odd_rows], fps)
    assert got == sorted([(r[0], f"{f:016x}", c) for r, f, c in zip(odd_rows, fps, comp)], key=str)


def test_one_of_each_component_stays(spark, odd, odd_rows):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    roots = brute_components(fps, fps)   # named by the smallest fingerprint: a class of its own
    least = {}
    for r, c in zip(odd_rows, roots):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    ids = [r[0] for r in map(tuple, kept.collect())]
    assert sorted(i for i in ids if i is not None) == sorted(least.values())   # 9 twice: two texts
    assert ids.count(None) == len(set(roots) - set(least))


def test_empty_table(spark, nothing):
    assert simhash.simhash_components(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_walk_finds_every_close_pair():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    values = set(base)
    for b in base:
        for _ in range(6):
            v = b
            for _ in range(r.randrange(1, 5)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    v = np.array(sorted(values), np.uint64)
    for budget in (0, 1, 2, 3):
        want = {(a, b) for a, b in combinations(v.tolist(), 2) if bin(a ^ b).count("1") <= budget}
        got = set()
        for x, y in simhash.walk(v, v, True, 0, budget):
            for a, b in zip(x.tolist(), y.tolist()):
                pair = (min(a, b), max(a, b))
                assert pair not in got
                got.add(pair)
        assert got == want


def test_split_walk_gives_the_same_components(spark):
    r = random.Random(9)
    chain, v = [], r.getrandbits(64)
    for _ in range(300):   # one long chain of neighbours
        chain.append(v)
        v ^= 1 << r.randrange(64)
    values = sorted({*chain, *(r.getrandbits(64) for _ in range(700))})
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(signed, values)
    for cell_rows in (100_000, 64):
        roots = {r[0]: r[1] for r in simhash.connected(simhash.links(fps, 2, cell_rows)).collect()}
        groups = {}
        for s, c in zip(signed, want):
            groups.setdefault(c, set()).add(roots.get(s, s))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_stars_span_what_they_got():
    u, v = simhash.stars(np.array([5, 4, 9, 9], np.uint64), np.array([4, 3, 8, 8], np.uint64))
    assert sorted(zip(u.tolist(), v.tolist())) == [(4, 3), (5, 3), (9, 8)]

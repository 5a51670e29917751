import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from conftest import sentence
from scrubspark.llm import queries, setsketch

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = min(least[find(k)], default=None)
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, small):
    d = small("documents")
    got = of(queries.QUERIES["op11_setsketch_components"](spark, SF))
    assert got == brute(list(zip(d["doc_id"].tolist(), d["text"])))
    assert 0 < sum(not r[3] for r in got)


def near(r, words, edits):
    """The words with some of them replaced."""
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def family(seed=4, n=60):
    """Texts on both sides of the threshold: chains, crowds of near copies, a template that many texts share."""
    r = random.Random(seed)
    rows, bases = [], [sentence(100 + k, 120).split() for k in range(4)]
    for k, base in enumerate(bases):
        rows += [near(r, base, r.randrange(0, 4)) for _ in range(n)]
    chain = sentence(300, 150).split()
    for _ in range(n):
        rows.append(" ".join(chain))
        chain[r.randrange(len(chain))] = f"c{r.randrange(10**6)}"
    template = sentence(400, 80)
    rows += [f"{template} {sentence(1000 + k, 12)}" for k in range(n)]
    ids = r.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def test_links_on_both_sides_of_the_threshold(spark):
    rows = family()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert of(setsketch.near_duplicates(d)) == want
    assert 10 < len({r[2] for r in want}) < len(rows) - 20
    assert of(setsketch.near_duplicates(d, block=7)) == want       # buckets in small cells


def test_hot_classes_over_salts(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "HOT_PAIRS", 3)
    rows = family(seed=8, n=25)
    assert of(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark, odd, odd_rows):
    assert of(setsketch.near_duplicates(odd)) == brute([r[:2] for r in odd_rows])


def test_copies_and_no_rows(spark, nothing):
    text = sentence(5, 40)
    rows = [(7, text), (3, text.upper()), (3, text), (3, text), (9, "  ".join(text.split())), (None, text), (1, "a b c"),
            (2, "A\tb c"), (4, "a b c d"), (None, ""), (None, "only without id"), (5, " ")]
    got = of(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert (7, 36, 3, False) in got and (2, 1, 1, False) in got and (5, 0, 5, True) in got
    assert setsketch.near_duplicates(nothing).count() == 0


def test_sketches_merge():
    r = np.random.default_rng(2)
    a, b = (np.unique(r.integers(0, 2**63, n, np.uint64)) for n in (500, 900))
    both = setsketch.sketches([a, b, np.union1d(a, b)])
    assert (setsketch.merge(both[0], both[1]) == both[2]).all()


@pytest.mark.parametrize("j", [0.5, 0.85, 0.95])
def test_registers_collide_as_often_as_sets_are_similar(j):
    r = np.random.default_rng(3)
    n, equal, kept = 400, [], []
    for _ in range(60):
        x = r.integers(0, 2**63, 2 * n, np.uint64)
        shared = round(2 * n * j / (1 + j))
        a, b = x[:n], np.concatenate((x[:shared], x[n: 2 * n - shared]))
        s = setsketch.sketches([np.sort(a), np.sort(b)])
        equal.append((s[0] == s[1]).mean())
        kept.append(setsketch.may_reach(0.85, np.array([float(n)]), np.array([float(n)]), np.array([(s[0] > s[1]).sum()]),
                                        np.array([(s[0] < s[1]).sum()]))[0])
    assert abs(np.mean(equal) - j) < 0.02
    assert all(kept) if j >= 0.85 else not any(kept)

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from scrubspark.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute_runs(words, shortest=6, exponent=4):
    """Every maximal stretch of each period, by walking it."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(shortest, exponent * q):
                best.setdefault((start, end), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_query_row(doc_id, text):
    words = split(text)
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    found = brute_runs(words)
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *first, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(brute_collapsed(words, found).encode()).hexdigest())


def test_query_against_brute_force(spark, small):
    d = small("documents")
    got = spark_rows(queries.QUERIES["op13_periodic_runs"](spark, SF))
    assert got == sorted(brute_query_row(int(i), t) for i, t in zip(d["doc_id"], d["text"]))
    assert sum(r[1] for r in got) > 5


def spark_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_random_texts():
    r = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(r.randrange(1, 5)):
            k, want, t = r.choice([1, 2, 3, 5, 30]), r.choice([0, 5, 20, 80, 200]), []
            while len(t) < want:
                if r.random() < 0.4:
                    period = [r.randrange(k) for _ in range(r.randrange(1, 12))]
                    t += (period * r.randrange(1, 9))[: r.randrange(1, 100)]
                else:
                    t += [r.randrange(k) for _ in range(r.randrange(1, 8))]
            texts.append(t)
        bounds = np.cumsum([0, *map(len, texts)])
        flat = np.array([w for t in texts for w in t], np.int64)
        got = sorted(zip(*(x.tolist() for x in runs.find_runs(flat, bounds))))
        assert got == sorted((s + b, s + b + n, q) for t, b in zip(texts, bounds.tolist()) for s, n, q in brute_runs(t))


def test_equal_texts_side_by_side_are_apart():
    flat = np.array([1, 2, 1, 2, 1, 2, 1, 2] * 2)
    assert [x.tolist() for x in runs.find_runs(flat, np.array([0, 8, 16]))] == [[0, 8], [8, 16], [2, 2]]
    assert [x.tolist() for x in runs.find_runs(np.array([7] * 10), np.array([0, 5, 10]))] == [[], [], []]


def test_grammar_derives_the_text_and_stays_small():
    words = np.array([3, 1, 4, 1, 5, 9, 2, 6] * 500)
    same = np.ones(len(words), bool)
    same[-1] = False
    g, roots, places = runs.repair(words, same)
    assert roots.tolist() == [g.size - 1] and places.tolist() == [0] and g.length[-1] == len(words)

    def derive(x):
        return [x] if g.left[x] < 0 else derive(g.left[x]) + derive(g.right[x])

    assert derive(roots[0]) == words.tolist()
    assert g.size < 100


def test_time_is_in_proportion():
    for words in ([0] * 200_000, [0, 1] * 100_000, list(range(5000)) * 40):
        began = time.perf_counter()
        found = runs.find_runs(np.array(words), np.array([0, len(words)]))
        assert len(found[0]) == 1 and time.perf_counter() - began < 20


def test_odd_rows(spark, odd, odd_rows):
    got = sorted(((r[0], [tuple(x) for x in r[1]], r[2]) for r in runs.periodic_runs(odd).collect()), key=str)
    want = []
    for i, t, *_ in odd_rows:
        words = split(t)
        found = brute_runs(words) if len(words) < 1000 else []
        want.append((i, found, brute_collapsed(words, found)))
    assert got == sorted(want, key=str)


def test_runs_that_overlap_and_ties(spark, nothing):
    text = "a b a b a b a b a b a a a a a a a x\ty y\ny y  y y y"
    d = spark.createDataFrame([(1, text), (1, text), (2, "q " * 7)], "doc_id long, text string")
    words = split(text)
    rows = runs.periodic_runs(d).orderBy("doc_id").collect()
    assert [tuple(x) for x in rows[0].runs] == brute_runs(words) == [(0, 11, 2), (10, 7, 1), (18, 7, 1)]
    assert rows[0] == rows[1] and rows[0].collapsed == "a b x y"      # the second run's first word goes with the first run
    assert rows[2].collapsed == "q"
    assert runs.periodic_runs(nothing).count() == 0
    best = runs.periodic_runs(d).select(runs.strongest("runs").alias("b")).collect()
    assert tuple(best[0].b) == (10, 7, 1)
    with pytest.raises(ValueError):
        runs.find_runs(np.array([1, 2]), np.array([0, 2]), 6, 3)

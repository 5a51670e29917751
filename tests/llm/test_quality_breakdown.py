"""Junk that makes up a large part of a group, and statistics that alone give a text away."""

import random

import pytest

from scrubspark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(seed, junk=False):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(60, 160))]
    return " ".join(w + 3 * r.choice("#*$%&") for w in words) if junk else " ".join(words)


def kept(spark, texts):
    rows = [(i, t, "en", "src0") for i, t in enumerate(texts)]
    return {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("share", [0.28, 0.4])
def test_junk_of_over_a_quarter_is_rejected(spark, share):
    n = int(500 * share)
    got = kept(spark, [prose(i, junk=i < n) for i in range(500)])
    assert not any(got[i] for i in range(n))
    assert sum(got[i] for i in range(n, 500)) >= 0.98 * (500 - n)


def test_copies_of_junk_count_once(spark):
    texts = [prose(i) for i in range(200)] + [prose(1000 + i, junk=True) for i in range(30)] + [prose(7, junk=True)] * 250
    got = kept(spark, texts)
    assert not any(got[i] for i in range(200, 480))
    assert sum(got[i] for i in range(200)) >= 196


def repeated(seed, n_words, n_passage):
    """A text of ``n_words`` words in which a passage of ``n_passage`` words stands twice."""
    w = " ".join(prose(100 * seed + i) for i in range(n_words // 60 + 1)).split()[:n_words]
    passage, rest = w[:n_passage], w[n_passage: n_words - n_passage]
    half = len(rest) // 2
    return " ".join(passage + rest[:half] + passage + rest[half:])


def in_lines(seed, n_same):
    """Lines of prose, and between them a line of two words, ``n_same`` times."""
    w = prose(seed).split()
    return "\n".join(f"same line\n{w[3 * i]} {w[3 * i + 1]} {w[3 * i + 2]}" for i in range(n_same)) + "\n" + " ".join(w[3 * n_same:])


def test_one_statistic_alone_rejects(spark):
    clean = [prose(i) for i in range(300)]
    words = [repeated(5000, 200, 49), repeated(5001, 100, 24), repeated(5002, 60, 14), repeated(5003, 1000, 245)]
    lines = [in_lines(6000, 12), in_lines(6001, 16)]
    symbols = [prose(7000) + " # * $ % & |" * 4]
    single = [prose(8000) + "\nsame line\n" + prose(8001) + "\nsame line", repeated(8002, 200, 8)]
    got = kept(spark, clean + words + lines + symbols + single)
    out = [got[i] for i in range(300, 300 + len(words + lines + symbols))]
    assert not any(out), out
    assert all(got[i] for i in range(307, 309))   # one repeated line or short passage is no outlier
    assert sum(got[i] for i in range(300)) >= 294

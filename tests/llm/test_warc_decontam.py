import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from scrubspark.llm import decontam, queries, warc
from scrubspark.session import scratch_path
from tests_llm_brute import brute_infix

SF = "/root/testdata/sf0.001"


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [(1, "http://www.A.example/x#f", "<p>same</p>"), (2, "https://a.example/x", "<p>same</p>"),
         (3, None, None), (4, "http://b.example", ""), (5, "a.example/é?q=1", "WARC/1.1\r\nWARC-Type: x\r\n\r\n<p>é🙂"),
         (6, "http://c.example/\r\nX-Page-ID: 9", "\n\r\n"), (7, "u", "z" * 300_000), (None, "u", "<p>same</p>"),
         (None, "u", "only"), (7, "u", "z" * 300_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, e string").toDF(
        "page_id", "url", "html", "URL")


def test_round_trip(spark):
    rows = warc.capture_histories(frame(spark, PAGES)).collect()
    assert len(rows) == len(PAGES)
    best = {}
    for i, _, html in PAGES:
        best[sha(html)] = max(best.get(sha(html), -1), -1 if i is None else i)
    seen = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    want = []
    for i, _, html in PAGES:
        top = best[sha(html)]
        response = top == -1 or i == top
        want.append((i, len((html or "").encode()), sha(html), "response" if response else "revisit", None if response else top))
    assert seen == sorted(want, key=str)
    in_order = sorted(rows, key=lambda r: r["history_pos"])
    assert [r["history_pos"] for r in in_order] == list(range(len(rows)))
    keys = [(r["url_key"], r["captured"], r["page_id"] or -1) for r in in_order]
    assert keys == sorted(keys)


def test_min_bytes(spark):
    rows = warc.capture_histories(frame(spark, [(1, "u", ""), (2, "u", ""), (3, "u", "abc"), (4, "u", "abc")]), min_bytes=1).collect()
    assert {r["page_id"]: r["record_type"] for r in rows} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_large_page_ids_keep_their_order(spark):
    ids = [2**62, 2**40, 2**31 + 5, 86_399, 86_400, 0, -1, -2**62]
    rows = warc.capture_histories(frame(spark, [(i, "u", f"p{i}") for i in ids])).orderBy("history_pos").collect()
    assert [r["page_id"] for r in rows] == sorted(ids)
    assert {r["page_id"]: r["captured"] for r in rows}[86_400] == "2024-01-02T00:00:00Z"


def test_no_pages(spark):
    assert warc.capture_histories(frame(spark, [])).count() == 0


def test_archives_are_well_formed(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(frame(spark, PAGES), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    data = b"".join(gzip.decompress(f[0]) for f in files)
    assert data.count(b"WARC-Record-ID: <urn:uuid:") == len(PAGES)
    broken = gzip.compress(data.replace(b"z" * 300_000, b"z" * 299_999 + b"y"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(broken, "broken"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(gzip.compress(data[:-3]), "cut"))


def test_loser_tree_merges():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((r.choice([None, r.randrange(5)]), "", r.choice("ab"), r.choice("cd")) for _ in range(r.randrange(12))),
                       key=warc._order) for _ in range(k)]
        got = list(warc.merge(runs))
        assert [warc._order(e) for e in got] == sorted(warc._order(e) for x in runs for e in x)


def test_ranges_give_one_order(spark):
    rows = [(i, f"http://h{i % 3}.example/{i % 7}", f"p{i % 40}") for i in range(500)]
    path = scratch_path(spark, "warc-test")
    warc.write_archives(frame(spark, rows).repartition(5), path)
    runs = warc.runs(spark, path)
    one, many = (warc.histories(runs, n).select("page_id", "history_pos", "url_key").collect() for n in (10**6, 40))
    assert sorted(one) == sorted(many)
    assert [r["page_id"] for r in sorted(one, key=lambda r: r["history_pos"])] == [
        i for _, i in sorted((warc.url_key(u), i) for i, u, _ in rows)]


def test_infix_distance():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 4, (50, 8)), r.integers(0, 4, (50, 14))
    got, _ = decontam.infix_distance(a, b)
    assert got.tolist() == [brute_infix(list(x), list(y)) for x, y in zip(a, b)]


def test_query_against_brute_force(spark, small):
    docs, items = small("documents"), small("benchmark")
    want = set()
    for i, t in zip(docs["doc_id"], docs["text"]):
        w = decontam.words(t)
        for j, u in zip(items["item_id"], items["text"]):
            x = decontam.words(u)
            if set(zip(x, x[1:])) & set(zip(w, w[1:])):   # within a fifth of edits some pair of words stays
                d = brute_infix(x, w)
                if d <= decontam.edit_bound(len(x)):
                    want.add((i, j, d))
    rows = queries.QUERIES["op2_benchmark_leaks"](spark, SF).collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    got = {tuple(r)[:3] for r in rows}
    assert got == want and want


def planted(edits, seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(12, 50)))) for i in range(60)]
    docs, want = [], []
    for k in range(n):
        i, t = r.choice(items)
        x = t.split()
        for _ in range(int(edits * len(x))):
            kind, at = r.randrange(3), r.randrange(len(x))
            x[at:at + (kind != 1)] = [] if kind == 0 else ["new" + str(r.randrange(99))]
        filler = [r.choice(vocab) + "x" for _ in range(120)]
        at = r.randrange(120)
        docs.append((k, " ".join(filler[:at] + x + filler[at:])))
        want.append((k, i))
    return items, docs, want


@pytest.mark.parametrize("edits, least", [(0, 1.0), (0.1, 0.99), (0.2, 0.97)])
def test_recall_of_planted_passages(edits, least):
    items, docs, want = planted(edits, 3)
    index = decontam.Index(items, 0.8, 0.99, 11)
    found = index.search([t for _, t in docs])
    assert sum(any(y[0] == i for y in f) for f, (_, i) in zip(found, want)) >= least * len(want)
    assert not any(index.search([" ".join(["alpha", "beta", "gamma"] * 50), "", None]))


@pytest.mark.parametrize("m, n_items", [(22, 1), (33, 2), (43, 3), (58, 40), (400, 20)])
def test_tables_reach_the_target_recall(m, n_items):
    """Fresh edits at the bound, in the tables chosen: also for one item alone, and for long items."""
    r = np.random.default_rng(m)
    x, k = r.integers(1, 400, (n_items, m)).astype(np.int32), decontam.edit_bound(m)
    t = decontam.Tables(m, decontam.tables_needed(x, k, 400, 0.99, 11), 11)
    base, edited = [], []
    for row in np.resize(x, (400, m)):
        y = row.tolist()
        for _ in range(k):
            kind, at = r.integers(3), int(r.integers(len(y)))
            y[at:at + (kind != 1)] = [] if kind == 0 else [int(r.integers(400))]
        base.append(row)
        edited.append((y + [0] * m)[:m])
    b, e = np.array(base, np.int32), np.array(edited, np.int32)
    assert np.any([u == v for u, v in zip(t.keys(b), t.keys(e))], axis=0).mean() >= 0.975


def test_a_recall_out_of_reach_raises(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_TABLES", 24)
    x = np.random.default_rng(1).integers(1, 400, (3, 200)).astype(np.int32)
    with pytest.raises(ValueError):
        decontam.tables_needed(x, 100, 400, 0.99, 11)


def test_leaks_of_odd_rows(spark, odd, odd_rows, nothing):
    items = spark.createDataFrame([(1, odd_rows[3][1]), (None, odd_rows[7][1]), (2, None), (3, "x"), (4, ""), (1, odd_rows[15][1])],
                                  "item_id long, text string")
    for block_bytes in (1 << 20, 100):   # one block, and several
        got = sorted((tuple(r)[:2] for r in decontam.contamination(odd, items, block_bytes=block_bytes).collect()), key=str)
        assert got == sorted([(4, 1), (5, 1), (6, 1), (8, None), (8, None), (12, 1)], key=str)
        kept = decontam.drop_contaminated(odd, items, block_bytes=block_bytes)
        assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 6
    assert decontam.contamination(nothing, items).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(odd, empty).count() == 0 and decontam.drop_contaminated(odd, empty).count() == len(odd_rows)


def test_long_texts_are_cut_without_loss(monkeypatch):
    items, docs, want = planted(0, 5, 20)
    index = decontam.Index(items, 0.8, 0.99, 11)
    whole = index.search([t for _, t in docs])
    monkeypatch.setattr(decontam, "CHUNK", 40)
    assert index.search([t for _, t in docs]) == whole


def test_runs_never_lose_a_window():
    items, docs, want = planted(0.2, 8, 40)
    index = decontam.Index(items, 0.8, 0.99, 11)
    for (_, t), (_, i) in zip(docs, want):
        kept = [[] for _ in index.classes]
        ids = [index.vocabulary.get(w, 0) for w in decontam.words(t)]
        index._windows([(0, 0, ids)], kept)
        for (m, k, of, x, *_), parts in zip(index.classes, kept):
            at = set(np.concatenate([p[1] for p in parts]).tolist()) if parts else set()
            padded = ids + [0] * index.pad
            for s in range(len(padded) - m + 1):
                w = padded[s: s + m]
                for row in x:
                    if edit(list(row), w) <= k:
                        assert s in at


def edit(a, b):
    if abs(len(a) - len(b)) > len(a):
        return len(a)
    d = list(range(len(b) + 1))
    if len(set(a) & set(b)) < 0.6 * len(set(a)):
        return len(a)
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(prev + (x != y), d[j] + 1, d[j - 1] + 1)
    return d[-1]



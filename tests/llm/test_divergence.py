import re
from collections import Counter, defaultdict

from scrubspark.llm import divergence, queries
from scrubspark.suite.compare import duck

SF = "/root/testdata/sf0.001"


def brute(rows, min_docs=3, top=200):
    """Every rank, in plain Python. ``rows``: (lang, source, text)."""
    rows = [(a or "", b or "", t or "") for a, b, t in rows]
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    for lang, source, text in rows:
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
                 for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in docs.keys() | {x for x, _ in counts}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        of = {s: {t: n for t, n in c.items() if t in kept} for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in of.values():
            whole.update(c)

        def share(c, t):
            return 1 + 10**9 * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept))

        shares = {s: {t: share(c, t) for t in kept} for s, c in of.items()}
        q = {t: share(whole, t) for t in kept}
        for s, c in of.items():
            pairs = [(sum((shares[s][t] - shares[o][t])**2 // shares[o][t] for t in kept), o) for o in of if o != s]
            terms = [((shares[s][t] - q[t])**2 // q[t], t) for t in kept if c.get(t, 0) > 0 and shares[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def test_query_against_brute_force_and_sql(spark, small):
    d = small("documents")
    got = sorted(tuple(r) for r in queries.QUERIES["op12_source_divergence"](spark, SF).collect())
    assert got == brute(d[["lang", "source", "text"]].itertuples(index=False))
    con = duck(SF).execute(queries.ORACLES["op12_source_divergence"])
    assert [x[0] for x in con.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(con.fetchall()) == got


def test_cells_of_small_blocks_give_the_same(spark, small):
    d = spark.createDataFrame(small("documents")[["lang", "source", "text"]])
    shares, groups = divergence.audit_tables(d)
    want = {tuple(r) for r in divergence.pair_divergences(shares, groups).collect()}
    got = {tuple(r) for r in divergence.pair_divergences(shares, groups, group_block=3, term_block=50).collect()}
    assert got == want and len(got) > 100


def test_odd_rows(spark, odd, odd_rows):
    got = sorted(tuple(r) for r in divergence.divergence_audit(odd).collect())
    assert got == brute([(r[2], r[3], r[1]) for r in odd_rows])
    assert ("", "", "pair", "src0", 0, 1) in got        # a language without kept terms: pairs of value 0


def test_groups_without_terms_and_ties(spark, nothing):
    rows = [("en", "a", "One two, one TWO!"), ("en", "b", "one two"), ("en", "c", "ONE two été"), ("en", "d", "77 -- 8"),
            ("en", None, None), (None, "a", "zwei")] * 2
    d = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(tuple(r) for r in divergence.divergence_audit(d).collect())
    assert got == brute(rows)
    assert {r[1] for r in got if r[2] == "pair" and r[0] == "en"} == {"", "a", "b", "c", "d"}
    assert divergence.divergence_audit(nothing).count() == 0


def test_counts_passed_on_early_add_up(spark, small, monkeypatch):
    d = spark.createDataFrame(small("documents")[["lang", "source", "text"]])
    want = {tuple(r) for r in divergence.term_counts(d.na.fill("")).collect()}
    monkeypatch.setattr(divergence, "TERMS_HELD", 10)
    assert {tuple(r) for r in divergence.term_counts(d.na.fill("")).collect()} == want

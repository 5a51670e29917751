import hashlib
import math
import random
import re
import tempfile
import time
from collections import defaultdict

import pytest

from scrubspark.llm import pii, queries

SF = "/root/testdata/sf0.001"
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    t = text or ""
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(t) if valid(k, m[0])]


def brute_terms(docs):
    """Terms flagged by the definition, over whole documents: {row number: [(start, end, action)]}."""
    holds, with_term, words = defaultdict(set), defaultdict(set), []
    n, term = len(docs), re.compile(r"[^\W\d_]{3,}")
    for row, (i, t) in enumerate(docs):
        blank = BASE["email"].sub(lambda m: " " * len(m[0]), t or "")
        words.append([(m[0].lower(), m.start(), m.end()) for m in term.finditer(blank)])
        for w, *_ in words[-1]:
            with_term[w].add(row)
        for k, s, e in brute_spans(t):
            v = (t or "")[s:e]
            holds[f"{k}:" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v))].add((i, t))
    keys = [(i, t) for i, t in docs]
    actions = {}
    for w, at in with_term.items():
        own = {keys[r] for r in at}
        for e, where in holds.items():
            n_et, n_e = len(own & where), len(where)
            if n_et < pii.MIN_SUPPORT or n_e >= n or n_et * math.log(n / n_e) < pii.EVIDENCE:
                continue
            reveals = math.log(n_et * n / (n_e * max(len(at), n_et))) / math.log(n / n_e)
            if reveals >= pii.GENERALISE_AT - 1e-12:
                action = "remove" if reveals >= pii.REMOVE_AT else "generalise"
                actions[w] = max(action, actions.get(w, ""))
    return {row: [(a, b, actions[w]) for w, a, b in ws if w in actions] for row, ws in enumerate(words)}


def brute_sanitised(text, terms):
    marks = sorted([(a, b, f"[{k.upper()}]") for k, a, b in brute_spans(text)]
                   + [(a, b, "" if act == "remove" else "[TERM]") for a, b, act in terms])
    out, at = "", 0
    for a, b, by in marks:
        if b > at:
            out, at = out + text[at:max(a, at)] + by, b
    return out + (text or "")[at:]


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, docs):
    flagged = brute_terms(docs)
    want = []
    for row, (i, t) in enumerate(docs):
        base = brute_spans(t)
        n = [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        terms = [("term", a, b) for a, b, _ in flagged[row]]
        want.append((i, *n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + terms),
                     ",".join(x[2] for x in flagged[row]),
                     hashlib.sha256(brute_sanitised(t, flagged[row]).encode()).hexdigest()))
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_query_against_brute_force(spark):
    import pandas as pd

    d = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in queries.QUERIES["op1_pii_disclosure"](spark, SF).collect()]
    assert sum(sum(r[1:5]) for r in rows) > 5
    check(rows, list(zip(d["doc_id"].tolist(), d["text"])))


TRICKY = [
    "a@b.c", "x@y", "a@b.com-x%y@z.org", "a@b.c@d.e.f", "..@a.b", "é.m@x.com", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1",
    "0255.000.1.1 00000256.1.1.1", "4111 1111 1111 1111", "4111-1111 11111111x", "4111  1111", "4111111111111112",
    "+1 (555) 123-4567 +49.30.1234567", "+1234567", "+1 2", "++1 555 555 5555+", "9" * 50_000, "1 " * 20_000,
    "a" * 30_000, "a.b" * 10_000 + "@", "x@" + "a." * 10_000 + "b", "+" + "1 " * 20_000, "1." * 20_000,
    "a@b.c\na@b.c 🙂 a@b.c", "", None, "@", "+", "1", "😀10.0.0.1😀", "mail:A.B@C.D,e@f.g;", "４111111111111111",
]


def test_tricky_texts(spark):
    docs = list(enumerate(TRICKY))
    a = pii.analyse(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r[0]: (r[1] or "") for r in a.select("doc_id", pii.span_text()).collect()}
    assert got == {i: spelled(brute_spans(t)) for i, t in docs}


def test_random_texts(spark):
    r = random.Random(7)
    docs = [(i, "".join(r.choice("a@.1+ -(2\n9é") for _ in range(r.randrange(60)))) for i in range(2000)]
    a = pii.analyse(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {x[0]: x[1] for x in a.select("doc_id", pii.span_text()).collect()}
    assert got == {i: spelled(brute_spans(t)) for i, t in docs}


def revealing():
    rows = [(i, f"common words here stand about {i} zebra quokka someone@mail.example wombat numbat common words") for i in range(3)]
    rows += [(i, "common words here stand about numbat nothing else") for i in range(10, 13)]
    rows += [(i, "common words here stand about") for i in range(20, 60)]
    return rows + [(2, rows[2][1]), (None, "zebra alone"), (None, None)]


def test_terms_that_give_an_entity_away(spark):
    docs = revealing()
    rows = queries_of(spark, docs)
    check(rows, docs)
    by_id = {r[0]: r[6] for r in rows}
    assert "term" in by_id[0] and "term" not in by_id[20]
    alone = next(r for r in rows if r[0] is None and r[6])      # the term without its entity goes, too
    assert alone[5] == hashlib.sha256(b"").hexdigest() and alone[7] in ("remove", "generalise")


def queries_of(spark, docs):
    return query_rows(spark, spark.createDataFrame(docs, "doc_id long, text string"))


def query_rows(spark, df):
    folder = tempfile.mkdtemp(prefix="scrubspark-test-pii-")
    df.write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in queries.QUERIES["op1_pii_disclosure"](spark, folder).collect()]


def test_random_corpora(spark):
    r = random.Random(13)
    people = [f"p{k}@mail{k % 3}.example" for k in range(6)] + ["10.0.0.7", "+1 555 010 9999"]
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(60)]
    docs = []
    for i in range(150):
        who = r.randrange(len(people) * 3)
        words = [r.choice(vocabulary) for _ in range(r.randrange(3, 30))]
        if who < len(people):
            words += [people[who], f"secret{'xyz'[who % 3]}", f"Team{'kl'[who % 2]}", people[who]]
        elif r.random() < 0.1:
            words.append("secretx")
        r.shuffle(words)
        docs.append((i, " ".join(words)))
    docs += [docs[3], docs[3]]
    rows = queries_of(spark, docs)
    check(rows, docs)
    assert sum(bool(x[7]) for x in rows) > 5


def test_very_many_entities_in_one_text(spark):
    """Copies of an address list, 20,000 entities long: time grows about as the list does, and entities of the same documents are one."""
    took = []
    for n in (1_000, 10_000):
        dump = "\n".join(f"Name{k % 700} user{k}@host{k % 50}.example phone +1 555 {k:07d}" for k in range(n))
        docs = [(1, dump), (2, dump + " end"), *[(i, f"plain words number {i}") for i in range(3, 60)]]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        began = time.perf_counter()
        rows = {r[0]: r for r in query_rows(spark, df)}
        took.append(time.perf_counter() - began)
        assert rows[1][1] == n and rows[1][4] == n and rows[3][6] == ""
        assert rows[1][8] == hashlib.sha256(brute_sanitised(dump, brute_terms(docs)[0]).encode()).hexdigest()
    assert took[1] < 10 * took[0] and took[1] < 90, took


def test_sanitised_text(spark):
    docs = revealing()
    out = {r[0]: r[1] for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "someone" not in out[0] and "[EMAIL]" in out[0] and "quokka" not in out[0] and "common words" in out[0]
    assert "numbat" in out[0] and out[20] == docs[6][1]      # with as many documents without the entity: kept
    assert len(out) == len({i for i, _ in docs})


def test_odd_rows(spark, odd, odd_rows, nothing):
    docs = [r[:2] for r in odd_rows]
    check(query_rows(spark, odd.toDF("doc_id", "TEXT2", "text", "lang", "source", "Doc_Id2")), docs)
    assert sorted([r.doc_id for r in pii.analyse(odd).collect()], key=str) == sorted([r[0] for r in odd_rows], key=str)
    assert pii.sanitise(odd).count() == len(odd_rows)
    assert pii.analyse(nothing).count() == 0 and pii.sanitise(nothing).count() == 0


@pytest.mark.parametrize("kind", pii.KINDS)
def test_guards_let_every_match_through(kind):
    r = random.Random(11)
    for _ in range(3000):
        t = "".join(r.choice("a@.1+ -(2") for _ in range(40))
        if BASE[kind].search(t):
            assert re.search(pii.GUARDS[kind], t) or not any(valid(kind, m[0]) for m in BASE[kind].finditer(t))

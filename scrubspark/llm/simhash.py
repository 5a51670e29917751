"""SimHash near-duplicates: a binary-trie self-join of the fingerprints.

Fingerprints are distinct 64-bit values, each a path in a binary trie. The self-join walks pairs of
trie nodes together from the root, adds up the bits in which the two paths differ, and leaves a
pair of subtrees as soon as the sum exceeds the budget. The top ``p`` levels of the walk are done
by Spark: each fingerprint goes to every pair of level-``p`` subtrees that the walk would reach, and
each such pair of subtrees is walked by one task, over sorted arrays (a node is a range of them).
``p`` follows the number of fingerprints, and grows further while any subtree is too large.

A task returns a spanning forest of the links it found, not the links: same components, and never
more rows than fingerprints, however many copies lie close together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import ID_KEY, TEXT_KEY, pick, row_keys, semi_filter
from scrubspark.session import materialize

ROOT = "__root"
BITS = 64
CELL_ROWS = 20_000       # fingerprints per subtree that the walk's first split aims at
CELL_MAX = 500_000       # no subtree over this goes to a task while bits are left to split on
PAIRS_AT_ONCE = 500_000  # node pairs a task expands together


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one whole text, as a signed number.

    A-Z is lowered, words are runs of non-white-space, shingles are ``shingle`` words joined by a
    space (fewer words: all of them); a bit is set if more than half of the XXH64 values set it.
    No words, or no text: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    starts, ends, total = starts[: n - k + 1], ends[k - 1:], n - k + 1
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 15):
        s, e = starts[at: at + (1 << 15)].tolist(), ends[at: at + (1 << 15)].tolist()
        h = np.fromiter([digest(joined[i:j], seed) for i, j in zip(s, e)], np.uint64, len(s))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * counts > total, bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return simhash(text)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links u-v: each node but the smallest of its component, with that one."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of values of two subtrees (sorted uint64 arrays) that differ in at most ``budget`` bits.

    ``same``: both are one subtree, and each pair comes once. ``depth``: bits above, in which all
    values of a subtree agree. Node pairs wait on a stack, so that memory stays bounded.
    """
    if not len(a) or not len(b):
        return
    shift = np.uint64(BITS - depth)
    above = int(np.bitwise_count((a[0] >> shift) ^ (b[0] >> shift))) if depth else 0
    if above > budget:
        return
    one = np.uint64(1)
    root = (np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([above]))
    stack = [(depth, same, root)]
    while stack:
        level, same_node, (alo, ahi, blo, bhi, err) = stack.pop()
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            stack.append((level, same_node, tuple(x[half:] for x in (alo, ahi, blo, bhi, err))))
            stack.append((level, same_node, tuple(x[:half] for x in (alo, ahi, blo, bhi, err))))
            continue
        single = ((ahi - alo) == 1) & ((bhi - blo) == 1)
        if level == BITS:
            single[:] = True
        if single.any():
            x, y = a[alo[single]], b[blo[single]]
            close = np.bitwise_count(x ^ y) <= budget
            if same_node:
                close &= x != y
            if close.any():
                yield x[close], y[close]
            alo, ahi, blo, bhi, err = (z[~single] for z in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        low = np.uint64(BITS - 1 - level)
        amid = np.clip(np.searchsorted(a, ((a[alo] >> low) | one) << low), alo, ahi)
        bmid = amid if same_node else np.clip(np.searchsorted(b, ((b[blo] >> low) | one) << low), blo, bhi)
        zero, ones = (alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err)
        crossed = (alo, amid, bmid, bhi, err + 1)
        if same_node:
            nexts = [([zero, ones], True), ([crossed], False)]
        else:
            nexts = [([zero, ones, crossed, (amid, ahi, blo, bmid, err + 1)], False)]
        for children, still_same in nexts:
            cols = [np.concatenate(x) for x in zip(*children)]
            keep = (cols[1] > cols[0]) & (cols[3] > cols[2]) & (cols[4] <= budget)
            if keep.any():
                stack.append((level + 1, still_same, tuple(c[keep] for c in cols)))


def _forest(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, v = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for x, y in found:
        u, v = stars(np.concatenate((u, x)), np.concatenate((v, y)))
    return u, v


def _depth(fps: DataFrame, cell_rows: int, cell_max: int) -> int:
    """Levels of the trie above the subtrees that single tasks walk."""
    n = fps.count()
    p = max(0, int(np.ceil(np.log2(max(n, 1) / cell_rows)))) if n > cell_rows else 0
    while 0 < p < 40:
        top = fps.groupBy(F.shiftrightunsigned("fp", BITS - p).alias("c")).count().agg(F.max("count")).first()[0]
        if top <= cell_max:
            break
        p += 2
    return p


def links(fps: DataFrame, max_bits: int = 2, cell_rows: int = CELL_ROWS, cell_max: int = CELL_MAX) -> DataFrame:
    """Spanning links ``(u, v)`` between distinct fingerprints (column ``fp``) at most ``max_bits`` apart."""
    p = _depth(fps, cell_rows, cell_max)
    masks = sorted(sum(1 << i for i in bits) for n in range(max_bits + 1) for bits in combinations(range(p), n))
    cell = F.shiftrightunsigned("fp", BITS - p) if p else F.lit(0).cast("long")
    dealt = (fps.select("fp", cell.alias("c"))
             .select("fp", "c", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
             .select("fp", F.least("c", F.col("c").bitwiseXOR(F.col("m"))).alias("lo"),
                     F.greatest("c", F.col("c").bitwiseXOR(F.col("m"))).alias("hi"), "c"))

    def join(key: tuple[int, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        values = pdf["fp"].to_numpy().view(np.uint64)
        cells = pdf["c"].to_numpy()
        a = np.sort(values[cells == lo])
        b = a if lo == hi else np.sort(values[cells == hi])
        u, v = _forest(walk(a, b, lo == hi, p, max_bits))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("lo", "hi").applyInPandas(join, "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``: root is the smallest node of its component.

    Alternating large-star and small-star rounds; each round is a table in the shared folder.
    """
    def tidy(e):
        return (e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def star(e, large: bool):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u")
        if large:
            return tidy(out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        return tidy(out.select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(low.select("u", F.col("m").alias("v"))))

    e = materialize(tidy(edges), "links")
    seen = state(e)
    while seen[0]:
        e = materialize(star(star(e, True), False), "links")
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint (16 hex digits), component_id``, and its row key.

    component_id is the smallest id in the connected component of documents whose fingerprints
    differ in at most ``max_bits`` bits step by step. A null text counts as empty; texts without
    words have fingerprint 0 and are linked like others. Null ids are kept; they never name a
    component unless it has no other id (then null). Repeated rows each get their row.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    fps = materialize(d.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")),
                               fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fp-classes")
    roots = materialize(connected(links(classes.select("fp"), max_bits)), "fp-roots")
    linked = roots.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "least_id")
    named = materialize(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "fp-components")
    of_fp = roots.join(named, "root").select(F.col("node").alias("fp"), "root", "component_id")
    of_class = materialize(classes.join(of_fp, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias(ROOT),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id")),
        "fp-class-components")
    return fps.join(of_class, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", ROOT, ID_KEY, TEXT_KEY)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    A component without any id keeps the row with the smallest text key; of rows that repeat id
    and text one stays, of equal ids with different texts in a component the smallest text key.
    """
    found = simhash_components(docs, id_col, text_col, shingle, max_bits)
    first = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy(ROOT).agg(F.min(F.struct(ID_KEY, TEXT_KEY)).alias("k")).select("k.*"))
    return semi_filter(docs, materialize(first, "kept-keys"), id_col, text_col, once=True)

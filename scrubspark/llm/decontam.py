"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Windows of as many words as an item has are compared with it by word edit distance. The CGK
embedding walks a window with random steps (each symbol met decides by a random bit whether the
walk moves on), which maps edit distance to Hamming distance; tables of a few sampled places of
the embedding then make close windows and items meet with the target probability. Pairs that
meet are verified by an exact edit distance.

Windows that can't lie within the bound are left out before they are embedded, by the q-gram lemma:
k word edits in m words leave at least m - q + 1 - kq runs of q words as they were, so that a window
needs as many runs that occur in the benchmark at all. This leaves out no window within the bound.

The benchmark is read in blocks of bounded size; each block goes over all documents.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from functools import cache
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import pick

#: How the Unicode names of scripts without spaces between words start. Each code point is a word there.
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "HALFWIDTH KATAKANA", "BOPOMOFO", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")
FEW = 8                   # kinds of characters that are replaced one after the other, not by a table

#: ASCII other than letters and digits separates words
_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
RUN_BITS = 22             # size of the hashed sets of two- and three-word runs (a collision keeps a window)
OWN_BITS = 16             # likewise, for the three-word runs of the items of one length
BLOCK_BYTES = 8 << 20     # of benchmark text that is broadcast at a time
MIN_WORDS = 2             # a single word is nobody's passage; up to four words must stand as they are (bound 0)
SIMILARITY = 0.8          # an item of m words may differ by (1 - SIMILARITY) m word edits
TARGET_RECALL = 0.99
PLACES = 2                # sampled places per table
TABLES_PER_WALK = 12
MOST_TABLES = 3_000       # a bound that needs more raises: nothing is searched at less than the target
TRIALS = 512              # trial edits per length of items
CHUNK = 1 << 20           # words worked on at once
WINDOWS = 1 << 16         # windows embedded at once


@cache
def _parted(c: str) -> str | None:
    """What stands for a character outside ASCII before words are split; None: itself, as part of a word."""
    category = unicodedata.category(c)
    if category[0] in "PSZ" or category == "Cc":
        return " "
    if category == "Cf":                # soft hyphens, joiners
        return ""
    return f" {c} " if unicodedata.name(c, "").startswith(UNSPACED) else None


def words(text: str | None) -> list[bytes]:
    """The words of a text, lowered: runs of letters, digits and marks; in scripts without spaces, code points."""
    t = (text or "").lower()
    if not t.isascii():
        parted = {c: p for c in set(t) if c > "\x7f" and (p := _parted(c)) is not None}
        if len(parted) <= FEW:
            for c, p in parted.items():
                t = t.replace(c, p)
        else:
            t = t.translate(str.maketrans(parted))
    return t.encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def _runs(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q symbols that start at each place (the last q-1 places wrap around)."""
    h = x.astype(np.uint32)
    for d in range(1, q):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.roll(x, -d).astype(np.uint32)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - RUN_BITS)


def edit_bound(m: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * m + 1e-9)


class Tables:
    """The CGK walks and sampled places for sequences of ``m`` symbols, all from one seed."""

    def __init__(self, m: int, n_tables: int, seed: int):
        r = np.random.default_rng([seed, m])
        self.m, self.steps = m, 2 * m   # a walk reaches the end of its window after 2m steps on average
        self.walks = []
        for at in range(0, n_tables, TABLES_PER_WALK):
            n = min(TABLES_PER_WALK, n_tables - at)
            a = r.integers(0, 1 << 32, self.steps, dtype=np.uint32) | np.uint32(1)
            b = r.integers(0, 1 << 32, self.steps, dtype=np.uint32)
            self.walks.append((a, b, np.stack([np.sort(r.choice(self.steps, PLACES, replace=False)) for _ in range(n)])))
        self.mix = r.integers(1, 1 << 62, PLACES, dtype=np.uint64) | np.uint64(1)

    def embed(self, x: np.ndarray, walk: int, last: int | None = None) -> np.ndarray:
        """Symbols met at each step (steps x windows) by one walk over the rows of ``x`` (-1 past the end)."""
        a, b, places = self.walks[walk]
        steps = (int(places.max()) if last is None else last) + 1
        n = len(x)
        flat = np.concatenate([x, np.full((n, 1), -1, x.dtype)], axis=1).ravel()
        at = np.arange(n, dtype=np.int64) * (self.m + 1)
        end = at + self.m
        out = np.empty((steps, n), x.dtype)
        for j in range(steps):
            s = flat[at]
            out[j] = s
            at = np.minimum(at + ((s.astype(np.uint32) * a[j] + b[j]) >> np.uint32(31)).astype(np.int64), end)
        return out

    def keys(self, x: np.ndarray, first_walk: int = 0):
        """The key of each window in one table after the other."""
        for w in range(first_walk, len(self.walks)):
            met = self.embed(x, w).astype(np.uint64)
            for p in self.walks[w][2]:
                key = np.zeros(len(x), np.uint64)
                for place, c in zip(p, self.mix):
                    key = (key ^ met[place]) * c
                    key ^= key >> np.uint64(29)
                yield key


def tables_needed(x: np.ndarray, k: int, n_symbols: int, target: float, seed: int) -> int:
    """Tables that reach the target recall at the edit bound, by trial edits of the items themselves.

    The trials go through the very tables that will be used, so that what tables of one walk have in
    common counts; half of the misses that the target allows are kept as a margin.
    """
    m = x.shape[1]
    r = np.random.default_rng([seed, m, 1])
    some = x[np.unique(np.linspace(0, len(x) - 1, TRIALS).astype(int))]
    base, edited = [], []
    for row in np.resize(some, (TRIALS, m)):
        y = list(row)
        for _ in range(k):
            kind, at = r.integers(3), int(r.integers(len(y))) if y else 0
            if kind == 0 and len(y) > 1:
                del y[at]
            elif kind == 1:
                y.insert(at, int(r.integers(n_symbols)))
            else:
                y[at] = int(r.integers(n_symbols))
        base.append(row)
        edited.append((y + [0] * m)[:m])
    b, e = np.array(base, np.int32), np.array(edited, np.int32)
    missed = np.ones(TRIALS, bool)
    for n in range(TABLES_PER_WALK, MOST_TABLES + 1, TABLES_PER_WALK):
        t, last = Tables(m, n, seed), n // TABLES_PER_WALK - 1   # its earlier walks are those of fewer tables
        for u, v in zip(t.keys(b, last), t.keys(e, last)):
            missed &= u != v
        if np.count_nonzero(missed) <= (1 - target) / 2 * TRIALS:
            return n
    raise ValueError(f"{MOST_TABLES} tables don't find {k} edits in {m} words with a recall of {target}")


def infix_distance(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each item (rows) to the nearest piece of its region, and where that piece ends."""
    n, width = regions.shape
    j = np.arange(width + 1, dtype=np.int32)
    d = np.zeros((n, width + 1), np.int32)
    for i in range(items.shape[1]):
        t = np.empty_like(d)
        t[:, 0] = i + 1
        np.minimum(d[:, :-1] + (regions != items[:, i: i + 1]), d[:, 1:] + 1, out=t[:, 1:])
        d = np.minimum.accumulate(t - j, axis=1) + j
    end = d.argmin(axis=1)
    return d[np.arange(n), end], end


class Index:
    """A block of benchmark items ``[(item_id, text)]``, ready to be met by documents."""

    def __init__(self, items: list[tuple], similarity: float, target: float, seed: int,
                 min_words: int = MIN_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        by_length = defaultdict(list)
        for item_id, text in items:
            w = words(text)
            if len(w) >= max(min_words, 2):
                by_length[len(w)].append((item_id, [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]))
        self.classes = []
        for m, of in sorted(by_length.items()):
            x, k = np.array([y for _, y in of], np.int32), edit_bound(m, similarity)
            t = Tables(m, tables_needed(x, k, len(self.vocabulary) + 1, target, seed), seed)
            entries = []
            for key in t.keys(x):
                order = np.argsort(key, kind="stable")
                entries.append((key[order], order))
            self.classes.append((m, k, [i for i, _ in of], x, t, entries))
        self.pad = max((k for _, k, *_ in self.classes), default=0)
        self.runs = {}
        for q in (2, 3):
            self.runs[q] = np.zeros(1 << RUN_BITS, bool)
            for _, _, _, x, *_ in self.classes:
                for row in x:
                    self.runs[q][_runs(row, q)[: len(row) - q + 1]] = True
        self.own = []         # three-word runs of each class
        for _, _, _, x, *_ in self.classes:
            own = np.zeros(1 << OWN_BITS, bool)
            for row in x:
                own[_runs(row, 3)[: len(row) - 2] >> np.uint32(RUN_BITS - OWN_BITS)] = True
            self.own.append(own)
        # classes whose windows must hold a few three-word runs are looked for only where such runs gather
        self.strong = [c for c in self.classes if c[0] - 2 - 3 * c[1] >= 3]
        self.least = min((c[0] - 2 - 3 * c[1] for c in self.strong), default=0)

    def _candidates(self, x: np.ndarray, cls) -> np.ndarray:
        """Window number * items + item of the pairs that meet in some table."""
        _, _, ids, _, tables, entries = cls
        out = []
        for key, (sorted_keys, order) in zip(tables.keys(x), entries):
            lo, hi = np.searchsorted(sorted_keys, key), np.searchsorted(sorted_keys, key, "right")
            n = hi - lo
            w = np.flatnonzero(n)
            if len(w):
                w = np.repeat(w, n[w])
                first = np.repeat(lo[w[np.concatenate(([True], w[1:] != w[:-1]))]], n[np.unique(w)])
                step = np.arange(len(w)) - np.repeat(np.cumsum(n[np.unique(w)]) - n[np.unique(w)], n[np.unique(w)])
                out.append(w * len(ids) + order[first + step])
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """Per text the items found: ``(item id, least distance, first word of that window)``, by item id."""
        found: list[dict] = [{} for _ in texts]
        if self.classes:
            longest = max(m for m, *_ in self.classes)
            get, block, size, windows = self.vocabulary.get, [], 0, [[] for _ in self.classes]
            for t, text in enumerate(texts):
                ids = list(map(get, words(text), repeat(0)))
                for at in range(0, max(len(ids), 1), CHUNK):  # pieces of very long texts overlap by a window
                    piece = ids[at: at + CHUNK + longest + self.pad]
                    block.append((t, at, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        self._windows(block, windows)
                        block, size = [], 0
            self._windows(block, windows)
            for cls, parts in zip(self.classes, windows):
                if parts:
                    self._meet(cls, *(np.concatenate(p) for p in zip(*parts)), found)
        return [sorted(((i, d, at) for i, (d, at) in f.items()), key=lambda x: (x[0] is None, x[0] or 0)) for f in found]

    def _windows(self, block: list[tuple], out: list[list]) -> None:
        """Windows of the block's texts that may lie within the bound, per class: text, first word, region, window."""
        if not block:
            return
        pad = [0] * self.pad
        x = np.array([i for _, _, piece in block for i in piece + pad], np.int32)
        lens = np.array([len(p) + self.pad for _, _, p in block])
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        end = np.repeat(starts + lens, lens)
        # how many runs of q benchmark words start before each place, up to three words long
        before = {1: np.concatenate(([0], np.cumsum(x > 0, dtype=np.int32)))}
        for q in (2, 3):
            runs = _runs(x, q)
            before[q] = np.concatenate(([0], np.cumsum(self.runs[q][runs], dtype=np.int32)))
        runs >>= np.uint32(RUN_BITS - OWN_BITS)
        dense = None
        if self.strong:
            reach = np.minimum(np.arange(len(x)) + max(c[0] for c in self.strong) - 2, len(x))
            dense = np.flatnonzero(before[3][reach] - before[3][:-1] >= self.least)
        for (m, k, *_), own, kept in zip(self.classes, self.own, out):
            at = np.arange(len(x)) if m - 2 - 3 * k < 3 else dense
            at = at[at + m <= end[at]]
            for q in (3, 2, 1):
                at = at[before[q][at + m - q + 1] - before[q][at] >= m - q + 1 - k * q]
            for part in range(0, len(at), WINDOWS):
                first = at[part: part + WINDOWS]
                first = first[own[runs[first[:, None] + np.arange(m - 2)]].sum(axis=1) >= m - 2 - 3 * k]
                if len(first):
                    b = np.searchsorted(starts, first, "right") - 1
                    where = np.maximum(first - k, starts[b])[:, None] + np.arange(m + 2 * k)
                    region = np.where(where < end[first][:, None], x[np.minimum(where, len(x) - 1)], -1)
                    text, offset = (np.array([block[i][j] for i in b], np.int64) for j in (0, 1))
                    kept.append((text, first - starts[b] + offset, region, x[first[:, None] + np.arange(m)]))

    def _meet(self, cls, text: np.ndarray, at: np.ndarray, region: np.ndarray, x: np.ndarray, found: list[dict]) -> None:
        """Windows and items that meet in a table, verified; the best window of each text and item stays in ``found``."""
        _, k, ids, items, *_ = cls
        for part in range(0, len(x), WINDOWS):
            pairs = self._candidates(x[part: part + WINDOWS], cls)
            for some in range(0, len(pairs), 4096):
                w, i = np.divmod(pairs[some: some + 4096], len(ids))
                d, _ = infix_distance(items[i], region[part + w])
                for q in np.flatnonzero(d <= k):
                    t, new, item = int(text[part + w[q]]), (int(d[q]), int(at[part + w[q]])), ids[i[q]]
                    if item not in found[t] or new < found[t][item]:
                        found[t][item] = new


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark's items in lists of about ``block_bytes`` (one list at a time is on the driver)."""
    b = pick(benchmark, item_col, text_col).toDF("item_id", "text").where("text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(total / block_bytes))
    for i in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leak_columns(spark, benchmark: DataFrame, text: Column, item_col: str = "item_id", text_col: str = "text",
                 similarity: float = SIMILARITY, target: float = TARGET_RECALL, block_bytes: int = BLOCK_BYTES,
                 seed: int = 11, min_words: int = MIN_WORDS) -> list[Column]:
    """Per benchmark block, an array of ``item_id, distance, first_word`` of the items found in ``text``.

    Words as ``words`` gives them. Items of one word or of fewer than ``min_words`` are not looked for; a null
    text holds nothing. Items that share an id count as one in a block.
    """
    def find_in(shared):
        @F.pandas_udf("item_id array<long>, distance array<int>, first_word array<int>")
        def leaks(texts: pd.Series) -> pd.DataFrame:
            found = shared.value.search(list(texts))
            return pd.DataFrame({name: [[y[c] for y in f] for f in found]
                                 for c, name in enumerate(("item_id", "distance", "first_word"))})

        return leaks(text)

    out = []
    for items in blocks(benchmark, item_col, text_col, block_bytes):
        found = find_in(spark.sparkContext.broadcast(Index(items, similarity, target, seed, min_words)))
        out.append(F.arrays_zip(found["item_id"].alias("item_id"), found["distance"].alias("distance"),
                                found["first_word"].alias("first_word")))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """``doc_id, item_id, distance, first_word``: one row per row of ``docs`` and item found in it.

    Items that share an id count as one, in whichever blocks they lie: the nearest is given, of those as near the first.
    ``first_word`` is that of the window in which the item was found, within twice the edit bound of the passage's own.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    columns = leak_columns(docs.sparkSession, benchmark, F.col("text"), **options)
    if len(columns) == 1:
        return (d.select("doc_id", columns[0].alias("l")).select("doc_id", F.explode("l").alias("l"))
                .select("doc_id", "l.*"))
    parts = None
    for block, c in enumerate(columns):
        one = d.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
                       F.lit(block).alias("block"), c.alias("l"))
        one = one.select("doc_id", "h1", "h2", "block", F.explode("l").alias("l")).select("doc_id", "h1", "h2", "block", "l.*")
        parts = one if parts is None else parts.unionByName(one)
    # rows of one id and text give the same in every block, so how often they come is known from any
    row = ["doc_id", "h1", "h2", "item_id"]
    nearest = F.min(F.struct("distance", "first_word")).alias("l")
    found = parts.groupBy(*row, "block").agg(nearest, F.count(F.lit(1)).alias("n"))
    found = found.groupBy(*row).agg(F.min("l").alias("l"), F.max("n").alias("n"))
    return found.select("doc_id", "item_id", "l.distance", "l.first_word", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those in which a benchmark item was found."""
    cols = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    for c in leak_columns(docs.sparkSession, benchmark, F.col(f"_c{cols.index(text_col)}"), **options):
        flat = flat.where(F.size(c) == 0)
    return flat.toDF(*cols)

"""Periodic runs of words, found on a grammar of the text.

Spark deals documents to tasks; a task takes the documents of a block together, as arrays. The
words of a document become ids, and Re-Pair replaces pairs of neighbouring symbols by new ones:
where pairs overlap the more frequent one is replaced (ties by a fixed mix of the pair, which keeps
the derivation flat), pairs that don't touch are replaced in the same round. A pair seen fewer than
three times is left alone: a run of four periods repeats each of its pairs three times at least,
so no run crosses such a place, and the sequences between those places are the start rules, closed
by a balanced tree.

A run of the text lies within the derivation of some nonterminal and crosses the boundary between its
two parts at the lowest such node. So for each nonterminal the runs that cross its boundary are
computed once, however often it occurs; they are translated to every position at which it is derived,
and intervals of one period that overlap by it or more are merged to maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import pick

LEAST_COUNT = 3            # a pair seen less often is in no run
BLOCK_WORDS = 400_000      # words a task treats together (a longer document is a block of its own)
PAIRS_AT_ONCE = 1_000_000  # candidate periods compared together

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Grammar:
    """Straight-line grammar: symbols under ``n_terminals`` stand for words, others for two symbols."""

    def __init__(self, n_terminals: int):
        self.n_terminals = self.size = n_terminals
        self.left, self.right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.length, self.at = [np.ones(n_terminals, np.int64)], [np.zeros(n_terminals, np.int64)]
        self.layers: list[tuple[int, int]] = []     # symbols made in a round use those of earlier ones only
        self._keys, self._ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, left, right, length, at) -> np.ndarray:
        ids = np.arange(self.size, self.size + len(left))
        for column, values in zip((self.left, self.right, self.length, self.at), (left, right, length, at)):
            column.append(values)
        self.layers.append((self.size, self.size + len(left)))
        self.size += len(left)
        return ids

    def named(self, keys: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The symbol of each pair (``left << 32 | right``, distinct and sorted); a new one where there is none."""
        where = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        inside = where < len(self._keys)
        known[inside] = self._keys[where[inside]] == keys[inside]
        out = np.empty(len(keys), np.int64)
        out[known] = self._ids[where[known]]
        new = ~known
        out[new] = self.add(keys[new] >> 32, keys[new] & 0xFFFFFFFF, lengths[new], first[new])
        self._keys = np.insert(self._keys, where[new], keys[new])
        self._ids = np.insert(self._ids, where[new], out[new])
        return out

    def close(self) -> None:
        """Lists of columns become arrays over all symbols."""
        none = np.full(self.n_terminals, -1, np.int64)
        self.left, self.right = (np.concatenate([none, *x]) for x in (self.left, self.right))
        self.length, self.at = np.concatenate(self.length), np.concatenate(self.at)


def _mix(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)


def repair(words: np.ndarray, same: np.ndarray) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar of ``words`` (ids from 0) and its roots: one symbol and place for each sequence.

    ``same[i]``: words i and i + 1 belong to one sequence.
    """
    g = Grammar(int(words.max()) + 1 if len(words) else 0)
    symbol, start, open_ = words.copy(), np.arange(len(words)), same.copy()
    length = np.ones(len(words), np.int64)
    sequence = np.concatenate(([0], np.cumsum(~same[:-1]))) if len(words) else np.empty(0, np.int64)
    while True:
        i = np.flatnonzero(open_)
        if not len(i):
            break
        keys = symbol[i] << 32 | symbol[i + 1]
        # in a a a a, only every other place counts as a pair
        equal = symbol[i] == symbol[i + 1]
        n = np.arange(len(i))
        follows = np.zeros(len(i), bool)
        follows[1:] = equal[1:] & equal[:-1] & (i[1:] == i[:-1] + 1)
        taken = (n - np.maximum.accumulate(np.where(follows, 0, n))) % 2 == 0
        distinct, which = np.unique(keys, return_inverse=True)
        count = np.bincount(which, weights=taken, minlength=len(distinct)).astype(np.int64)
        rare = count[which] < LEAST_COUNT
        open_[i[rare]] = False       # replacing more pairs never makes this one more frequent
        usable = taken & ~rare
        if not usable.any():
            continue
        rank = np.zeros(len(symbol) + 2, np.uint64)      # by place, one off
        rank[i[usable] + 1] = (count[which[usable]].astype(np.uint64) << np.uint64(24)) | _mix(distinct)[which[usable]]
        best = (rank[1:-1] > rank[:-2]) & (rank[1:-1] >= rank[2:])
        p = np.flatnonzero(best & (rank[1:-1] > 0))
        pair, first, back = np.unique(symbol[p] << 32 | symbol[p + 1], return_index=True, return_inverse=True)
        names = g.named(pair, start[p[first]], length[p[first]] + length[p[first] + 1])
        symbol[p], length[p], open_[p] = names[back], length[p] + length[p + 1], open_[p + 1]
        stays = np.ones(len(symbol), bool)
        stays[p + 1] = False
        symbol, start, length, open_, sequence = (x[stays] for x in (symbol, start, length, open_, sequence))
    while len(symbol):   # start rules, as balanced trees
        head = np.concatenate(([True], sequence[1:] != sequence[:-1]))
        n = np.arange(len(symbol))
        place = n - np.maximum.accumulate(np.where(head, n, 0))
        p = np.flatnonzero((place[:-1] % 2 == 0) & ~head[1:])
        if not len(p):
            break
        symbol[p] = g.add(symbol[p], symbol[p + 1], length[p] + length[p + 1], start[p])
        length[p] += length[p + 1]
        stays = np.ones(len(symbol), bool)
        stays[p + 1] = False
        symbol, start, length, sequence = (x[stays] for x in (symbol, start, length, sequence))
    g.close()
    return g, symbol, start


class Equal:
    """Lengths of equal stretches, from names of all stretches of 1, 2, 4 ... words (equal names: equal words)."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, longest: int):
        self.names, size, n = [words], 1, len(words)
        at = np.arange(n)
        while size * 2 <= longest or size < 4:
            whole = np.flatnonzero(at + 2 * size <= ends)
            last = self.names[-1]
            name = np.full(n, -1, np.int64)
            name[whole] = np.unique(last[whole] << 32 | last[whole + size], return_inverse=True)[1]
            self.names.append(name)
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, at most ``most`` (which stays inside the sequence)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, fits = self.names[k], np.flatnonzero(out + (1 << k) <= most)
            a = name[i[fits] + out[fits]]
            out[fits[(a >= 0) & (a == name[j[fits] + out[fits]])]] += 1 << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before i and before j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, fits = self.names[k], np.flatnonzero(out + (1 << k) <= most)
            a = name[i[fits] - out[fits] - (1 << k)]
            out[fits[(a >= 0) & (a == name[j[fits] - out[fits] - (1 << k)])]] += 1 << k
        return out


def _candidates(eq: Equal, b: np.ndarray, half: np.ndarray, after: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, period) for periods that a square beside boundary ``b`` may have, ``half`` at most.

    Periods 1 to 3 always; longer ones where the four words at the boundary stand again one period on.
    """
    nodes = np.arange(len(b))
    for q in (1, 2, 3):
        yield nodes[half >= q], np.full((half >= q).sum(), q)
    name = eq.names[2]
    here = np.flatnonzero(name >= 0)
    index = np.sort(name[here] << 32 | here)
    at = b if after else b - 4
    long = nodes[half >= 4]
    own, place = name[at[long]], at[long]
    long, own, place = long[own >= 0], own[own >= 0], place[own >= 0]
    low, high = (place + 4, place + half[long]) if after else (place - half[long], place - 4)
    lo = np.searchsorted(index, own << 32 | np.maximum(low, 0))
    hi = np.maximum(np.searchsorted(index, own << 32 | np.maximum(high, 0), side="right"), lo)
    total = np.cumsum(hi - lo)
    first = 0
    while first < len(long):
        done = total[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
        n = (hi - lo)[first:stop]
        which = np.repeat(np.arange(first, stop), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield long[which], np.abs((index[lo[which] + offset] & 0xFFFFFFFF) - place[which])
        first = stop


def _crossing(g: Grammar, eq: Equal, shortest: int, exponent: int) -> tuple[np.ndarray, ...]:
    """(node, start in it, end, period) of the runs within each nonterminal that cross its boundary."""
    nodes = np.flatnonzero((g.left >= 0) & (g.length >= shortest))
    x0, x1 = g.at[nodes], g.at[nodes] + g.length[nodes]
    b = x0 + g.length[g.left[nodes]]
    found = []
    for after, half in ((True, (x1 - b) // 2), (False, (b - x0) // 2)):
        for k, q in _candidates(eq, b, half, after):
            i = b[k] if after else b[k] - q
            start = i - eq.backward(i, i + q, i - x0[k])
            end = i + q + eq.forward(i, i + q, x1[k] - q - i)
            ok = (end - start >= np.maximum(shortest, exponent * q)) & (start < b[k]) & (end > b[k])
            found.append(np.stack((nodes[k][ok], start[ok] - x0[k][ok], end[ok] - x0[k][ok], q[ok])))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _everywhere(g: Grammar, roots: np.ndarray, places: np.ndarray, runs: tuple) -> tuple[np.ndarray, ...]:
    """(start, end, period) of each run of a nonterminal, at each place at which it is derived."""
    node, start, end, q = runs
    has = np.zeros(g.size, bool)
    has[node] = True
    below = has.copy()
    for lo, hi in g.layers:
        below[lo:hi] |= below[g.left[lo:hi]] | below[g.right[lo:hi]]
    first, last = np.searchsorted(node, np.arange(g.size)), np.searchsorted(node, np.arange(g.size), side="right")
    out = []
    keep = below[roots]
    roots, places = roots[keep], places[keep]
    while len(roots):
        own = has[roots]
        r, at = roots[own], places[own]
        n = last[r] - first[r]
        k = np.repeat(first[r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        out.append(np.stack((at + start[k], at + end[k], q[k])))
        inner = g.left[roots] >= 0
        roots, places = roots[inner], places[inner]
        roots, places = (np.concatenate((g.left[roots], g.right[roots])),
                         np.concatenate((places, places + g.length[g.left[roots]])))
        keep = below[roots]
        roots, places = roots[keep], places[keep]
    return tuple(np.concatenate(out, axis=1)) if out else (np.empty(0, np.int64),) * 3


def _maximal(start: np.ndarray, end: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Intervals of one period that overlap by it are one run; of periods of one stretch the smallest counts."""
    if not len(q):
        return start, end, q
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    reach = np.maximum.accumulate(q * (n + 1) + end)     # later periods lie above all ends of earlier ones
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (start[1:] > reach[:-1] - q[1:] * (n + 1) - q[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(q)) - 1
    start, end, q = start[first], reach[last] - q[first] * (n + 1), q[first]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.ones(len(q), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[least], end[least], q[least]


def find_runs(words: np.ndarray, bounds: np.ndarray, shortest: int = 6, exponent: int = 4) -> tuple[np.ndarray, ...]:
    """(start, end, period), sorted, of the runs of several texts laid end to end.

    ``words``: a number per word, equal for equal words; text k is ``words[bounds[k]:bounds[k + 1]]``. A run is a
    stretch of one text with smallest period q and at least ``max(shortest, exponent * q)`` words that
    no neighbouring word extends (``exponent`` 4 or more).
    """
    if exponent < 4:
        raise ValueError("pairs seen twice are not looked at: the exponent is 4 or more")
    none = (np.empty(0, np.int64),) * 3
    if not len(words):
        return none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = np.unique(text << 32 | words, return_inverse=True)[1]       # a word is another one in another text
    pair, count = np.unique(own[:-1] << 32 | own[1:], return_inverse=True, return_counts=True)[1:]
    same = np.zeros(len(words), bool)
    same[:-1] = (text[:-1] == text[1:]) & (count[pair] >= LEAST_COUNT)
    # sequences of such pairs, long enough for a run
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    head, tail = edge[::2], edge[1::2]
    wide = tail - head + 1 >= shortest
    head, tail = head[wide], tail[wide]
    if not len(head):
        return none
    sizes = tail - head + 1
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) + np.repeat(head - (ends - sizes), sizes)     # where each kept word stands
    kept = np.unique(own[place], return_inverse=True)[1]
    joined = np.ones(len(kept), bool)
    joined[ends - 1] = False
    g, roots, at = repair(kept, joined)
    eq = Equal(kept, np.repeat(ends, sizes), int(sizes.max()))
    runs = _crossing(g, eq, shortest, exponent)
    start, end, q = _maximal(*_everywhere(g, roots, at, runs), len(kept))
    return place[start], place[end - 1] + 1, q


def _blocks(texts: list) -> Iterator[list[list[bytes]]]:
    """Texts as lists of words, in blocks of bounded length."""
    block, n = [], 0
    for t in texts:
        words = (t or b"").split()       # bytes split at exactly tab to carriage return, and space
        if block and n + len(words) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append(words)
        n += len(words)
    if block:
        yield block


def _analyse(texts: list[list[bytes]], shortest: int, exponent: int) -> Iterator[tuple[list, bytes]]:
    """(runs, the text without the repetitions) of each text of a block."""
    bounds = np.cumsum([0, *map(len, texts)])
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, bounds[-1])
    start, end, q = find_runs(numbers, bounds, shortest, exponent)
    cut = np.searchsorted(start, bounds)
    for k, words in enumerate(texts):
        mine = slice(cut[k], cut[k + 1])
        s, e, p = start[mine] - bounds[k], end[mine] - bounds[k], q[mine]
        if len(s):
            change = np.bincount(s + p, minlength=len(words) + 1) - np.bincount(e, minlength=len(words) + 1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
        yield ([{"start": a, "length": b - a, "period": c} for a, b, c in zip(s.tolist(), e.tolist(), p.tolist())],
               b" ".join(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6,
                  exponent: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, runs, collapsed``.

    ``runs``: every run (start as a word number from 0, length and smallest period in words) by start, then
    period. ``collapsed``: the words joined by one space, without those that some run holds after its
    first period. Words are runs of characters other than space and tab to carriage return. A
    null or empty text has no runs and collapses to the empty text; rows that repeat an id each get
    their row, null ids stay null; other columns are not looked at.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            found = [x for block in _blocks(texts) for x in _analyse(block, shortest, exponent)]
            runs = pa.array([r for r, _ in found], pa.list_(pa.struct([(n, pa.int64()) for n in
                                                                       ("start", "length", "period")])))
            collapsed = pa.array([c for _, c in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), runs, collapsed],
                                             ["doc_id", "runs", "collapsed"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, runs {RUN_TYPE}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (compared exactly; ties: smallest start, then period)."""
    def better(a: Column, b: Column) -> Column:
        x = a["length"].cast("decimal(19,0)") * b["period"]
        y = b["length"].cast("decimal(19,0)") * a["period"]
        return a.isNull() | (x < y)      # runs come by start, then period: the first of equals stays

    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))

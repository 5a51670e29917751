"""Where flagged rows stand in table order: an associative summary per piece of the input, folded in order.

A piece is a contiguous stretch of the ordered rows. Its summary (rows, flagged rows, flagged run at its
start, at its end, longest inside) joins with that of the next piece to the summary of both, so no row
needs a position and nothing is written:

* in file order a piece is what a task reads of one file, so the rows aren't moved at all;
* for other orders rows are range-partitioned and sorted, a piece is a part of a range.

Pieces are cut at ``n / PIECES`` rows, so there are at most ``PIECES`` and as many as there are splits: they are
folded on the driver. The rows up to a position (the thirds of the missing pattern) end inside one piece;
that piece alone is looked at again, by its first and last key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.contracts import qcol

FLAG = "__flag"
PIECES = 50_000       # pieces the driver folds at most, beside one a split
LEAST_PIECE = 1_024   # rows of a piece, at least
FEW_ROWS = 10_000     # so many rows are simply sorted
SUMMARY = ["pid", "seq", "n", "flagged", "first", "last", "longest"]


@dataclass(frozen=True)
class Runs:
    """Flagged rows of a contiguous stretch: how many, the run at each end and the longest."""

    n: int = 0
    flagged: int = 0
    first: int = 0
    last: int = 0
    longest: int = 0

    def __add__(self, other: Runs) -> Runs:
        return Runs(self.n + other.n, self.flagged + other.flagged,
                    self.first + other.first if self.first == self.n else self.first,
                    other.last + self.last if other.last == other.n else other.last,
                    max(self.longest, other.longest, self.last + other.first))

    @staticmethod
    def of(flags: np.ndarray) -> Runs:
        n = len(flags)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return Runs(n)
        return Runs(n, int((ends - starts).sum()), int(ends[0]) if starts[0] == 0 else 0,
                    int(n - starts[-1]) if ends[-1] == n else 0, int((ends - starts).max()))


@dataclass(frozen=True)
class Piece:
    runs: Runs
    low: tuple      # key of the first row
    high: tuple     # key of the last row


def _summarise(keys: list[str], rows: int, files: bool):
    """Per task: a summary for each stretch of at most ``rows`` rows.

    ``files``: keys are file and row number; a stretch stays within one file, and rows that don't come as
    they stand there are reported by a summary with a negative number of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq, held, low, high = TaskContext.get().partitionId(), 0, Runs(), None, None
        kinds, seen = None, set()

        def row(r: Runs) -> pa.RecordBatch:
            values = [pid, seq, r.n, r.flagged, r.first, r.last, r.longest, *low, *high]
            names = [*SUMMARY, *[f"low{i}" for i in range(len(keys))], *[f"high{i}" for i in range(len(keys))]]
            types = [pa.int32(), *[pa.int64()] * 6, *kinds, *kinds]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            kinds = [c.type for c in columns]
            flags = batch.column(FLAG).to_numpy(zero_copy_only=False).astype(bool)
            cuts = []
            if files:
                name, at = columns[0].dictionary_encode(), columns[1].to_numpy()
                change = name.indices.to_numpy()[1:] != name.indices.to_numpy()[:-1]
                cuts = (np.flatnonzero(change) + 1).tolist()
                back = bool(((at[1:] <= at[:-1]) & ~change).any())
                for k in [0, *cuts]:
                    f = columns[0][k].as_py()
                    if k == 0 and high is not None and high[0] == f:
                        back |= at[0] <= high[1]
                        continue
                    if k == 0 and held.n:
                        yield row(held)
                        held, seq = Runs(), seq + 1
                    back |= f in seen
                    seen.add(f)
                if back:
                    low = high = tuple(c[0].as_py() for c in columns)
                    yield row(Runs(-1))
                    for _ in batches:
                        pass
                    return
            start = 0
            for cut in [*cuts, n]:
                while start < cut:
                    stop = min(cut, start + rows - held.n)
                    if not held.n:
                        low = tuple(c[start].as_py() for c in columns)
                    held = held + Runs.of(flags[start:stop])
                    high = tuple(c[stop - 1].as_py() for c in columns)
                    start = stop
                    if held.n == rows or (start == cut and cut < n):
                        yield row(held)
                        held, seq = Runs(), seq + 1
        if held.n:
            yield row(held)

    return run


def pieces(df: DataFrame, keys: Sequence[str], rows: int, files: bool) -> list[Piece] | None:
    """Summaries of ``df`` (columns ``keys`` and ``FLAG``) in the order of ``keys``, then of the flag.

    ``files``: keys are file and row number; None if rows turn out to have been moved since they were read.
    """
    keys = list(keys)
    laid = df
    if not files:
        keys = [*keys, FLAG]
        columns = [F.col(qcol(k)) for k in keys]
        laid = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([f"{SUMMARY[0]} int", *[f"{c} bigint" for c in SUMMARY[1:]],
                        *[f"low{i} {k}" for i, k in enumerate(kinds)], *[f"high{i} {k}" for i, k in enumerate(kinds)]])
    found = laid.mapInArrow(_summarise(keys, rows, files), schema).collect()
    k, at = len(keys), len(SUMMARY)
    found.sort(key=(lambda r: tuple(r[at:at + k])) if files else (lambda r: (r["pid"], r["seq"])))
    out = [Piece(Runs(*r[2:at]), tuple(r[at:at + k]), tuple(r[at + k:])) for r in found]
    if files and (any(p.runs.n < 0 for p in out) or any(p.high >= q.low for p, q in zip(out, out[1:]))):
        return None
    return out


def _key(df: DataFrame, keys: list[str], values: tuple | None = None) -> Column:
    """The key columns of a row, or these values, as a struct (which Spark compares nulls first)."""
    if values is None:
        return F.struct(*[F.col(qcol(k)).alias(k) for k in keys])
    return F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, values)])


def _flagged_before(df: DataFrame, keys: list[str], rank: int, found: list[Piece], files: bool) -> int:
    """How many of the first ``rank`` rows are flagged."""
    ordered = keys if files else [*keys, FLAG]
    own, done, before = _key(df, ordered), 0, 0
    for last, p in zip([None, *found], found):
        if rank >= done + p.runs.n:
            done, before = done + p.runs.n, before + p.runs.flagged
            continue
        rest = rank - done
        if rest == 0 or p.runs.flagged in (0, p.runs.n):
            return before + (rest if p.runs.flagged else 0)
        low, high = _key(df, ordered, p.low), _key(df, ordered, p.high)
        inside = df.where((own >= low) & (own <= high))
        if p.low[0] is not None and p.high[0] is not None:     # and in a form that reaches the scan
            inside = inside.where(F.col(qcol(keys[0])).between(F.lit(p.low[0]), F.lit(p.high[0])))
        if last is not None and last.high == p.low:
            # rows like the first one stand before the piece, too: they are all alike, flag and all
            n, flagged, ties = df.where(own <= low).agg(
                F.count_if(own < low), F.count_if((own < low) & F.col(FLAG)), F.count_if(own == low)).first()
            rest, before = rank - n, flagged
            if rest <= ties:
                return before + (rest if p.low[-1] else 0)
            rest, before = rest - ties, before + (ties if p.low[-1] else 0)
            inside = inside.where(own > low)
        if rest <= FEW_ROWS:
            first = inside.orderBy(*[F.col(qcol(k)) for k in ordered]).limit(rest)
            return before + first.agg(F.count_if(F.col(FLAG))).first()[0]
        return before + _flagged_before(inside, keys, rest, pieces(inside, keys, _size(p.runs.n), files), files)
    return before


def _size(n: int) -> int:
    return max(LEAST_PIECE, -(-n // PIECES))


def flagged_runs(df: DataFrame, keys: Sequence[str], flag: Column, n: int, ranks: Sequence[int],
                 files: bool = False) -> tuple[Runs, list[int]]:
    """The summary of all rows of ``df`` in the order of ``keys``, and the flagged ones among the first
    ``rank`` rows for each of ``ranks``. ``n``: about how many rows there are. ``files``: the keys are file and
    row number, rows perhaps still where they were read. Of rows that tie on the keys those without the flag
    come first."""
    keys = list(keys)
    flat = df.select(*[F.col(qcol(k)) for k in keys], flag.alias(FLAG))
    found = pieces(flat, keys, _size(n), True) if files else None
    if found is None:
        found, files = pieces(flat, keys, _size(n), False), False
    whole = reduce(Runs.__add__, (p.runs for p in found), Runs())
    return whole, [_flagged_before(flat, keys, min(r, whole.n), found, files) for r in ranks]

"""Near-duplicates by SetSketch registers.

A document is the set of its distinct word shingles. Register i of its sketch is the least of one
exponential variate per shingle, kept on an exponential scale and truncated to 16 bits
(``floor(1 - log_b h)``): registers of a union are the greater ones, so sketches merge, and with a base
near 1 two registers are equal about as often as the sets are similar.

1. Documents with equal sets are one class (grouped by a 128-bit digest, pre-aggregated by task).
2. Classes that agree in a band of registers are candidates: each class of a bucket against the bucket's
   first. A joint likelihood of the registers (which is greater, or equal) given both set sizes sorts
   out pairs that can't reach the threshold; the others are verified on their full sets of shingles.
3. Links make components. Buckets that still hold several are gone through once more in blocks: first
   their sketches, by the same likelihood, which leaves the classes that may have a partner in
   another component of the bucket; then the full sets of those, all against all within a block. A task
   returns a spanning forest of the links it finds, so that no step writes more rows than classes in
   buckets, and no link is lost: only pairs already known to be in one component are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import ID_KEY, TEXT_KEY, pick, row_keys
from scrubspark.llm.simhash import connected, stars
from scrubspark.session import materialize

BANDS, ROWS = 30, 5          # 0.85: a pair shares no band with odds of 2.3e-8
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
FAR = 8.0                    # standard deviations above the unequal registers of the threshold: beyond that bound too
LIKELIHOOD = 14.0            # a pair goes if its likelihood at the threshold is e^-14 of its best
BLOCK_WORDS = 200_000        # words a task treats together
BLOCK_CLASSES = 2_000        # classes of a bucket that one task compares with as many others
BLOCK_SHINGLES = 4_000_000   # and their shingles in all
PAIRS_AT_ONCE = 200_000      # pairs whose likelihood a task computes together
WORDS_HELD = 1_000_000
HOT_PAIRS, HOT_SALTS = 2_000, 64
COPY_SALTS = 8

_ODD = (np.random.default_rng(11).integers(0, 2**63, REGISTERS, np.uint64) << np.uint64(1)) | np.uint64(1)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _P2
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Distinct shingles of texts, as 64-bit hashes of their words in order."""

    def __init__(self, shingle: int):
        self.shingle, self.known = shingle, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > WORDS_HELD:
            known.clear()
        return out

    def of(self, texts: list) -> Iterator[list[np.ndarray]]:
        """Sorted distinct shingle hashes of each text, in blocks of texts."""
        block, n = [], 0
        for t in texts:
            words = (t or b"").lower().split()     # bytes: lowers A-Z alone, splits at tab to CR and space
            if block and n + len(words) > BLOCK_WORDS:
                yield self._block(block)
                block, n = [], 0
            block.append(words)
            n += len(words)
        if block:
            yield self._block(block)

    def _block(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        h = self._hashes([w for words in texts for w in words])
        k, out, at = self.shingle, [], 0
        full = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            full = _mix(full * _P1 + h[j: j + len(full)])
        for words in texts:
            n = len(words)
            if n >= k:
                out.append(np.unique(full[at: at + n - k + 1]))
            elif n:
                x = np.full(1, n, np.uint64)       # a whole short sequence: told apart from longer ones by its length
                for j in range(n):
                    x = _mix(x * _P1 + h[at + j: at + j + 1])
                out.append(x)
            else:
                out.append(h[:0])
            at += n
        return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``REGISTERS`` 16-bit registers for each set that isn't empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = np.concatenate(sets)
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(h * _ODD[i], starts)
    # the least of uniform values, as the least of exponential ones of this rate
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of each sketch."""
    r = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    for j in range(ROWS):
        key = _mix(key * _P1 + r[:, :, j])
    return key.view(np.int64)


def _log_likelihood(j, u, v, greater, less, equal):
    """Of similarity j, given how often the first set's register is greater, less, equal; u + v = 1: shares of sizes."""
    def p(x):
        return -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return greater * np.log(a + tiny) + less * np.log(b + tiny) + equal * np.log(np.maximum(1 - a - b, tiny))


def may_reach(threshold: float, n_a: np.ndarray, n_b: np.ndarray, greater: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Whether pairs may be as similar as ``threshold``, from their registers and sizes.

    The likelihood is concave in the similarity: its maximum is found by golden sections; pairs whose
    maximum lies below the threshold stay unless the likelihood there is out of all proportion.
    """
    out = np.zeros(len(n_a), bool)
    mean = REGISTERS * (1 - threshold)
    some = np.flatnonzero(greater + less <= mean + FAR * np.sqrt(mean * threshold))
    n_a, n_b, greater, less = n_a[some], n_b[some], greater[some], less[some]
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    args = (u, v, greater, less, REGISTERS - greater - less)
    lo, hi, ratio = np.zeros(len(u)), most.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(24):
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = _log_likelihood(c, *args) > _log_likelihood(d, *args)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    best = (lo + hi) / 2
    fits = most >= threshold - 1e-9       # sets of too different sizes can't
    near = _log_likelihood(np.minimum(threshold, most), *args) >= _log_likelihood(best, *args) - LIKELIHOOD
    out[some] = fits & ((best >= threshold) | near)
    return out


def _signatures(d: DataFrame, shingle: int) -> DataFrame:
    """``d`` (doc_id, keys, text) with set size, 128-bit digest of the set and sketch (null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            sizes, high, low, registers = [], [], [], []
            for sets in shingles.of(batch.column("text").cast(pa.large_binary()).to_pylist()):
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full) if full else ())
                for s in sets:
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    sizes.append(len(s))
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
                    registers.append(next(rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(ID_KEY), batch.column(TEXT_KEY), pa.array(sizes, pa.int64()),
                 pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(registers, pa.binary())],
                ["doc_id", ID_KEY, TEXT_KEY, "n_shingles", "k1", "k2", "sketch"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, {ID_KEY} bigint, {TEXT_KEY} bigint, n_shingles bigint, k1 bigint, "
                             "k2 bigint, sketch binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(cid, bucket): each class once for each band."""
    @F.pandas_udf("array<bigint>")
    def keys(sketch: pd.Series) -> pd.Series:
        r = np.frombuffer(b"".join(sketch), np.uint16).reshape(len(sketch), REGISTERS)
        return pd.Series(list(band_keys(r)))

    return classes.select("cid", F.explode(keys("sketch")).alias("bucket"))


def _beside(pairs: DataFrame, side: str, rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """``pairs`` with columns of ``rows`` (key ``cid``) for the class in column ``side``.

    A class in very many pairs is dealt over salts, its row copied to each: at most so many classes as
    a share of all pairs allows, whatever the data.
    """
    counts = pairs.groupBy(side).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") > max(HOT_PAIRS, total // 500)).select(side).collect()]
    is_hot = (lambda c: F.col(c).isin(hot)) if hot else (lambda c: F.lit(False))
    dealt = pairs.withColumn("salt", F.when(is_hot(side), F.pmod(F.xxhash64("a", "b"), F.lit(HOT_SALTS))).otherwise(0)
                             .cast("int"))
    spread = rows.select(F.col("cid").alias(side), *[F.col(k).alias(v) for k, v in names.items()],
                         F.explode(F.sequence(F.lit(0), F.when(is_hot("cid"), HOT_SALTS - 1).otherwise(0)))
                         .alias("salt"))
    return dealt.join(spread, [side, "salt"]).drop("salt")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes that the likelihood of their registers lets through."""
    names = [{"sketch": f"sketch_{s}", "n_shingles": f"n_{s}"} for s in "ab"]
    both = _beside(_beside(pairs, "a", classes, names[0]), "b", classes, names[1])

    @F.pandas_udf("boolean")
    def likely(sa: pd.Series, na: pd.Series, sb: pd.Series, nb: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(sa), np.uint16).reshape(len(sa), REGISTERS)
        y = np.frombuffer(b"".join(sb), np.uint16).reshape(len(sb), REGISTERS)
        return pd.Series(may_reach(threshold, na.to_numpy(np.float64), nb.to_numpy(np.float64),
                                   (x > y).sum(axis=1), (x < y).sum(axis=1)))

    return both.where(likely("sketch_a", "n_a", "sketch_b", "n_b")).select("a", "b")


def _sets(cids: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``cid, s``: the sorted shingle hashes of each class, from the text of one of its documents."""
    need = cids.distinct().join(classes, "cid").select("cid", "rep.*").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))))
    # rows that repeat id and text are spread over salts before one of them is taken
    own = texts.withColumn("copy", F.pmod(F.monotonically_increasing_id(), F.lit(COPY_SALTS)).cast("int"))
    found = own.join(need, [ID_KEY, TEXT_KEY, "copy"]).groupBy("cid").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            sets = [s.view(np.int64) for block in shingles.of(batch.column("text").cast(pa.large_binary()).to_pylist())
                    for s in block]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.list_(pa.int64()))], ["cid", "s"])

    return materialize(found.mapInArrow(run, "cid bigint, s array<bigint>"), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough: 100 * shared >= percent * union."""
    both = _beside(_beside(pairs, "a", sets, {"s": "sa"}), "b", sets, {"s": "sb"})
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _cells(buckets: DataFrame, block: int) -> DataFrame:
    """Rows (bucket, cid, root, n_shingles) of buckets with several components, dealt to cells (bucket, lo, hi).

    Buckets with the same classes count once. A bucket is cut into blocks, bounded by classes and by
    shingles; a cell is a pair of blocks, so that no bucket has to fit a task.
    """
    several = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("size"),
        F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("of"),
        F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    one = several.groupBy("n", "size", "of").agg(F.min("bucket").alias("bucket")).select(
        "bucket", F.ceil(F.greatest(F.col("n") / block, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return (buckets.join(one, "bucket")
            .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
                    "cid", "root", "n_shingles"))


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks of a cell (one block twice, where the cell is a block with itself)."""
    return pdf[pdf["block"] == pdf["lo"].iloc[0]], pdf[pdf["block"] == pdf["hi"].iloc[0]]


def _with_partner(buckets: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """The rows of ``buckets`` to which the likelihood leaves a partner in another component of the bucket."""
    rows = _cells(buckets, block).join(classes.select("cid", "sketch"), "cid")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _sides(pdf)
        rx, ry = (np.frombuffer(b"".join(z["sketch"]), np.uint16).reshape(len(z), REGISTERS) for z in (x, y))
        nx, ny = (z["n_shingles"].to_numpy(np.float64) for z in (x, y))
        ox, oy = x["root"].to_numpy(), y["root"].to_numpy()
        has_x, has_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        wait: list[tuple[np.ndarray, ...]] = []

        def judge() -> None:     # many pairs at once: the likelihood's steps cost the same for one
            i, k, greater, less = (np.concatenate(z) for z in zip(*wait))
            ok = may_reach(threshold, nx[i], ny[k], greater, less)
            has_x[i[ok]] = has_y[k[ok]] = True
            wait.clear()

        for i in range(len(x)):
            k = np.flatnonzero((oy != ox[i]) & (np.minimum(ny, nx[i]) >= (threshold - 1e-9) * np.maximum(ny, nx[i])))
            wait.append((np.full(len(k), i), k, (rx[i] > ry[k]).sum(axis=1), (rx[i] < ry[k]).sum(axis=1)))
            if len(wait) * len(y) > PAIRS_AT_ONCE:
                judge()
        if wait:
            judge()
        return pd.concat((x[has_x], y[has_y]))[["bucket", "cid", "root", "n_shingles"]]

    return rows.groupBy("bucket", "lo", "hi").applyInPandas(
        compare, "bucket bigint, cid bigint, root bigint, n_shingles bigint").distinct()


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """How many elements each set of ``x`` shares with each of ``y``."""
    def owners(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (ex, ix), (ey, iy) = owners(x), owners(y)
    common = np.intersect1d(ex, ey)
    kx, ky = np.isin(ex, common), np.isin(ey, common)
    cx, ix = np.searchsorted(common, ex[kx]), ix[kx]
    cy, iy = np.searchsorted(common, ey[ky]), iy[ky]
    out = np.zeros((len(x), len(y)), np.int64)
    ax, ay = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
    cx, ix, cy, iy = cx[ax], ix[ax], cy[ay], iy[ay]
    for lo in range(0, len(common), at_once):
        width = min(at_once, len(common) - lo)
        parts = []
        for c, i, n in ((cx, ix, len(x)), (cy, iy, len(y))):
            s = slice(*np.searchsorted(c, (lo, lo + width)))
            m = np.zeros((n, width), np.float32)       # sums stay below 2^24: exact
            m[i[s], c[s] - lo] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _verified_within(buckets: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components within buckets, on full sets: a spanning forest of each cell's links."""
    rows = _cells(buckets, block).join(sets, "cid")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _sides(pdf)
        shared = shared_counts(x["s"].tolist(), y["s"].tolist())
        union = x["n_shingles"].to_numpy()[:, None] + y["n_shingles"].to_numpy()[None, :] - shared
        linked = (100 * shared >= percent * union) & (x["root"].to_numpy()[:, None] != y["root"].to_numpy()[None, :])
        i, j = np.nonzero(linked)
        a, b = stars(x["cid"].to_numpy()[i], y["cid"].to_numpy()[j])
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 85, block: int = BLOCK_CLASSES) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * shared >= percent * union`` for their sets of distinct shingles of
    ``shingle`` words (A-Z lowered, words part at space and tab to carriage return; of fewer words the
    whole sequence is one shingle). component_id is the smallest id reachable over links, kept whether
    a row has it. Documents without words, or without text, have an empty set and are linked with nothing:
    each is its own component. Null ids never name a component unless it has no other id (then it is null and kept);
    repeated rows each get their row. Shingles are compared as 64-bit hashes, sets of a class as 128-bit digests.
    """
    threshold = percent / 100
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.select("doc_id", "text", *row_keys(F.col("doc_id"), F.col("text")))
    signed = materialize(_signatures(d, shingle), "signatures")
    classes = materialize(
        signed.where("n_shingles > 0").groupBy("k1", "k2").agg(
            F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"),
            F.min(F.struct(ID_KEY, TEXT_KEY)).alias("rep")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    texts = d.select(ID_KEY, TEXT_KEY, "text")

    buckets = _buckets(classes)
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("a"),
                                                       F.max("cid").alias("b")).where("n > 1"), "shared-buckets")
    # the classes of buckets with three or more; of two, both are known already
    wide = materialize(buckets.join(shared.where("n > 2").select("bucket", "a"), "bucket").select("bucket", "a", "cid"),
                       "wide-buckets")
    first = shared.where("n = 2").select("a", "b").union(
        wide.where("cid <> a").select("a", F.col("cid").alias("b"))).distinct()
    likely = materialize(_likely(materialize(first, "first-pairs"), classes, threshold), "likely-pairs")
    sets = _sets(likely.select(F.explode(F.array("a", "b")).alias("cid")), classes, texts, shingle)
    links = materialize(_verified(likely, sets, percent), "links")
    roots = materialize(connected(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
    # the bucket's first class has met all others: what is left are the others among themselves
    rest = (wide.where("cid <> a").join(roots, F.col("cid") == F.col("node"), "left")
            .join(classes.select("cid", "n_shingles"), "cid")
            .select("bucket", "cid", F.coalesce("root", "cid").alias("root"), "n_shingles"))
    open_ = materialize(_with_partner(materialize(rest, "rest"), classes, threshold, block), "open-buckets")
    if not open_.isEmpty():
        sets = _sets(open_.select("cid"), classes, texts, shingle)
        more = _verified_within(open_, sets, percent, block)
        every = links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = materialize(connected(every), "roots")
    of_class = classes.join(roots, F.col("cid") == F.col("node"), "left").select(
        "k1", "k2", "least_id", F.coalesce("root", "cid").alias("root"))
    named = of_class.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = materialize(of_class.join(named, "root").select("k1", "k2", "component_id"), "class-components")
    own = signed.where("n_shingles > 0").join(of_class, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

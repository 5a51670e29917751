"""Sharding by extendible hashing, in DataFrame operations only.

A document's place is its hash; the directory is indexed by prefix bits of it. A bucket over the
byte limit splits on its next bit, others don't. Sizes are summed in cells of CELL_BITS more
prefix bits at a time, and all splits inside those bits follow from the cell sizes; only cells that
are too large themselves are looked at again with the bits that follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import ID_KEY, TEXT_KEY, pick, row_keys
from scrubspark.session import materialize

HASH_BITS = 60   # 15 hexadecimal digits of an MD5
CELL_BITS = 12
SLICE_BITS = 12   # of the text key, by which documents of one hash are summed


def hash_column(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text (a null id: of empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - F.lit(depth) if isinstance(depth, int)
                                             else F.lit(HASH_BITS) - depth).cast("int"))


def directory(sizes: DataFrame, max_bytes: int) -> DataFrame:
    """``depth, bucket, bucket_bytes, bucket_docs`` of the buckets for ``sizes (h, n_bytes)``.

    A bucket is a prefix of ``depth`` bits whose bytes fit the limit while those of its parent
    don't. Prefixes of all 60 bits are buckets whatever their size (one document over the limit,
    or documents of the same hash).
    """
    open_, at, found = sizes.select("h", "n_bytes"), 0, []
    while True:
        deep = min(at + CELL_BITS, HASH_BITS)
        cells = open_.groupBy(prefix(F.col("h"), deep).alias("p")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        levels = cells.select(F.explode(F.sequence(F.lit(at), F.lit(deep))).alias("depth"), "p", "b", "n").select(
            "depth", F.call_function("shiftright", "p", (F.lit(deep) - F.col("depth")).cast("int")).alias("bucket"),
            "b", "n").groupBy("depth", "bucket").agg(F.sum("b").alias("bucket_bytes"), F.sum("n").alias("bucket_docs"))
        levels = materialize(levels, "levels")
        parent = levels.select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("up"),
                               (F.col("bucket_bytes") > max_bytes).alias("split"))
        marked = levels.withColumn("up", F.shiftright("bucket", 1)).join(parent, ["depth", "up"], "left")
        reached = (F.col("depth") == at) | F.col("split")
        fits = (F.col("bucket_bytes") <= max_bytes) | (F.col("depth") == HASH_BITS)
        found.append(marked.where(reached & fits).select("depth", "bucket", "bucket_bytes", "bucket_docs"))
        large = levels.where((F.col("depth") == deep) & (F.col("bucket_bytes") > max_bytes)).select("bucket")
        if deep == HASH_BITS or large.isEmpty():
            break
        # the next round's root buckets are those cells themselves, already known to be too large
        open_ = open_.join(large, prefix(F.col("h"), deep) == F.col("bucket"), "left_semi")
        at = deep
    return reduce(DataFrame.union, found)


def assign(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shard, depth, n_bytes, shard_bytes, fits`` for each row of ``docs``, and its row key.

    ``shard`` is the bucket's prefix as a string of 0 and 1 (of no bits: one shard for all), and
    ``n_bytes`` the text's UTF-8 size (null: 0). Documents that share all hash bits (the same id,
    or none) and don't fit together are dealt into numbered parts ``prefix-part`` in order of
    their text's key; a document over the limit alone is a shard, or part, with ``fits`` false.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    sized = materialize(d.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")),
                                 hash_column(F.col("doc_id")).alias("h"),
                                 F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "sized")
    buckets = materialize(directory(sized, max_bytes), "directory")
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect()) or [0]  # at most 61 numbers
    prefixes = F.array(*[F.struct(F.lit(k).alias("depth"), prefix(F.col("h"), k).alias("bucket")) for k in depths])
    # a hash lies in one bucket: the deepest cell's prefix finds it among the prefixes of all depths in use
    placed = (sized.withColumn("at", F.explode(prefixes))
              .select("doc_id", ID_KEY, TEXT_KEY, "n_bytes", "at.depth", "at.bucket")
              .join(buckets, ["depth", "bucket"]))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    whole = placed.where((F.col("bucket_bytes") <= max_bytes) | (F.col("bucket_docs") == 1)).select(
        "doc_id", bits.alias("shard"), "depth", "n_bytes", F.col("bucket_bytes").alias("shard_bytes"),
        (F.col("bucket_bytes") <= max_bytes).alias("fits"), ID_KEY, TEXT_KEY)
    if HASH_BITS not in depths:
        return whole
    # one hash for all rows of such a bucket: parts by half-limit steps, a row over half the limit alone; the
    # running sums are those of slices of the text key, then those inside a slice, so that no task sorts a bucket
    half = max(max_bytes // 2, 1)
    over = placed.where((F.col("bucket_bytes") > max_bytes) & (F.col("bucket_docs") > 1)).withColumn(
        "big", F.col("n_bytes") > half).withColumn("slice", F.shiftright(TEXT_KEY, 64 - SLICE_BITS)).withColumn(
        "step", F.when(F.col("big"), F.lit(half)).otherwise(F.col("n_bytes")))
    slices = over.groupBy("bucket", "big", "slice").agg(F.sum("step").alias("bytes"), F.count("*").alias("docs"))
    earlier = Window.partitionBy("bucket").orderBy("big", "slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = materialize(slices.select("bucket", "big", "slice", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "docs")]), "slices")
    w = Window.partitionBy("bucket", "big", "slice").orderBy(TEXT_KEY, "n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    stepped = over.join(slices, ["bucket", "big", "slice"]).withColumn(
        "run", F.col("bytes_before") + F.sum("step").over(w)).withColumn("no", F.col("docs_before") + F.count("*").over(w))
    part = F.when(F.col("big"), F.concat(F.lit("-x"), F.col("no"))).otherwise(
        F.concat(F.lit("-"), F.floor((F.greatest("run", F.lit(1)) - 1) / F.lit(half)).cast("string")))
    cut = stepped.select("doc_id", F.concat(bits, part).alias("shard"), "depth", "n_bytes", ID_KEY, TEXT_KEY)
    total = cut.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return whole.unionByName(cut.join(total, "shard").withColumn("fits", F.col("shard_bytes") <= max_bytes))


def shard(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a ``shard`` column more (``shard_2`` and so on if there is one already).

    Rows that repeat id and text go to one shard.
    """
    cols = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    flat = flat.select("*", *row_keys(F.col(f"_c{cols.index(id_col)}"), F.col(f"_c{cols.index(text_col)}")))
    of = assign(docs, max_bytes, id_col, text_col).groupBy(ID_KEY, TEXT_KEY).agg(F.min("shard").alias("s"))
    name, k = "shard", 1
    while name.lower() in [c.lower() for c in cols]:
        k += 1
        name = f"shard_{k}"
    return flat.join(of, [ID_KEY, TEXT_KEY]).drop(ID_KEY, TEXT_KEY).toDF(*cols, name)

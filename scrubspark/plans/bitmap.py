"""A bitmap of hashes: a set of fixed size that rows are tested against before a shuffle.

It may let through rows that aren't in the set, never leaves out one that is; an exact step follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25      # 4 MB, however many hashes


def in_bitmap(hash_: Column, hashes: DataFrame, n: int) -> Column:
    """Whether a 64-bit hash may be among the ``n`` ``hashes`` (one column): no if its bit isn't set in their bitmap.

    The bitmap is a one-row subquery, an array of words built in Spark, eight bits for each hash up to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(bits))
    words = (hashes.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("id"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int")))
                  .alias("v")))
    every = hashes.sparkSession.range(0, bits // 64, 1, 1).join(words, "id", "left")
    # one row of fixed size: the words in order
    bitmap = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
                       .getField("v").alias("bitmap")).scalar()
    at = F.pmod(hash_, F.lit(bits)).cast("int")
    return F.call_function("shiftright", F.get(bitmap, F.shiftright(at, 6)), at.bitwiseAND(63)).bitwiseAND(
        F.lit(1).cast("long")) == 1

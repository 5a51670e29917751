"""Order-dependent work on an unordered engine: distributed (segmented) prefix sums.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task, and a
window partitioned by a hot key moves that key's rows into one task. ``prefix_sums``
computes the same running totals with every task bounded:

1. ``repartitionByRange`` on (segment, order) splits the ordered sequence into ``P``
   contiguous ranges (a hot segment spans several ranges), sorted within each range;
2. one ``mapInPandas`` pass computes running totals inside each range;
3. the result is written as a Parquet table under the shared checkpoint folder, so the
   sampled range bounds and the local totals are fixed once and lineage is cut (an executor
   lost later re-reads the table instead of re-running the range shuffle);
4. a per-range summary (``P`` rows: first segment, last segment, last segment's total)
   gives each range the carry-in from earlier ranges with a window over those ``P`` rows;
5. the carry table, bounded by ``P``, is broadcast back on the range id.

A range's total is that of the row scanned last (rows are numbered within their range), so
rows that tie on the sort keys can't change it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import qcol
from scrubspark.session import scratch_path

PID = "__pid"
NO = "__no"


def _local_scan(seg_cols: list[str], sum_cols: list[str]):
    """Per range: exclusive running totals within each segment, carried across Arrow batches."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key = None
        running = None
        scanned = 0
        for pdf in batches:
            if pdf.empty:
                continue
            n = len(pdf)
            if seg_cols:
                keys = pdf[seg_cols].to_numpy(dtype=object)
                prev = np.empty_like(keys)
                prev[1:] = keys[:-1]
                if last_key is not None:
                    prev[0] = last_key
                # a missing key (None, or NaN after Arrow) equals a missing key
                same = (keys == prev) | (pd.isna(keys) & pd.isna(prev))
                change = ~same.all(axis=1)
                if last_key is None:
                    change[0] = True
                seg_id = np.cumsum(change)
                last_key = keys[-1].copy()
            else:
                change = np.zeros(n, dtype=bool)
                if last_key is None:
                    change[0] = True
                seg_id = np.cumsum(change)
                last_key = np.array([0])
            continues = not change[0]
            for c in sum_cols:
                v = pdf[c].to_numpy()
                incl = pd.Series(v).groupby(seg_id).cumsum().to_numpy()
                excl = incl - v
                if continues and running is not None:
                    first = seg_id == seg_id[0]
                    excl = np.where(first, excl + running[c], excl)
                pdf[c + "_before"] = excl
            # running total of the last segment, carried into the next batch
            running = {c: (pdf[c + "_before"].to_numpy()[-1] + pdf[c].to_numpy()[-1]) for c in sum_cols}
            pdf[PID] = np.int32(pid)
            pdf[NO] = np.arange(scanned, scanned + n, dtype=np.int64)
            scanned += n
            yield pdf

    return run


def prefix_sums(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str],
                segment_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over earlier rows of the same segment in order.

    ``sum_cols`` must be non-null numbers; a null segment key is one segment; rows that tie
    on (segment, order) get an arbitrary but fixed order among themselves.
    """
    spark = df.sparkSession
    seg, order, sums = list(segment_cols), list(order_cols), list(sum_cols)
    keys = [F.col(qcol(k)) for k in seg + order]
    # Without an explicit count AQE may coalesce adjacent ranges, which keeps them contiguous.
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys))
    ranged = ranged.sortWithinPartitions(*keys)
    fields = list(df.schema.fields)
    for c in sums:
        fields.append(T.StructField(c + "_before", df.schema[c].dataType, True))
    fields.append(T.StructField(PID, T.IntegerType(), False))
    fields.append(T.StructField(NO, T.LongType(), False))
    path = scratch_path(spark, "prefix")
    ranged.mapInPandas(_local_scan(seg, sums), T.StructType(fields)).write.parquet(path)
    local = spark.read.parquet(path)

    key_struct = F.struct(*keys)
    last_vals = F.struct(*[(F.col(qcol(c + "_before")) + F.col(qcol(c))).alias(c) for c in sums])
    seg_struct = (lambda s: F.struct(*[s[k] for k in seg])) if seg else (lambda s: F.lit(0))
    summary = local.groupBy(PID).agg(F.min(key_struct).alias("first"), F.max(key_struct).alias("last"),
                                     F.max_by(last_vals, NO).alias("tot"))
    summary = summary.select(PID, seg_struct(F.col("first")).alias("first_seg"),
                             seg_struct(F.col("last")).alias("last_seg"), "tot")
    by_seg = Window.partitionBy("last_seg").orderBy(PID).rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.select(PID, "first_seg", "last_seg",
                             *[F.sum(F.col(f"tot.{qcol(c)}")).over(by_seg).alias(f"cum_{i}") for i, c in enumerate(sums)])
    prev = Window.orderBy(PID)  # over the P-row summary only
    carry = summary.select(
        PID, "first_seg",
        *[F.when(F.lag("last_seg").over(prev) == F.col("first_seg"), F.lag(f"cum_{i}").over(prev))
          .otherwise(F.lit(0)).alias(f"carry_{i}") for i in range(len(sums))])
    joined = local.join(F.broadcast(carry), PID)
    seg_now = seg_struct(F.struct(*[F.col(qcol(k)) for k in seg])) if seg else F.lit(0)
    out_cols = [F.col(qcol(c)) for c in df.columns]
    for i, c in enumerate(sums):
        add = F.when(seg_now == F.col("first_seg"), F.col(f"carry_{i}")).otherwise(F.lit(0))
        out_cols.append((F.col(qcol(c + "_before")) + add).cast(df.schema[c].dataType).alias(c + "_before"))
    return joined.select(*out_cols)


def positions(df: DataFrame, order_cols: Sequence[str], name: str = "position",
              num_partitions: int | None = None) -> DataFrame:
    """0-based dense position of each row in ``order_cols`` order."""
    one = "__one"
    out = prefix_sums(df.withColumn(one, F.lit(1).cast("long")), order_cols, [one], num_partitions=num_partitions)
    return out.withColumnRenamed(one + "_before", name).drop(one)

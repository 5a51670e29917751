"""Column profiles as states that merge: after an append only the new files are read.

A state holds what a report needs of one column in one part of a table (one file): counts, central moments up to the
fourth, bounds, and sketches of the distinct values, the quantiles and the frequent values. States of parts
merge to the state of their union, whatever the parts are, so a table's report comes from the states
of its files (``update_states``, ``current_states``, ``summarise``).

Exact after merging: rows, nulls, min, max, datetime bounds and (up to rounding) mean, std, skewness, kurtosis.
From sketches: distinct counts (standard error ``1.04 / 2**(DISTINCT_LG / 2)``, 0.8 %, exact for some tens of values), quantiles
(rank error about ``2.3 / QUANTILE_K**0.97``, 0.35 %, at odds of 99 in 100) and top values, exact while ``top_exact``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import field_type, is_datetime, is_floating, is_integral, is_numeric, qcol
from scrubspark.functions.parse import nan_to_null, text_form
from scrubspark.operators.reports import COLUMNS_PER_AGGREGATE

#: Log2 of the registers for distinct values: 16 KB a state at most.
DISTINCT_LG = 14
#: Size of the quantile sketch: about 20 KB a state at most.
QUANTILE_K = 800
#: Values of a text column that a state keeps count of.
TOP_TRACKED = 1024
#: The frequent-value sketch counts exactly until it is filled to this share.
TOP_FILLED = 0.75
#: A text longer than this is tracked by its first characters and a hash, so that a state is bounded.
TOP_CHARS = 64

FILE = ("path", "size", "modified")


def _numeric(dt: T.DataType) -> bool:
    return is_numeric(dt) or isinstance(dt, T.BooleanType)


def _wall_clock(v: Column, dt: T.DataType) -> Column:
    """A datetime without a zone; one with a zone in UTC, so that it depends on no session."""
    if not isinstance(dt, T.TimestampType):
        return v.cast("timestamp_ntz")
    seconds = (F.unix_micros(v).cast("decimal(20,0)") * F.expr("0.000001BD")).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def _hashed(v: Column, dt: T.DataType) -> Column:
    """64 bits of a value, null for a missing one; whole numbers of all widths alike, 0.0 and -0.0 too."""
    if is_integral(dt):
        v = v.cast("long")
    elif is_floating(dt):
        v = nan_to_null(v, dt).cast("double") + F.lit(0.0)
    return F.when(v.isNotNull(), F.xxhash64(v))


def _tracked(v: Column, dt: T.DataType) -> Column:
    text = text_form(v, dt)
    short = F.concat(F.substring(text, 1, TOP_CHARS), F.lit("…"), F.lower(F.hex(F.xxhash64(text))))
    return F.when(F.length(text) <= TOP_CHARS, text).when(text.isNotNull(), short)


def _aggregates(v: Column, dt: T.DataType, i: int) -> list[Column]:
    """What is aggregated of column ``i``, under names that end in it."""
    out = [F.hll_sketch_agg(_hashed(v, dt), F.lit(DISTINCT_LG)).alias(f"distinct{i}")]
    if _numeric(dt):
        d = nan_to_null(v, dt).cast("double")
        return out + [F.count(d).alias(f"n{i}"), F.min(d).alias(f"min{i}"), F.max(d).alias(f"max{i}"),
                      F.avg(d).alias(f"mean{i}"), F.var_pop(d).alias(f"var{i}"), F.skewness(d).alias(f"skew{i}"),
                      F.kurtosis(d).alias(f"kurt{i}"),
                      F.call_function("kll_sketch_agg_double", d, F.lit(QUANTILE_K)).alias(f"quantiles{i}")]
    out.append(F.count(v).alias(f"n{i}"))
    if is_datetime(dt):
        clock = _wall_clock(v, dt)
        return out + [F.min(clock).alias(f"dt_min{i}"), F.max(clock).alias(f"dt_max{i}")]
    return out + [F.call_function("approx_top_k_accumulate", _tracked(v, dt), F.lit(TOP_TRACKED)).alias(f"top{i}")]


_TOP_TYPE = "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"


def _state(dt: T.DataType, name: str, i: int) -> Column:
    """The state of column ``i`` over its aggregates."""
    numeric = _numeric(dt)

    def agg(label: str, there: bool, kind: str) -> Column:
        return (F.col(f"{label}{i}") if there else F.lit(None)).cast(kind).alias(label)

    n, var = F.col(f"n{i}"), F.col(f"var{i}")
    if numeric:     # sums of powers of the distance from the mean
        m2 = n * var
        m3 = F.when(var == 0, F.lit(0.0)).otherwise(F.col(f"skew{i}") * n * F.pow(var, F.lit(1.5)))
        m4 = F.when(var == 0, F.lit(0.0)).otherwise((F.col(f"kurt{i}") + 3) * n * var * var)
    else:
        m2 = m3 = m4 = F.lit(None).cast("double")
    return F.struct(
        F.lit(i).alias("ordinal"), F.lit(name).alias("column"), F.lit(dt.simpleString()).alias("dtype"),
        F.col("rows"), n.alias("n"), agg("min", numeric, "double"), agg("max", numeric, "double"),
        agg("mean", numeric, "double"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"),
        agg("dt_min", is_datetime(dt), "timestamp_ntz"), agg("dt_max", is_datetime(dt), "timestamp_ntz"),
        agg("distinct", True, "binary"), agg("quantiles", numeric, "binary"),
        agg("top", not numeric and not is_datetime(dt), _TOP_TYPE))


def column_states(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """One row per part and column: the ``parts`` columns (expressions over ``df``) and the state.

    A part's rows are aggregated where they are read; one state per task and part is shuffled. One aggregate takes
    16 columns, each reads its own columns only. Parts without rows have no states.
    """
    names, types = df.columns, [f.dataType for f in df.schema.fields]
    keys = list(parts)
    out = None
    for start in range(0, len(names), COLUMNS_PER_AGGREGATE):
        chunk = range(start, min(start + COLUMNS_PER_AGGREGATE, len(names)))
        flat = df.select(*[parts[k].alias(f"_p{j}") for j, k in enumerate(keys)],
                         *[F.col(qcol(names[i])).alias(f"_c{i}") for i in chunk])
        aggs = [a for i in chunk for a in _aggregates(F.col(f"_c{i}"), types[i], i)]
        wide = flat.groupBy(*[f"_p{j}" for j in range(len(keys))]).agg(F.count(F.lit(1)).alias("rows"), *aggs)
        states = F.explode(F.array(*[_state(types[i], names[i], i) for i in chunk])).alias("s")
        one = wide.select(*[F.col(f"_p{j}").alias(k) for j, k in enumerate(keys)], states).select(*keys, "s.*")
        out = one if out is None else out.unionByName(one)
    return out


# --- states beside a Parquet table ----------------------------------------------------

def _files(spark: SparkSession, table: str) -> DataFrame:
    """``location`` (to read it by) and ``path, size, modified`` of the table's files; no file is opened."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.parquet").load(table))
    return listing.select(F.col("path").alias("location"), F.col("_metadata.file_path").alias("path"),
                          F.col("_metadata.file_size").alias("size"),
                          F.col("_metadata.file_modification_time").alias("modified"))


def _stored(spark: SparkSession, states: str) -> DataFrame | None:
    try:
        return spark.read.parquet(states)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_states(spark: SparkSession, table: str, states: str) -> int:
    """Add the states of those files of the Parquet table that have none yet; returns how many files were read.

    A file is known by path, size and time of change, so one that was written anew counts as new. States are only
    appended, by Spark's commit protocol: a lost job leaves none. Two updates at once may both add a file's
    states; ``current_states`` takes one of them. The paths of the new files go through the driver, as in
    any Spark read.
    """
    files, known = _files(spark, table), _stored(spark, states)
    if known is not None:
        files = files.join(known.select(*FILE).distinct(), list(FILE), "left_anti")
    new = [r["location"] for r in files.select("location").collect()]
    if new:
        df = spark.read.option("basePath", table).option("mergeSchema", "true").parquet(*new)
        identity = dict(zip(FILE, (F.col("_metadata.file_path"), F.col("_metadata.file_size"),
                                   F.col("_metadata.file_modification_time"))))
        (column_states(df, identity).withColumn("batch", F.lit(uuid.uuid4().hex))
         .write.mode("append").parquet(states))
    return len(new)


def current_states(spark: SparkSession, table: str, states: str) -> DataFrame:
    """The states of the files that the table has now, each file's once; files gone or rewritten don't count."""
    known = _stored(spark, states)
    if known is None:
        raise ValueError(f"no states at {states}: update them first")
    one = known.groupBy(*FILE).agg(F.min("batch").alias("batch"))
    return known.join(one.join(_files(spark, table).select(*FILE), list(FILE), "left_semi"), [*FILE, "batch"], "left_semi")


# --- reports from states --------------------------------------------------------------

def summarise(states: DataFrame, parts: Sequence[str] = FILE, max_categories: int = 5,
              quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column from the states of all parts: what ``reports.column_summary`` and ``profile_column`` say.

    ``rows, null_count, null_pct, unique_count, quality_score``; ``min, max, mean, std`` (4 dp), ``skewness,
    kurtosis`` (3 dp) and ``quantiles`` of numbers and booleans; ``dt_min, dt_max`` as text; ``top_categories`` of the rest,
    with ``top_exact`` false once a part may have had more values than its sketch keeps. A column that some parts lack is null in
    their rows. A column that came in several types names them all (``int|bigint``). No states: no rows.
    """
    total = states.groupBy(*parts).agg(F.max("rows").alias("rows")).agg(F.sum("rows").alias("rows"))
    centre = states.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(
        F.col("mean").isNotNull(), F.col("n")))).alias("centre"))
    s = states.join(centre, "column")
    n, d = F.col("n"), F.col("mean") - F.col("centre")
    m2, m3, m4 = (F.col(c) for c in ("m2", "m3", "m4"))
    merged = s.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.array_join(F.array_sort(F.collect_set("dtype")), "|").alias("dtype"),
        F.sum("n").alias("n"), F.sum(F.when(m2.isNotNull(), n)).alias("nn"), F.first("centre").alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        # moments about the mean of all, from those about each part's own mean
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("dt_min").alias("dt_min"), F.max("dt_max").alias("dt_max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct", F.lit(True))).alias("unique_count"),
        F.call_function("kll_merge_agg_double", F.col("quantiles")).alias("quantiles"))
    # apart from the rest: these sketches take no nulls
    frequent = states.where(F.col("top").isNotNull()).groupBy("column").agg(
        F.call_function("approx_top_k_combine", F.col("top"), F.lit(TOP_TRACKED)).alias("top"))
    rows = total.scalar()
    nn, var = F.col("nn").cast("double"), F.col("m2") / F.col("nn")
    skew = (F.when(nn < 3, F.lit(None)).when(var == 0, F.lit(0.0))
            .otherwise(F.col("m3") / nn / F.pow(var, F.lit(1.5)) * F.sqrt(nn * (nn - 1)) / (nn - 2)))
    excess = F.col("m4") / nn / (var * var) - 3
    kurt = (F.when(nn < 4, F.lit(None)).when(var == 0, F.lit(0.0))
            .otherwise(((nn + 1) * excess + 6) * (nn - 1) / ((nn - 2) * (nn - 3))))
    nulls = F.col("rows") - F.col("n")
    pct = F.when(F.col("rows") > 0, F.round(nulls * 100.0 / F.col("rows"), 2)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.round(100.0 - pct - F.when(F.col("unique_count") == 1, 20.0).otherwise(0.0), 1))
    at = F.when(F.col("nn") > 0, F.array(*[F.call_function("kll_sketch_get_quantile_double", F.col("quantiles"),
                                                           F.lit(float(q))) for q in quantiles]))
    held = F.filter(F.col("held"), lambda x: x["item"].isNotNull())
    order = F.array_sort(F.transform(held, lambda x: F.struct((-x["count"]).alias("m"), x["item"].alias("value"))))
    tops = F.when((F.size(order) > 0) & F.lit(max_categories > 0), F.transform(
        F.slice(order, 1, max(max_categories, 1)), lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("n"))))
    frequent = frequent.select("column", F.call_function("approx_top_k_estimate", F.col("top"), F.lit(TOP_TRACKED)).alias("held"))
    return merged.join(frequent, "column", "left").withColumn("rows", rows).select(
        "ordinal", "column", "dtype", "rows", nulls.alias("null_count"), pct.alias("null_pct"), "unique_count",
        score.alias("quality_score"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("min", "max", "mean")],
        F.when(nn > 1, F.round(F.sqrt(F.col("m2") / (nn - 1)), 4)).alias("std"), (F.round(skew, 3) + F.lit(0.0)).alias("skewness"),
        (F.round(kurt, 3) + F.lit(0.0)).alias("kurtosis"), at.alias("quantiles"), F.col("dt_min").cast("string").alias("dt_min"),
        F.col("dt_max").cast("string").alias("dt_max"), tops.alias("top_categories"),
        F.when(F.col("held").isNotNull(), F.col("unique_count") * 1.05 <= TOP_FILLED * TOP_TRACKED).alias("top_exact"))

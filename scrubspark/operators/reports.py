"""Read-only quality reports. Each returns a DataFrame with typed columns (not a string).

Shared plan shapes:
* wide aggregates for null counts and moments (one per 16 columns, so generated code stays
  small; with Parquet each reads only its columns);
* one value-frequency aggregate for each family of types over the table unpivoted to (column, value) gives exact
  distinct counts; texts are counted by a 128-bit hash and only the first few are looked up (``_text_tops``);
* exact quantiles through the bounded two-pass fit in ``functions.stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import (field_type, is_datetime, is_floating, is_integral, is_numeric, qcol, resolve_column,
                                  resolve_columns)
from scrubspark.functions import stats
from scrubspark.functions.parse import missing, nan_to_null, text_form
from scrubspark.plans.bitmap import in_bitmap
from scrubspark.plans.runs import flagged_runs
from scrubspark.session import materialize
from scrubspark.sources.parquet import ORDER_COLUMNS, file_order


def _kind(dt: T.DataType) -> str:
    if is_numeric(dt) or isinstance(dt, T.BooleanType):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    return "text"


def _num(df: DataFrame, c: str) -> Column:
    dt = field_type(df, c)
    return nan_to_null(F.col(qcol(c)), dt).cast("double")


def _stack(rows: list[Column]) -> Column:
    return F.explode(F.array(*rows))


def _value_text(df: DataFrame, c: str) -> Column:
    return text_form(F.col(qcol(c)), field_type(df, c))


def _value_double(df: DataFrame, c: str) -> Column:
    dt = field_type(df, c)
    col = F.col(qcol(c))
    if isinstance(dt, T.DateType):
        return F.unix_date(col).cast("double")
    if is_datetime(dt):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return nan_to_null(col, dt).cast("double")


# --- whole-table metadata (shape + per-column summary) --------------------------------

def row_fingerprint(df: DataFrame) -> Column:
    """64 bits of a row; equal rows (nulls equal, 0.0 and -0.0, all NaN) have equal ones."""
    parts = []
    for f in df.schema.fields:
        v = F.col(qcol(f.name))
        if is_floating(f.dataType):
            v = F.when(F.isnan(v), F.lit(float("nan"))).otherwise(v + F.lit(0.0))
        parts += [v, v.isNull()]      # a hash passes over nulls: which they are counts, too
    return F.xxhash64(*parts)


def table_shape(df: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """n_rows, n_columns, duplicate_rows (rows equal to an earlier row on all columns).

    Fingerprints of 64 bits are counted (16 bytes a row are shuffled, not rows). Only rows whose fingerprint
    comes twice are compared in full: a bitmap of those fingerprints keeps the others from the shuffle."""
    cols = [F.col(qcol(c)) for c in df.columns]
    fp = row_fingerprint(df) if fingerprint is None else fingerprint
    counts = df.select(fp.alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(counts.groupBy(F.when(F.col("n") > 1, F.col("fp")).alias("fp")).agg(
        F.sum("n").alias("n"), F.lit(True).alias("any")), "row-fingerprints")
    rows = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    twice = twice.where(F.col("fp").isNotNull()).select("fp")
    again = F.lit(0).cast("long")
    n_twice = twice.count()
    if n_twice:
        same = df.where(in_bitmap(fp, twice, n_twice)).groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
        again = same.agg(F.sum(F.col("__n") - 1).cast("long")).scalar()
    return df.sparkSession.range(1).select(F.lit(rows).cast("long").alias("n_rows"),
                                           F.lit(len(df.columns)).alias("n_columns"),
                                           F.coalesce(again, F.lit(0).cast("long")).alias("duplicate_rows"))


COLUMNS_PER_AGGREGATE = 16


def _wide_rows(df: DataFrame, cols: Sequence[str], aggs_of, row_of) -> DataFrame:
    """Per-column report rows from wide aggregates over chunks of columns.

    ``aggs_of(i, c)`` gives the aggregates of column ``c`` (aliased with its index ``i``),
    ``row_of(i, c)`` the struct of its report row over those results and ``__rows``. A chunk
    of at most ``COLUMNS_PER_AGGREGATE`` columns keeps each aggregate small enough for
    whole-stage codegen; with Parquet each chunk reads only its own columns. The chunks'
    rows are unioned (no join between one-row results).
    """
    parts = []
    for start in range(0, len(cols), COLUMNS_PER_AGGREGATE):
        chunk = list(enumerate(cols))[start:start + COLUMNS_PER_AGGREGATE]
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i, c in chunk:
            aggs += aggs_of(i, c)
        wide = df.agg(*aggs)
        parts.append(wide.select(_stack([row_of(i, c) for i, c in chunk]).alias("r")).select("r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Characters of a text that go along with its hash; a longer text is looked up once it is among the first.
PREFIX = 64
#: Longer texts looked up by a broadcast of their hashes, at most; more are joined.
LOOKED_UP = 100_000


def _text_tops(df: DataFrame, texts: dict[int, Column], k: int) -> tuple[DataFrame, DataFrame]:
    """(i, unique_count) and (i, value, n, rank) of text columns, the ``k`` most frequent values, ties by value.

    Values are counted by a 128-bit hash, with their first ``PREFIX`` characters: no text goes through a
    shuffle. What may be among the first k by count and prefix is written; texts longer than that are then
    read from the rows whose hash is one of those.
    """
    long = df.select(_stack([F.struct(F.lit(i).alias("i"), v.alias("value")) for i, v in texts.items()]).alias("p")).select(
        "p.*").where(F.col("value").isNotNull())
    long = long.select("i", "value", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"))
    freq = long.select("i", "h1", "h2", F.substring("value", 1, PREFIX).alias("head"),
                       (F.length("value") > PREFIX).alias("cut")).groupBy("i", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("head").alias("head"), F.max("cut").alias("cut"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("h1", "long"), ("h2", "long"), ("head", "string"), ("cut", "boolean"))]
    # sum(signum(n)) reads n, so that both consumers of ``freq`` share one shuffle
    distinct = freq.groupBy("i").agg(F.sum(F.signum("n")).cast("long").alias("n"))
    if k <= 0:
        return distinct.select("i", F.col("n").alias("unique_count")), freq.where("false").select(
            "i", F.col("head").alias("value"), "n", F.lit(0).alias("rank"))
    by = Window.partitionBy("i").orderBy(F.col("n").desc(), F.col("head"))
    first = freq.withColumn("r", F.rank().over(by)).where(F.col("r") <= k).drop("r")     # with all that tie on the head
    both = materialize(distinct.select("i", "n", *none).unionByName(first), "value-counts")
    distinct = both.where("h1 is null").select("i", F.col("n").alias("unique_count"))
    first = both.where("h1 is not null")
    cut = first.where("cut").select("i", "h1", "h2")
    found = first.select("i", F.col("head").alias("value"), "n", "cut")
    n_cut = cut.count()
    if n_cut:
        keys = F.broadcast(cut) if n_cut <= LOOKED_UP else cut
        whole = long.join(keys, ["i", "h1", "h2"]).groupBy("i", "h1", "h2").agg(F.min("value").alias("value"))
        found = found.where("not cut").drop("cut").unionByName(
            first.where("cut").drop("head", "cut").join(whole, ["i", "h1", "h2"]).select("i", "value", "n"))
    by = Window.partitionBy("i").orderBy(F.col("n").desc(), F.col("value"))
    return distinct, found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "i", "value", "n", "rank")


def _distinct_and_tops(df: DataFrame, cols: Sequence[str], kinds: dict[str, str], k: int):
    """(column, unique_count) and (column, top array of (value, n)).

    One aggregate for each family of types, so that its keys are narrow: whole numbers (and decimals, by their
    digits) as longs, floats as doubles, datetimes without a zone as they are, texts by hash (``_text_tops``).
    """
    families: dict[str, list[tuple[int, Column]]] = {}
    for i, c in enumerate(cols):
        dt, v = field_type(df, c), F.col(qcol(c))
        if kinds[c] == "text":
            families.setdefault("text", []).append((i, _value_text(df, c)))
        elif isinstance(dt, (T.TimestampNTZType, T.DateType)):  # zone-free wall clock
            families.setdefault("time", []).append((i, v.cast("timestamp_ntz")))
        elif is_integral(dt):  # doubles would merge neighbours above 2^53
            families.setdefault("whole", []).append((i, v.cast("long")))
        elif isinstance(dt, T.DecimalType) and dt.precision <= 18:  # its digits, as a whole number
            families.setdefault("whole", []).append((i, (v * F.lit(10 ** dt.scale)).cast("long")))
        else:
            families.setdefault("float", []).append((i, _value_double(df, c)))
    parts, tops = [], None
    for family, members in families.items():
        if family == "text":
            unique, tops = _text_tops(df, dict(members), k)
            parts.append(unique)
            continue
        long = df.select(_stack([F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in members]).alias("p")).select("p.*")
        parts.append(long.where(F.col("v").isNotNull()).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("unique_count")))
    distinct = parts[0]
    for p in parts[1:]:
        distinct = distinct.unionByName(p)
    name = F.get(F.array(*[F.lit(c) for c in cols]), F.col("i")).alias("column")
    entry = "array<struct<value:string,n:bigint>>"
    if tops is None:
        tops = df.sparkSession.createDataFrame([], f"column string, top {entry}")
    else:
        tops = (tops.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
                .select(name, F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
                        .cast(entry).alias("top")))
    return distinct.select(name, "unique_count"), tops


#: Values that the approximate top categories keep count of, in each task and column.
TOP_TRACKED = 4096


def _approximate_top(value: Column, k: int) -> Column:
    """The ``k`` most frequent values with their counts, ties by value, from a sketch of bounded size."""
    # the sketch gives all it holds, null perhaps among them: which of tied values it prefers is open
    size = F.lit(max(TOP_TRACKED, k + 1))
    held = F.filter(F.call_function("approx_top_k", value, size, size), lambda x: x["item"].isNotNull())
    return F.slice(F.array_sort(F.transform(held, lambda x: F.struct(
        (-x["count"]).alias("m"), x["item"].alias("value")))), 1, k)


def _by_count(top: Column) -> Column:
    """Such values as (value, n); null if there are none."""
    return F.when(F.size(top) > 0, F.transform(top, lambda x: F.struct(
        x["value"].alias("value"), (-x["m"]).alias("n"))))


def column_summary(df: DataFrame, max_categories: int = 5, exact_distinct: bool = True) -> DataFrame:
    """One row per column: dtype, null_count, null_pct, unique_count; min/max/mean/std for
    numbers (4 dp); min/max as text for datetimes; top categories for the rest.

    ``exact_distinct=False`` leaves the value-frequency pass out: one scan without a shuffle of
    values, distinct counts and top categories from sketches (the latter exact up to about
    ``TOP_TRACKED`` distinct values of a column)."""
    cols = df.columns
    kinds = {c: _kind(field_type(df, c)) for c in cols}

    def aggs_of(i: int, c: str) -> list:
        out = [F.sum(missing(F.col(qcol(c)), field_type(df, c)).cast("long")).alias(f"nulls{i}")]
        if not exact_distinct:
            out.append(F.approx_count_distinct(F.col(qcol(c))).alias(f"uniq{i}"))
            if kinds[c] == "text" and max_categories > 0:
                out.append(_approximate_top(_value_text(df, c), max_categories).alias(f"top{i}"))
        if kinds[c] == "numeric":
            v = _num(df, c)
            out += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.avg(v).alias(f"mean{i}"),
                    F.stddev_samp(v).alias(f"std{i}")]
        elif kinds[c] == "datetime":
            out += [F.min(F.col(qcol(c))).cast("string").alias(f"dmin{i}"),
                    F.max(F.col(qcol(c))).cast("string").alias(f"dmax{i}")]
        return out

    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def row_of(i: int, c: str):
        return F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
            F.lit(field_type(df, c).simpleString()).alias("dtype"),
            F.col(f"nulls{i}").alias("null_count"),
            F.when(F.col("__rows") > 0, F.round(F.col(f"nulls{i}") * 100.0 / F.col("__rows"), 2))
            .otherwise(F.lit(0.0)).alias("null_pct"),
            (F.col(f"uniq{i}") if not exact_distinct else F.lit(None).cast("long")).alias("approx_unique"),
            *[(F.round(F.col(f"{s}{i}"), 4) if kinds[c] == "numeric" else none_d).alias(s)
              for s in ("min", "max", "mean", "std")],
            *[(F.col(f"d{s}{i}") if kinds[c] == "datetime" else none_s).alias(f"dt_{s}") for s in ("min", "max")],
            *([] if exact_distinct else [(_by_count(F.col(f"top{i}")) if kinds[c] == "text" and max_categories > 0
                                          else F.lit(None)).cast("array<struct<value:string,n:bigint>>").alias("top")]),
        )

    out = _wide_rows(df, cols, aggs_of, row_of)
    if exact_distinct:
        distinct, tops = _distinct_and_tops(df, cols, kinds, max_categories)
        out = out.join(distinct, "column", "left").join(tops, "column", "left")
    uniq = (F.coalesce("unique_count", F.lit(0).cast("long")) if exact_distinct else F.col("approx_unique"))
    return out.select("ordinal", "column", "dtype", "null_count", "null_pct", uniq.alias("unique_count"),
                      "min", "max", "mean", "std", "dt_min", "dt_max", F.col("top").alias("top_categories")
                      ).orderBy("ordinal")


# --- profile_column -------------------------------------------------------------------

def profile_column(df: DataFrame, column: str, top_n: int = 5,
                   accuracy: int = stats.DEFAULT_ACCURACY, exact: bool = True) -> DataFrame:
    """Rows, missing, unique and a quality score; numeric moments (3 dp, bias-corrected
    skewness and excess kurtosis as pandas gives them) or the top values."""
    c = resolve_column(df, column)
    dt = field_type(df, c)
    col = F.col(qcol(c))
    numeric = _kind(dt) == "numeric" and not isinstance(dt, T.BooleanType)
    base = [F.count(F.lit(1)).alias("rows"), F.sum(missing(col, dt).cast("long")).alias("missing")]
    median = None
    if numeric:
        base.append(F.count_distinct(nan_to_null(col, dt)).alias("unique"))
        v = _num(df, c)
        base += [F.min(v).alias("mn"), F.max(v).alias("mx"), F.avg(v).alias("mean_"),
                 F.stddev_samp(v).alias("std_"), F.count(v).alias("nn"), F.skewness(v).alias("g1"),
                 F.kurtosis(v).alias("g2"), F.var_pop(v).alias("m2")]
        median = stats.quantile(df, c, 0.5, accuracy, exact)
    a = df.agg(*base)
    if not numeric:     # values are counted by hash, not shuffled
        distinct, tops = _distinct_and_tops(df, [c], {c: "text"}, top_n)
        a = a.withColumn("unique", F.coalesce(distinct.select("unique_count").scalar(), F.lit(0).cast("long")))
    rows_, miss = F.col("rows"), F.col("missing")
    pct = F.when(rows_ > 0, F.round(miss * 100.0 / rows_, 2)).otherwise(F.lit(0.0))
    score = F.lit(100.0) - pct - F.when((rows_ > 0) & (F.col("unique") == 1), F.lit(20.0)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.round(score, 1))
    sel = [F.lit(c).alias("column"), F.lit(dt.simpleString()).alias("dtype"), rows_.alias("rows"),
           miss.alias("missing"), pct.alias("missing_pct"), F.col("unique"), score.alias("quality_score")]
    if numeric:
        n = F.col("nn").cast("double")
        flat = F.col("m2") == 0
        skew = (F.when(n < 3, F.lit(None)).when(flat, F.lit(0.0))
                .otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)))
        kurt = (F.when(n < 4, F.lit(None)).when(flat, F.lit(0.0))
                .otherwise(((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))))
        sel += [F.round("mn", 3).alias("min"), F.round("mx", 3).alias("max"), F.round("mean_", 3).alias("mean"),
                F.round(F.lit(median).cast("double"), 3).alias("median"), F.round("std_", 3).alias("std"),
                F.round(skew, 3).alias("skewness"), F.round(kurt, 3).alias("kurtosis")]
        return a.select(*sel)
    return a.select(*sel, tops.select("top").scalar().alias("top_values"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 5,
                    accuracy: int = stats.DEFAULT_ACCURACY, exact: bool = True) -> DataFrame:
    """``profile_column`` for many columns at once (all by default), one row per column.

    Wide aggregates (one per 16 columns) hold every count and moment, one batched fit gives
    every median (two passes however many columns), and one frequency shuffle gives distinct
    counts and top values: a whole-table profile costs a few passes, not several per column.
    """
    cols = resolve_columns(df, columns) if columns else list(df.columns)
    numeric = {c: _kind(field_type(df, c)) == "numeric" and not isinstance(field_type(df, c), T.BooleanType)
               for c in cols}
    kinds = {c: ("numeric" if numeric[c] else "text") for c in cols}
    num_cols = [c for c in cols if numeric[c]]
    medians = stats.fit(df, [(c, 0.5) for c in num_cols], [], accuracy, exact)[0] if num_cols else {}
    none = F.lit(None).cast("double")

    def aggs_of(i: int, c: str) -> list:
        out = [F.sum(missing(F.col(qcol(c)), field_type(df, c)).cast("long")).alias(f"miss{i}")]
        if numeric[c]:
            v = _num(df, c)
            # the sample std is derived from var_pop: every moment aggregate keeps its own
            # buffer, and fewer of them keep the aggregate inside whole-stage codegen
            out += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), F.avg(v).alias(f"avg{i}"),
                    F.count(v).alias(f"nn{i}"), F.skewness(v).alias(f"g1{i}"),
                    F.kurtosis(v).alias(f"g2{i}"), F.var_pop(v).alias(f"m2{i}")]
        return out

    def row_of(i: int, c: str):
        if numeric[c]:
            n = F.col(f"nn{i}").cast("double")
            flat = F.col(f"m2{i}") == 0
            skew = (F.when(n < 3, none).when(flat, F.lit(0.0))
                    .otherwise(F.col(f"g1{i}") * F.sqrt(n * (n - 1)) / (n - 2)))
            kurt = (F.when(n < 4, none).when(flat, F.lit(0.0))
                    .otherwise(((n + 1) * F.col(f"g2{i}") + 6) * (n - 1) / ((n - 2) * (n - 3))))
            sd = F.when(n > 1, F.sqrt(F.col(f"m2{i}") * n / (n - 1)))
            stats_ = [F.round(F.col(f"mn{i}"), 3), F.round(F.col(f"mx{i}"), 3), F.round(F.col(f"avg{i}"), 3),
                      F.round(F.lit(medians[(c, 0.5)]).cast("double"), 3), F.round(sd, 3),
                      F.round(skew, 3), F.round(kurt, 3)]
        else:
            stats_ = [none] * 7
        return F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                        F.lit(field_type(df, c).simpleString()).alias("dtype"),
                        F.col("__rows").alias("rows"), F.col(f"miss{i}").alias("missing"),
                        *[e.alias(name) for e, name in zip(stats_, ["min", "max", "mean", "median", "std",
                                                                    "skewness", "kurtosis"])])

    summary = _wide_rows(df, cols, aggs_of, row_of)
    distinct, tops = _distinct_and_tops(df, cols, kinds, top_n)
    out = summary.join(distinct, "column", "left").join(tops, "column", "left")
    rows_, miss = F.col("rows"), F.col("missing")
    uniq = F.coalesce("unique_count", F.lit(0).cast("long"))
    pct = F.when(rows_ > 0, F.round(miss * 100.0 / rows_, 2)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.round(
        F.lit(100.0) - pct - F.when((rows_ > 0) & (uniq == 1), F.lit(20.0)).otherwise(F.lit(0.0)), 1))
    return out.select("ordinal", "column", "dtype", "rows", "missing", pct.alias("missing_pct"),
                      uniq.alias("unique"), score.alias("quality_score"), "min", "max", "mean", "median", "std",
                      "skewness", "kurtosis", F.col("top").alias("top_values")).orderBy("ordinal")


# --- outlier report -------------------------------------------------------------------

def detect_outliers_report(df: DataFrame, column: str | None = None, iqr_multiplier: float = 1.5,
                           accuracy: int = stats.DEFAULT_ACCURACY, exact: bool = True) -> DataFrame:
    """Per numeric column: Tukey-fence outlier count, % of all rows, severity, bounds (2 dp).
    ``exact=False`` fits the fences with one approximate pass (opt-in for very large tables)."""
    if column is not None:
        cols = [resolve_column(df, column)]
        dt = field_type(df, cols[0])
        if not is_numeric(dt):
            raise ValueError(f"outlier report: {cols[0]!r} is not numeric but {dt.simpleString()}")
    else:
        cols = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if not cols:
        raise ValueError(f"outlier report: none of {df.columns} holds numbers")
    bounds = stats.iqr_bounds(df, cols, iqr_multiplier, accuracy, exact)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        b = bounds[c]
        v = _num(df, c)
        hit = ((v < F.lit(b[0])) | (v > F.lit(b[1]))) if b else F.lit(False)
        aggs.append(F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias(f"o{i}"))
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        b = bounds[c]
        n_out = F.col(f"o{i}")
        pct = F.when(F.col("__rows") > 0, F.round(n_out * 100.0 / F.col("__rows"), 2)).otherwise(F.lit(0.0))
        sev = (F.when(n_out == 0, "none").when(pct < 2, "low").when(pct < 10, "moderate").otherwise("high"))
        lo = F.round(F.lit(b[0]).cast("double"), 2) if b else F.lit(None).cast("double")
        hi = F.round(F.lit(b[1]).cast("double"), 2) if b else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), n_out.alias("n_outliers"), pct.alias("outlier_pct"),
                             sev.alias("severity"), lo.alias("lower"), hi.alias("upper")))
    return wide.select(_stack(rows).alias("r")).select("r.*")


# --- value counts ---------------------------------------------------------------------

def value_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Top-n values including null: value (as text), n, % of all rows (2 dp), rank.

    Ties are broken by value (numbers by size), nulls last. The grouping is map-side combined, texts are
    counted by hash (``_text_tops``); the top-n is a ``TakeOrderedAndProject`` (each task keeps n rows)."""
    c = resolve_column(df, column)
    dt = field_type(df, c)
    v = nan_to_null(F.col(qcol(c)), dt)
    if isinstance(dt, T.StringType) and top_n > 0:
        total, nulls = df.agg(F.count(F.lit(1)), F.count_if(v.isNull())).first()
        counts = _text_tops(df, {0: v}, top_n)[1].select(F.col("value").alias("v"), "n")
        if nulls:
            counts = counts.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("string").alias("v"),
                                                                        F.lit(nulls).cast("long").alias("n")))
        total = F.lit(total)
    else:
        counts = df.select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n")).scalar()
    order = [F.col("n").desc(), F.col("v").asc_nulls_last()]
    top = counts.orderBy(*order).limit(top_n)
    return top.select(text_form(F.col("v"), dt).alias("value"), "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"),
                      F.row_number().over(Window.orderBy(*order)).alias("rank"))


# --- missing-data pattern -------------------------------------------------------------

# Pattern labels and thresholds of the positional heuristic.
PATTERNS = {"front": "front-loaded", "tail": "tail-loaded", "block": "systematic block",
            "sporadic": "sporadic", "none": "none", "all": "entirely missing"}
CLUSTER_SHARE = 0.6
MIN_BLOCK_RUN = 5
BLOCK_SHARE_OF_MISSING = 0.5


def detect_missing_pattern(df: DataFrame, column: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """Where nulls sit in table order (``order_by``, else the source's file order): front-loaded (>60 % in the first third),
    tail-loaded (>60 % in the last third), a block (longest run >= max(5, half the nulls)),
    or sporadic.

    Nulls and runs come from summaries of contiguous pieces of the input, joined in order
    (``plans.runs``): in file order no row is moved, otherwise rows are sorted by range once. Of rows that tie
    on ``order_by`` those with a value come first."""
    c = resolve_column(df, column)
    order = resolve_columns(df, order_by) if order_by else file_order(df)
    null = missing(F.col(qcol(c)), field_type(df, c))
    n, m = df.agg(F.count(F.lit(1)), F.count_if(null)).first()
    front = tail = 1.0 if m else 0.0
    run, name = m, "all" if m else "none"
    if 0 < m < n:
        thirds = -(-n // 3), -(-2 * n // 3)     # rows before position n / 3, and before 2 n / 3
        whole, (first, last) = flagged_runs(df, order, null, n, thirds, files=order == ORDER_COLUMNS)
        front, tail, run = first / m, (m - last) / m, whole.longest
        name = ("front" if front > CLUSTER_SHARE else "tail" if tail > CLUSTER_SHARE
                else "block" if run >= max(MIN_BLOCK_RUN, m * BLOCK_SHARE_OF_MISSING) else "sporadic")
    return df.sparkSession.range(1).select(
        F.lit(c).alias("column"), F.lit(n).cast("long").alias("n_rows"), F.lit(m).cast("long").alias("n_missing"),
        F.round(F.lit(m * 100.0 / n if n else 0.0), 2).alias("missing_pct"),
        F.round(F.lit(front), 4).alias("frac_first"), F.round(F.lit(tail), 4).alias("frac_last"),
        F.lit(run).cast("long").alias("longest_run"), F.lit(PATTERNS[name]).alias("pattern"))

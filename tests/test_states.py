"""Column states: merged over any parts they say what the whole table says."""

import math

import pytest
from pyspark.sql import functions as F

from scrubspark.operators import reports, states
from scrubspark.session import scratch_path

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def near(a, b, tol=2e-3):
    if a is None or b is None or math.isnan(a) or math.isnan(b):
        return (a is None) == (b is None) and (a is None or math.isnan(a) == math.isnan(b))
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


@pytest.mark.parametrize("n_parts", [1, 4, 37])
def test_parts_merge_to_the_whole(spark, n_parts):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    part = {"part": F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(n_parts))}
    got = rows_of(states.summarise(states.column_states(li, part), parts=["part"]))
    want = rows_of(reports.column_summary(li))
    full = rows_of(reports.profile_columns(li))
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert (g["ordinal"], g["dtype"], g["rows"], g["null_count"]) == (w["ordinal"], w["dtype"], 60000, w["null_count"])
        assert abs(g["unique_count"] - w["unique_count"]) <= 0.04 * w["unique_count"]
        assert (g["dt_min"], g["dt_max"], g["top_categories"]) == (w["dt_min"], w["dt_max"], w["top_categories"])
        for m in ("min", "max", "mean", "std"):
            assert near(g[m], w[m], 1e-6), (c, m)
        if w["mean"] is not None:
            assert near(g["skewness"], full[c]["skewness"]) and near(g["kurtosis"], full[c]["kurtosis"])


def test_quantiles_keep_their_rank_error(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice")
    st = states.column_states(li, {"part": F.pmod(F.xxhash64("l_extendedprice"), F.lit(11))})
    q = states.summarise(st, parts=["part"], quantiles=[0.01, 0.25, 0.5, 0.9]).first()["quantiles"]
    for p, v in zip([0.01, 0.25, 0.5, 0.9], q):
        below, at = li.agg(F.avg((F.col("l_extendedprice") < v).cast("double")),
                           F.avg((F.col("l_extendedprice") <= v).cast("double"))).first()
        assert below - 0.01 <= p <= at + 0.01


def test_moments_far_from_zero(spark):
    """Parts whose means differ little against a large offset: sums of plain powers would lose every digit."""
    df = spark.range(10_000).select((F.lit(1e9) + F.pmod(F.col("id") * 37, F.lit(1000)) / 1000).alias("x"), "id")
    one = states.summarise(states.column_states(df.select("x", "id"), {"part": F.col("id") % 9}), parts=["part"])
    g = one.where("column = 'x'").first()
    values = [((i * 37) % 1000) / 1000 for i in range(10_000)]
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))
    assert g["std"] == pytest.approx(std, abs=2e-4) and g["mean"] == pytest.approx(1e9 + mean, abs=2e-4)


def test_only_new_files_are_read_and_changed_files_count_once(spark):
    table, beside = scratch_path(spark, "t"), scratch_path(spark, "s")
    with pytest.raises(ValueError, match="no states"):
        states.current_states(spark, table, beside)

    def append(lo, hi, mode="append"):
        spark.range(lo, hi).select("id", F.concat(F.lit("k"), F.col("id") % 3).alias("k")).coalesce(1).write.mode(
            mode).parquet(table)

    def summary():
        return rows_of(states.summarise(states.current_states(spark, table, beside)))

    append(0, 100)
    assert states.update_states(spark, table, beside) == 1
    append(100, 250)
    append(250, 300)
    assert states.update_states(spark, table, beside) == 2     # not the first file
    assert states.update_states(spark, table, beside) == 0
    s = summary()
    assert (s["id"]["rows"], s["id"]["min"], s["id"]["max"], s["id"]["mean"]) == (300, 0.0, 299.0, 149.5)
    assert s["k"]["top_categories"] == [("k0", 100), ("k1", 100), ("k2", 100)] and s["k"]["top_exact"]
    # two updates of the same files count once
    known = spark.read.parquet(beside)
    known.withColumn("batch", F.lit("zz")).write.mode("append").parquet(beside)
    assert summary() == s
    # a table written anew: the states of its old files are there but count no more
    append(0, 7, "overwrite")
    assert states.update_states(spark, table, beside) == 1
    assert (summary()["id"]["rows"], summary()["k"]["unique_count"]) == (7, 3)


def test_added_and_retyped_columns(spark):
    table, beside = scratch_path(spark, "t"), scratch_path(spark, "s")
    spark.range(4).selectExpr("cast(id as int) id").coalesce(1).write.parquet(table)
    states.update_states(spark, table, beside)
    spark.range(4, 10).selectExpr("id", "'x' as extra", "1.5D as w").coalesce(1).write.mode("append").parquet(table)
    states.update_states(spark, table, beside)
    s = rows_of(states.summarise(states.current_states(spark, table, beside)))
    assert (s["id"]["dtype"], s["id"]["unique_count"], s["id"]["max"]) == ("bigint|int", 10, 9.0)
    assert (s["extra"]["rows"], s["extra"]["null_count"], s["extra"]["null_pct"]) == (10, 4, 40.0)
    # null in the first file, and the only value costs 20 points
    assert s["extra"]["quality_score"] == 40.0
    assert (s["w"]["std"], s["w"]["skewness"], s["w"]["null_count"]) == (0.0, 0.0, 4)


def test_partitioned_table_with_odd_names(spark):
    """Partition columns are columns; odd characters in a file's path don't make it new each time."""
    table, beside = scratch_path(spark, "t"), scratch_path(spark, "s")
    spark.range(6).selectExpr("id", "concat('a b%', id % 2) as p").write.partitionBy("p").parquet(table)
    n = states.update_states(spark, table, beside)
    assert n > 0 and states.update_states(spark, table, beside) == 0
    s = rows_of(states.summarise(states.current_states(spark, table, beside)))
    assert s["p"]["top_categories"] == [("a b%0", 3), ("a b%1", 3)] and s["id"]["rows"] == 6


def test_odd_values(spark):
    schema = "d double, s string, b boolean, t timestamp, n date, path string, `a.b` int"
    rows = [(float("nan"), None, True, None, None, "x", 1), (-0.0, "", None, None, None, "y" * 100_000, None),
            (0.0, "é", False, None, None, "y" * 99_999 + "z", 2), (None, "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    s = rows_of(states.summarise(states.column_states(df, {"path": F.lit(1)}), parts=["path"]))
    assert (s["d"]["null_count"], s["d"]["unique_count"], s["d"]["mean"]) == (2, 1, 0.0)
    assert s["s"]["top_categories"] == [("", 2), ("é", 1)] and s["s"]["null_count"] == 1
    assert (s["b"]["mean"], s["t"]["null_count"], s["t"]["dt_min"], s["n"]["unique_count"]) == (0.5, 4, None, 0)
    # long texts that differ only at the end stay two values, of bounded size
    assert s["path"]["unique_count"] == 3 and all(len(v) < 90 and n == 1 for v, n in s["path"]["top_categories"])
    assert s["a.b"]["quantiles"] == [1.0, 1.0, 2.0] and s["t"]["quantiles"] is None
    assert states.summarise(states.column_states(df.limit(0), {"part": F.lit(1)}), parts=["part"]).collect() == []


def test_zoned_times_show_in_utc(spark):
    df = spark.sql("select timestamp'2300-03-10 02:30:00.000001 America/New_York' t")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        s = rows_of(states.summarise(states.column_states(df, {"part": F.lit(1)}), parts=["part"]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert s["t"]["dt_min"] in ("2300-03-10 07:30:00.000001", "2300-03-10 06:30:00.000001")


def test_states_take_one_narrow_shuffle(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = states.column_states(li, {"part": F.col("_metadata.file_path")})._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1 and "Python" not in p and p.count("FileScan") == 1

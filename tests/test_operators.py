"""Unit tests on a small table: semantics, the quirk decisions, and raised errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scrubspark.contracts import UnknownColumn, resolve_column
from scrubspark.operators import cells, rows


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def by_id(df, c):
    return {r["customer_id"]: r[c] for r in df.select("customer_id", c).collect()}


# --- contracts ------------------------------------------------------------------------

def test_resolve_exact_folded_and_suggestions(people):
    assert resolve_column(people, "age") == "age"
    assert resolve_column(people, "  AGE ") == "age"
    with pytest.raises(UnknownColumn, match="close matches"):
        resolve_column(people, "agee")


def test_resolve_ambiguous_fold_raises(spark):
    df = spark.createDataFrame([(1, 2)], "`Age` int, `age ` int")
    with pytest.raises(UnknownColumn, match="ambiguous"):
        resolve_column(df, "AGE")


# --- rows -----------------------------------------------------------------------------

def test_drop_duplicates_all_columns(people):
    assert rows.drop_duplicates(people).count() == 7


def test_drop_duplicates_first_last_none(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4), (None, "e", 5)],
                               "k int, v string, o int")
    first = {r["k"]: r["v"] for r in rows.drop_duplicates(df, ["k"], "first", ["o"]).collect()}
    last = {r["k"]: r["v"] for r in rows.drop_duplicates(df, ["k"], "last", ["o"]).collect()}
    none = {r["k"]: r["v"] for r in rows.drop_duplicates(df, ["k"], "none").collect()}
    assert first == {1: "a", 2: "c", None: "d"}   # nulls in the key compare equal
    assert last == {1: "b", 2: "c", None: "e"}
    assert none == {2: "c"}
    with pytest.raises(ValueError):
        rows.drop_duplicates(df, ["k"], "middle")


def test_dedup_is_idempotent(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"))
    once = rows.drop_duplicates(df, ["k"], "first", ["o"])
    twice = rows.drop_duplicates(once, ["k"], "first", ["o"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_filter_greater_keeps_null_and_text(people):
    out = rows.filter_rows(people, "score_txt", "greater_than", 5)
    # removed: 10, 7.5, 1e3, inf ; kept: forty, null, -3
    assert sorted(col(out, "customer_id")) == [2, 4, 6]


def test_filter_numeric_value_required(people):
    with pytest.raises(ValueError, match="compares numbers"):
        rows.filter_rows(people, "age", "greater_than", "old")
    with pytest.raises(ValueError, match="required"):
        rows.filter_rows(people, "age", "equals")
    with pytest.raises(ValueError, match="is none of"):
        rows.filter_rows(people, "age", "between", 1)


def test_filter_equals_numbers_as_numbers(people):
    out = rows.filter_rows(people, "age", "equals", "36")   # 36.0 == "36" numerically
    assert 1 not in col(out, "customer_id")
    ne = rows.filter_rows(people, "status", "not_equals", "active")  # nulls removed too
    assert set(col(ne, "status")) == {"active"}


def test_filter_contains_is_regex(people):
    out = rows.filter_rows(people, "city", "contains", "^[Mm]umbai$")
    assert sorted(col(out, "city"), key=str) == sorted([" mumbai ", "MUMBAI", "Pune", " Delhi ",
                                                        "delhi", "Pune"], key=str)


def test_sort_nulls_last_both_ways(people):
    asc = col(rows.sort_dataset(people, "age"), "age")
    desc = col(rows.sort_dataset(people, "age", ascending=False), "age")
    assert asc[-2:] == [None, None] and desc[-2:] == [None, None]
    assert desc[0] == 160.0


def test_remove_outliers_keeps_nulls(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 100]] + [(None,)], "x double")
    out = col(rows.remove_outliers(df, "x"), "x")
    assert 100.0 not in out and None in out and len(out) == 7


# --- cells ----------------------------------------------------------------------------

def test_fill_strategies(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (3, "b"), (None, "a")], "n int, s string")
    mean = col(cells.fill_missing(df, "n", "mean"), "n")
    assert sorted(mean) == pytest.approx([1.0, 7 / 3, 7 / 3, 3.0, 3.0])
    assert sorted(col(cells.fill_missing(df, "n", "median"), "n")) == [1.0, 3.0, 3.0, 3.0, 3.0]
    assert col(cells.fill_missing(df, "s", "mode"), "s").count("a") == 3  # tie a/b -> smallest
    assert None not in col(cells.fill_missing(df, "n", "constant", "0"), "n")
    with pytest.raises(ValueError):
        cells.fill_missing(df, "n", "constant", "zero")
    with pytest.raises(ValueError):
        cells.fill_missing(df, "n", "constant")
    with pytest.raises(ValueError, match="Unknown strategy"):
        cells.fill_missing(df, "n", "average")


def test_fill_all_null_unchanged(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert col(cells.fill_missing(df, "x", "mean"), "x") == [None, None]


def test_numeric_parse_rules(people):
    out = by_id(cells.convert_dtype(people, "salary", "float"), "salary")
    assert out[1] == 52000.0 and out[2] == 61000.5 and out[5] == 42.0
    assert out[4] is None       # 1e400 overflows: null, as pandas
    assert out[7] is None       # empty text
    price = by_id(cells.convert_dtype(people, "price", "float"), "price")
    assert price[5] is None     # Spark would read '1d' as 1.0; pandas gives null


def test_convert_int_fraction_policy(people):
    ok = by_id(cells.convert_dtype(people, "price", "int", on_fraction="null"), "price")
    assert ok[1] is None and ok[3] == 12
    with pytest.raises(Exception, match="fractional"):
        cells.convert_dtype(people, "price", "int").collect()


def test_convert_datetime_explicit_formats(people):
    out = by_id(cells.convert_dtype(people, "signup_date", "datetime"), "signup_date")
    assert out[1] == dt.datetime(2020, 1, 15)
    assert out[2] == dt.datetime(2021, 6, 30, 10, 20, 30)
    assert out[5] == dt.datetime(2022, 3, 4)
    assert out[3] is None and out[7] is None   # '12:00' is not a date here


def test_convert_bool_parse_and_truthy(spark):
    df = spark.createDataFrame([("true",), ("False",), ("",), (None,), ("yes",)], "b string")
    assert col(cells.convert_dtype(df, "b", "bool"), "b") == [True, False, None, None, True]
    assert col(cells.convert_dtype(df, "b", "bool", truthy=True), "b") == [True, True, False, False, True]


def test_convert_str_and_category(people):
    s = cells.convert_dtype(people, "age", "str")
    assert dict(s.dtypes)["age"] == "string" and None in col(s, "age")
    assert None not in col(cells.convert_dtype(people, "age", "str", null_text="nan"), "age")
    c = cells.convert_dtype(people, "status", "category")
    assert c.schema["status"].metadata.get("categorical") is True
    codes = by_id(cells.category_codes(c, "status"), "status_code")
    assert codes[1] == 0 and codes[3] == 1 and codes[4] == -1 and codes[6] == 2


def test_cap_and_clip(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 6, 100]] + [(None,)], "x int")
    capped = col(cells.cap_outliers(df, "x"), "x")
    assert max(v for v in capped if v is not None) < 100 and None in capped
    clipped = cells.clip_numeric_range(df, "x", 2, 5)
    assert dict(clipped.dtypes)["x"] == "int" and sorted(v for v in col(clipped, "x") if v) == [2, 2, 3, 4, 5, 5, 5]
    assert dict(cells.clip_numeric_range(df, "x", 1.5).dtypes)["x"] == "double"
    with pytest.raises(ValueError):
        cells.clip_numeric_range(df, "x")


def test_non_numeric_rejected(people):
    with pytest.raises(ValueError, match="not numeric"):
        cells.cap_outliers(people, "city")
    with pytest.raises(ValueError, match="not numeric"):
        cells.clip_numeric_range(people, "city", 0)


def test_standardize_text_unicode_trim_and_title(people, spark):
    out = by_id(cells.standardize_text(people, "city", case="title"), "city")
    assert out[2] == "Mumbai" and out[3] == "Mumbai" and out[5] == "Delhi"
    names = by_id(cells.standardize_text(people, "full_name", case="title"), "full_name")
    assert names[4] == "O'Neil 3Rd" and names[2] == "Alan Turing"
    with pytest.raises(ValueError):
        cells.standardize_text(people, "city", case="camel")


def test_find_and_replace(people):
    exact = by_id(cells.find_and_replace(people, "state", "NY", "New York"), "state")
    assert exact[1] == "New York" and exact[6] == "ny"
    loose = by_id(cells.find_and_replace(people, "state", "NY", "New York", match_case=False), "state")
    assert loose[6] == "New York"
    num = cells.find_and_replace(people, "age", "36.0", "37")
    assert dict(num.dtypes)["age"] == "double" and by_id(num, "age")[1] == 37.0
    widened = cells.find_and_replace(people, "age", "36.0", "unknown")
    assert dict(widened.dtypes)["age"] == "string"


def test_split_column(people):
    out = cells.split_column(people, "full_name", " ", ["first", "last"])
    assert "full_name" not in out.columns
    r = by_id(out, "last")
    assert r[4] == "3rd" and r[5] is None
    one = by_id(cells.split_column(people, "signup_date", "-", ["year"]), "year")
    assert one[1] == "2020"
    with pytest.raises(ValueError, match="there already"):
        cells.split_column(people, "full_name", " ", ["city", "x"])
    with pytest.raises(ValueError):
        cells.split_column(people, "full_name", " ", [])


def test_merge_columns(people):
    out = cells.merge_columns(people, ["city", "state"], "place", ", ")
    assert "city" not in out.columns and by_id(out, "place")[1] == "Mumbai, NY"
    keep = cells.merge_columns(people, ["status", "state"], "status", "/", null_text="nan")
    assert by_id(keep, "status")[4] == "nan/NY"
    with pytest.raises(ValueError, match="there already"):
        cells.merge_columns(people, ["city", "state"], "price")
    with pytest.raises(ValueError):
        cells.merge_columns(people, ["city"], "x")


def test_datetime_parts(people):
    out = cells.extract_datetime_parts(people, "signup_date", ["year", "weekday", "quarter", "hour"])
    r = {x["customer_id"]: x for x in out.collect()}
    assert r[1]["signup_date_year"] == 2020 and r[1]["signup_date_weekday"] == "Wednesday"
    assert r[2]["signup_date_hour"] == 10 and r[2]["signup_date_quarter"] == 2
    assert r[3]["signup_date_year"] is None
    with pytest.raises(ValueError, match="no part"):
        cells.extract_datetime_parts(people, "signup_date", ["century"])


def test_remove_type_anomalies(people):
    out = by_id(cells.remove_type_anomalies(people, "score_txt", "numeric"), "score_txt")
    assert out[2] is None and out[1] == "10" and out[7] == "inf"
    with pytest.raises(ValueError):
        cells.remove_type_anomalies(people, "score_txt", "money")


def test_rename_clash(people):
    with pytest.raises(ValueError, match="there already"):
        cells.rename_column(people, "age", "age")
    with pytest.raises(ValueError, match="there already"):
        cells.rename_column(people, "age", "City")
    assert "years" in cells.rename_column(people, "AGE", "years").columns


def test_drop_column(people):
    assert cells.drop_column(people, ["age", " City"]).columns[:3] == ["customer_id", "full_name", "salary"]


def test_datetime_parse_ignores_session_zone(spark):
    from scrubspark.operators import reports

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2020-03-08 02:30:00",), ("2020-03-08 03:30:00",), ("bad",)], "s string")
        out = cells.convert_dtype(df, "s", "datetime")
        assert col(out, "s") == [dt.datetime(2020, 3, 8, 2, 30), dt.datetime(2020, 3, 8, 3, 30), None]
        assert reports.column_summary(out).first()["unique_count"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_plain_iso_datetimes_are_no_anomalies(spark):
    texts = ["2020-01-01 10:00", "2020-01-01T10:00:00Z", "2020-01-01T10:00:00.5+02:00", "2020/01/01", "2020-1-5",
             "1/2/2020 03:04:05", "2020-01-01 10:00:05.123456", "2020-13-01", "2020", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kept = [r["t"] for r in cells.remove_type_anomalies(df, "t", "datetime").collect()]
    assert kept == texts[:7] + [None] * 4
    parsed = [str(r["t"]) for r in cells.convert_dtype(df, "t", "datetime").limit(6).collect()]
    assert parsed == ["2020-01-01 10:00:00", "2020-01-01 10:00:00", "2020-01-01 10:00:00.500000",
                      "2020-01-01 00:00:00", "2020-01-05 00:00:00", "2020-01-02 03:04:05"]

"""Numbers as text, and numbers compared: the same in every operator."""

import random
import struct

import pytest

from scrubspark.operators import cells, reports, rows


def test_text_of_doubles_is_what_python_writes(spark):
    r = random.Random(1)
    values = [5.0, 1e7, 1e-4, 9007199254740993.0, 1e15, 9999999999999998.0, 1e16, 1.5e-5, 9.9e-5, -1234567.5, 0.0, 1e300,
              -2.5e-300, 123456789.125, 1e-3, 0.00099, float("inf"), float("-inf")]
    values += [r.choice([1, -1]) * r.random() * 10.0 ** r.randrange(-8, 20) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [x.d for x in cells.convert_dtype(df, "d", "str").collect()]
    # a JVM before 19 writes a digit too many for some numbers of 16 digits; they still read back as the same number
    assert [float(g) for g in got] == values
    assert all(g == str(v) or len(g) > len(str(v)) > 16 for g, v in zip(got, values))
    assert got[:18] == [str(v) for v in values[:18]]
    floats = [struct.unpack("f", struct.pack("f", v))[0] for v in (0.1, 1e7, 2.5e-5)]
    shown = [x.f for x in cells.convert_dtype(spark.createDataFrame([(v,) for v in floats], "f float"), "f", "str").collect()]
    assert shown == ["0.1", "10000000.0", "2.5e-05"]
    nan = spark.createDataFrame([(float("nan"),), (None,)], "d double")
    assert [x.d for x in cells.convert_dtype(nan, "d", "str", null_text="nan").collect()] == ["nan", "nan"]


@pytest.mark.parametrize("value,hit", [("5", 5.0), ("10000000", 1e7), ("10000000.0", 1e7), ("1e7", 1e7), ("0.0001", 1e-4),
                                       (0.0001, 1e-4), ("five", None), ("", None)])
def test_equality_by_value_everywhere(spark, value, hit):
    df = spark.createDataFrame([(5.0,), (1e7,), (0.0001,), (None,), (float("nan"),)], "d double")
    kept = [x.d for x in rows.filter_rows(df, "d", "equals", value).collect()]
    assert len(kept) == (5 if hit is None else 4) and hit not in kept[:3]
    replaced = [x.d for x in cells.find_and_replace(df, "d", value, 77).collect()]
    assert replaced[:3] == [77.0 if v == hit else v for v in (5.0, 1e7, 0.0001)]
    assert replaced[3] is None


def test_contains_and_value_counts(spark):
    df = spark.createDataFrame([(1e7,), (9.0,), (10.0,), (0.0001,), (9.0,), (None,), (float("nan"),)], "d double")
    assert rows.filter_rows(df, "d", "contains", "^1000").where("d = 1e7").count() == 0
    got = [(x.value, x.n) for x in reports.value_counts(df, "d").orderBy("rank").collect()]
    assert got == [("9.0", 2), (None, 2), ("0.0001", 1), ("10.0", 1), ("10000000.0", 1)]

"""Column expressions shared by the operators. All are native Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import is_datetime, is_floating, is_integral, is_numeric, is_string

# What counts as a number when text is parsed (after trimming), and the
# spellings of infinity accepted besides it. Anything else parses to null, as with
# pandas.to_numeric(errors="coerce").
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_WORDS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]

# Default datetime layouts tried in order when text is parsed. What stands in brackets may be
# missing, so one layout takes dates, minutes, seconds, fractions and zones (of which the wall
# clock is kept): few tries per cell.
DATETIME_FORMATS = [
    "yyyy-M-d[ HH:mm[:ss[.SSSSSS]]][XXX]",
    "yyyy-M-d'T'HH:mm[:ss[.SSSSSS]][XXX]",
    "yyyy/M/d[ HH:mm[:ss[.SSSSSS]]]",
    "M/d/yyyy[ HH:mm[:ss[.SSSSSS]]]",
]

# Whitespace removed at both ends by trim (what Python's str.strip removes:
# ASCII tab..carriage return, file/group/record/unit separators, space, next-line, and the
# Unicode space, line and paragraph separators), as code points in order.
WHITESPACE_CODE_POINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE_CHARS = "".join(chr(c) for c in WHITESPACE_CODE_POINTS)
# The same set as a regular-expression class (for SQL engines without a trim set).
WHITESPACE_CLASS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"

# Cased letters; a cased letter after anything else starts a word in title case.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def missing(col: Column, dt: T.DataType) -> Column:
    """True for null, and for NaN in floating columns (pandas ``isnull``)."""
    if is_floating(dt):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def nan_to_null(col: Column, dt: T.DataType) -> Column:
    if is_floating(dt):
        return F.nanvl(col, F.lit(None).cast(dt))
    return col


def to_number(col: Column, dt: T.DataType) -> Column:
    """Parse to double: numbers pass through, text must look like a number, else null."""
    if is_numeric(dt):
        return nan_to_null(col, dt).cast("double")
    if isinstance(dt, T.BooleanType):
        return col.cast("double")
    text = F.trim(col.cast("string"))
    as_double = text.try_cast("double")
    finite_ok = text.rlike(NUMBER_PATTERN) & ~F.isnan(as_double) & (F.abs(as_double) != F.lit(float("inf")))
    is_inf = F.lower(text).isin(INFINITY_WORDS)
    return F.when(finite_ok, as_double).when(is_inf, as_double)


def to_timestamp_ntz(col: Column, dt: T.DataType, formats: Sequence[str] | None = None) -> Column:
    """Parse to timestamp without zone: datetime columns cast, text tried against a format list."""
    if is_datetime(dt):
        return col.cast("timestamp_ntz")
    if not is_string(dt):
        return F.lit(None).cast("timestamp_ntz")
    text = F.trim(col)
    # try_to_timestamp only decides whether the text fits the layout (it never raises);
    # the value comes from to_timestamp_ntz, which reads the wall clock without a zone, so
    # the result does not depend on the session time zone (no shift across DST gaps).
    tries = [F.when(F.try_to_timestamp(text, F.lit(f)).isNotNull(), F.to_timestamp_ntz(text, F.lit(f)))
             for f in (formats or DATETIME_FORMATS)]
    return F.coalesce(*tries)


def unicode_trim(col: Column) -> Column:
    """Strip Unicode whitespace at both ends. ``trim`` with a character set only walks in
    from the two ends (no regular expression over the whole text); plain ``trim`` would
    only remove spaces."""
    return F.trim(col, F.lit(WHITESPACE_CHARS))


def title_case(col: Column) -> Column:
    """Upper-case a cased letter that follows a non-cased character, lower-case the rest.

    Runs of cased letters and runs of anything else are split apart, each run gets
    ``upper(first) || lower(rest)`` (a no-op on non-letters), and the runs are joined back.
    """
    runs = F.regexp_extract_all(col, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), 1)
    fixed = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.when(col.isNotNull(), F.array_join(fixed, ""))


def number_text(col: Column) -> Column:
    """A float as users write it: digits and a point from 0.0001 up to below 10^16 (``10000000.0``), beyond that
    with an exponent (``1e+16``, ``1.5e-05``), infinities as ``inf``; null for NaN."""
    shown = col.cast("string")        # the shortest digits that read back as the number
    size = F.abs(col)
    plain = F.regexp_replace(shown.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.substring_index(shown, "E", -1).try_cast("int")
    power = F.abs(exponent).cast("string")
    scientific = F.concat(F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", ""),
                          F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                          F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    return (F.when(F.isnan(col), F.lit(None).cast("string")).when(~shown.contains("E") & (size < 1e16), shown)
            .when(size == float("inf"), F.when(col > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific))


def text_form(col: Column, dt: T.DataType) -> Column:
    """The text a cell shows; null stays null."""
    if is_string(dt):
        return col
    if is_floating(dt):
        return number_text(col)
    return col.cast("string")


def equals_value(col: Column, dt: T.DataType, value, match_case: bool = True) -> Column:
    """Null-safe equality in the column's own type, numbers by their value: never true on a null cell, never null."""
    if isinstance(dt, T.BooleanType):
        truth = boolean_word(value)
        return F.lit(False) if truth is None else col.eqNullSafe(F.lit(truth))
    if is_integral(dt):
        exact = exact_integer(value)
        fits = exact is not None and -(2**63) <= exact < 2**63
        return F.coalesce(col == F.lit(exact).cast("long"), F.lit(False)) if fits else F.lit(False)
    if isinstance(dt, T.DecimalType):
        d = F.lit(str(value).strip()).try_cast("decimal(38,18)")
        return F.coalesce(col == d, F.lit(False))
    if is_numeric(dt):
        try:
            return F.coalesce(col == F.lit(float(value)).cast(dt), F.lit(False))
        except (TypeError, ValueError):
            return F.lit(False)
    text = text_form(col, dt)
    if match_case:
        return text.eqNullSafe(F.lit(str(value)))
    return F.coalesce(F.lower(text) == F.lit(str(value).lower()), F.lit(False))


def exact_integer(value) -> int | None:
    """A whole number written as a number or as text, digit for digit; None if it is none."""
    if isinstance(value, bool):
        return int(value)
    try:
        d = Decimal(str(value).strip())
        return int(d) if d.is_finite() and d == d.to_integral_value() else None
    except InvalidOperation:
        return None


def boolean_word(value) -> bool | None:
    """The truth value a word stands for; None if it stands for none."""
    if isinstance(value, bool):
        return value
    return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(str(value).strip().lower())

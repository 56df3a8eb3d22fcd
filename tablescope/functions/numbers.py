"""Number expressions: lenient parsing, rounding, Python-style number text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import CURRENCY_CHAR_PATTERN, NUMBER_SHAPE_PATTERN, NUMBER_STRIP_PATTERN, EXCEL_ERRORS, WHITESPACE


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_number_text(col) -> Column:
    """Remove currency signs, thousands separators, percent signs, whitespace."""
    return F.regexp_replace(_c(col), NUMBER_STRIP_PATTERN, "")


def to_number(col) -> Column:
    """Lenient text → DOUBLE: ``' $1,200.50 '`` → 1200.5; anything else → NULL.

    The shape check runs before the cast so Java's ``5d``/``5f`` suffixes,
    ``NaN`` and ``Infinity`` never count as numbers.
    """
    text = F.trim(_c(col).cast("string"), F.lit(WHITESPACE))
    bare = strip_number_text(text)
    ok = text.isNotNull() & ~text.isin(EXCEL_ERRORS) & bare.rlike(NUMBER_SHAPE_PATTERN)
    return F.when(ok, bare.try_cast("double"))


def is_number_text(col) -> Column:
    return to_number(col).isNotNull()


def has_currency_char(col) -> Column:
    return _c(col).rlike(CURRENCY_CHAR_PATTERN)


def clean_double(col) -> Column:
    """DOUBLE with NaN and ±Infinity turned into NULL."""
    c = _c(col).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def as_number(col, dtype: T.DataType) -> Column:
    """Numeric view of a column of any physical type (NULL when not a number)."""
    if isinstance(dtype, T.NumericType):
        return clean_double(col)
    if isinstance(dtype, T.StringType):
        return to_number(col)
    return F.lit(None).cast("double")


def fround(col, digits: int) -> Column:
    """Round half-to-even on the scaled binary value (numpy's ``round``).

    Equals DuckDB's ``round_even(x, digits)`` bit for bit.
    """
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def safe(col, digits: int | None = 4) -> Column:
    """NaN / ±Infinity / NULL → 0.0, then optional rounding."""
    c = F.coalesce(clean_double(col), F.lit(0.0))
    return fround(c, digits) if digits is not None else c


def py_float_text(col) -> Column:
    """DOUBLE → the text Python's ``repr``/``str`` gives (``10000000.0``, ``1e-05``).

    Spark prints exponent notation outside [1e-3, 1e7); Python only outside
    [1e-4, 1e16). The digits are the same shortest round-trip digits, so only
    the layout is rewritten.
    """
    x = _c(col).cast("double")
    s = x.cast("string")
    pat = r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$"
    sign = F.regexp_extract(s, pat, 1)
    lead = F.regexp_extract(s, pat, 2)
    frac = F.regexp_extract(s, pat, 3)
    exp = F.regexp_extract(s, pat, 4).try_cast("int")
    digits = F.concat(lead, F.when(frac == "0", F.lit("")).otherwise(frac))
    ndig = F.length(digits)
    plain_pos = F.when(
        ndig <= exp + 1,
        F.concat(digits, F.repeat(F.lit("0"), exp + 1 - ndig), F.lit(".0")),
    ).otherwise(F.concat(digits.substr(F.lit(1), exp + 1), F.lit("."), digits.substr(exp + 2, ndig)))
    plain_neg = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    sci = F.concat(
        lead,
        F.when(frac == "0", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
        F.lit("e"),
        F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exp).cast("string"), 2, "0"),
    )
    rewritten = F.concat(
        sign,
        F.when((exp >= 0) & (exp < 16), plain_pos)
        .when((exp < 0) & (exp >= -4), plain_neg)
        .otherwise(sci),
    )
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == F.lit(float("inf")), F.lit("inf"))
        .when(x == F.lit(float("-inf")), F.lit("-inf"))
        .when(s.contains("E"), rewritten)
        .otherwise(s)
    )


def value_text(col, dtype: T.DataType) -> Column:
    """Text form of a value as pandas ``astype(str)`` prints it."""
    c = _c(col)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return py_float_text(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.StringType,)):
        return c
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")

"""Scalar column functions (inventory B4, B5, C2-C10, C17, C24, D2)."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ColumnLike, c

# Fixed value: characters stripped by "trimmed length" (Unicode White_Space).
WHITESPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
# Fixed value: tokens that stand for a missing value in raw flow exports.
MISSING_TOKENS = ["-", "", "?", "#DIV/0!"]
# Fixed value: capture timestamp format (year, then time of day with nanoseconds).
EDGE_TIME_FORMAT = "yyyy HH:mm:ss.SSSSSSSSS"

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def strip(col: ColumnLike) -> Column:
    return F.btrim(c(col), F.lit(WHITESPACE))


def text_length(col: ColumnLike, null_as_empty: bool = False) -> Column:
    """Length in characters after stripping whitespace; null -> 0 or null."""
    x = c(col)
    if null_as_empty:
        x = F.coalesce(x, F.lit(""))
    return F.length(F.btrim(x, F.lit(WHITESPACE))).cast("long")


def map_values(col: ColumnLike, mapping: Mapping, default=None, strict: bool = False) -> Column:
    """Replace values through ``mapping``.

    Unknown values give ``default``; with ``strict`` an unknown non-null value
    raises.  The mapping is a literal map (JVM-side lookup), so its size is
    fixed by the caller, not by the data.
    """
    x = c(col)
    if mapping and all(isinstance(k, str) for k in mapping):
        x = x.cast("string")
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    hit = F.try_element_at(m, x)
    known = F.map_contains_key(m, x)
    out = F.when(known, hit).otherwise(F.lit(default))
    if strict:
        out = F.when(x.isNotNull() & ~known,
                     F.raise_error(F.concat(F.lit("value not in mapping: "), x.cast("string")))
                     ).otherwise(out)
    return F.when(x.isNotNull(), out)


def map_values_by_table(df: DataFrame, col: str, mapping: DataFrame, out: str, default=None, strict: bool = False) -> DataFrame:
    """C3 for mappings of any size: replace values through the table ``mapping`` (columns ``key``, ``value``).

    A plain equi-join: Spark broadcasts the mapping if it is below its own
    threshold and splits hot values otherwise.  Null stays null, unknown values
    give ``default``.  ``strict`` first looks for unknown values, in one
    aggregate that brings a single one back, and raises on it.  A key that the
    mapping holds twice is an error.
    """
    twice = mapping.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.min("key").alias("k"), F.count(F.lit(1)).alias("c")).first()
    if twice["c"]:
        raise ValueError(f"key twice in mapping: {twice['k']}")
    table = mapping.select(F.col("key").alias("__key"), F.col("value").alias("__value"), F.lit(True).alias("__known"))
    if strict:
        unknown = (df.where(c(col).isNotNull()).select(c(col).alias("__x")).join(table, F.col("__x") == F.col("__key"), "left_anti")
                   .agg(F.min("__x").alias("x"), F.count(F.lit(1)).alias("n")).first())
        if unknown["n"]:
            raise ValueError(f"value not in mapping: {unknown['x']} ({unknown['n']} rows)")
    value = F.when(F.col("__known"), F.col("__value")).otherwise(F.when(c(col).isNotNull(), F.lit(default)))
    return df.join(table, c(col) == F.col("__key"), "left").withColumn(out, value).drop("__key", "__value", "__known")


def _ntz_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), ts)


def parse_epoch(col: ColumnLike, fmt: str = EDGE_TIME_FORMAT) -> Column:
    """C4: trimmed text -> epoch seconds (double, microsecond precision); bad text -> null.

    The wall-clock value is read as UTC whatever the session time zone is.
    """
    parsed = F.try_to_timestamp(strip(col), F.lit(fmt)).cast("timestamp_ntz")
    return _ntz_micros(parsed) / F.lit(1e6)


def is_parseable(col: ColumnLike, fmt: str = EDGE_TIME_FORMAT) -> Column:
    """Does the trimmed text parse with ``fmt``."""
    return parse_epoch(col, fmt).isNotNull()


def parse_date(col: ColumnLike, formats: Sequence[str] = ("yyyy-MM-dd",), strict: bool = False) -> Column:
    """Text -> date with the first matching format; strict raises on bad text."""
    x = strip(col)
    out = F.coalesce(*[F.try_to_date(x, f) for f in formats]) if formats else F.try_to_date(x)
    if strict:
        out = F.when(x.isNotNull() & out.isNull(),
                     F.raise_error(F.concat(F.lit("unparseable date: "), x))).otherwise(out)
    return out


_HEX = r"^[0-9a-fA-F]+$"


def hex_to_long(col: ColumnLike, strict: bool = True) -> Column:
    """Hex text (optional 0x prefix, surrounding blanks) -> long.

    Invalid text raises when ``strict`` (as an integer parse would), else null.
    """
    x = strip(col)
    digits = F.regexp_replace(x, r"^0[xX]", "")
    value = F.conv(digits, 16, 10).try_cast("long")
    ok = digits.rlike(_HEX)
    if strict:
        return F.when(x.isNull(), F.lit(None).cast("long")).when(
            ok & value.isNotNull(), value).otherwise(
            F.raise_error(F.concat(F.lit("invalid hex: "), x)).cast("long"))
    return F.when(ok, value)


# Decimal number text: digits with optional fraction/exponent, or inf/infinity/nan.
# (Spark's own string->double cast also takes Java suffixes such as '12F' or '3D',
# which are not numbers here.)
DECIMAL_PATTERN = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def to_number(col: ColumnLike) -> Column:
    """Text -> double when it is decimal-number text (blanks around allowed), else null."""
    x = strip(col)
    return F.when(x.rlike(DECIMAL_PATTERN), x.try_cast("double"))


def number_or_hex(col: ColumnLike) -> Column:
    """Decimal number if the text is one, else its hex value, else null."""
    return F.coalesce(to_number(col), hex_to_long(col, strict=False).cast("double"))


def number_or_default(col: ColumnLike, default: float = -1.0) -> Column:
    """Numeric value of the text, ``default`` when it is not a number (or NaN)."""
    v = to_number(col)
    return F.when(v.isNull() | F.isnan(v), F.lit(float(default))).otherwise(v)


def flag_equals(col: ColumnLike, value) -> Column:
    """Equality flag."""
    return c(col) == F.lit(value)


def sigmoid(col: ColumnLike) -> Column:
    """Logistic function of a logit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(col).cast("double")))


def cast_strict(col: ColumnLike, dtype: str) -> Column:
    """Cast that raises on a value that does not convert (independent of ANSI mode)."""
    x = c(col)
    v = x.try_cast(dtype)
    return F.when(x.isNotNull() & v.isNull(),
                  F.raise_error(F.concat(F.lit(f"cannot cast to {dtype}: "), x.cast("string")))
                  .cast(dtype)).otherwise(v)


def cast_lenient(col: ColumnLike, dtype: str, fill=None, via: str | None = None) -> Column:
    """Cast with null for bad values, optionally through ``via`` (e.g. text ->
    double -> long truncates '1.5' to 1) and with ``fill`` for nulls."""
    v = c(col)
    if via:
        v = v.try_cast(via)
    v = v.try_cast(dtype)
    if fill is not None:
        v = F.coalesce(v, F.lit(fill).cast(via or dtype)).try_cast(dtype)
    return v


def missing_sentinel(cols: Sequence[ColumnLike], tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """True if any of the columns holds a missing-value token (null stays null)."""
    return functools.reduce(lambda a, b: a | b, [c(x).isin(list(tokens)) for x in cols])

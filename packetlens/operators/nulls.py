"""Null handling (inventory C1, E4): fill by type with validity flags."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import c

# Fill for strings, numbers and booleans.
STRING_FILL = "NONE"
NUMERIC_FILL = -1
BOOLEAN_FILL = False
VALID_SUFFIX = ".is_valid"


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row, one null count per column (single partial aggregate)."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(c(n).isNull()).alias(n) for n in cols])


def columns_with_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    row = null_counts(df, cols).first()
    return [n for n in (cols or df.columns) if row[n] > 0]


def fill_nulls(df: DataFrame, cols: Iterable[str] | None = None, no_flag: Iterable[str] = ()) -> DataFrame:
    """Fill nulls by type, adding ``{col}.is_valid`` for numeric and boolean columns.

    Only columns that contain a null are touched (one aggregate decides).  The
    flag is taken before filling.  Other types with nulls are an error.
    ``no_flag`` lists columns that are filled without a flag column.
    """
    targets = columns_with_nulls(df, list(cols) if cols else None)
    no_flag = set(no_flag)
    types = {f.name: f.dataType for f in df.schema.fields}
    out, flags = [], []
    for n in df.columns:
        if n not in targets:
            out.append(c(n))
            continue
        t = types[n]
        if isinstance(t, T.StringType):
            out.append(F.coalesce(c(n), F.lit(STRING_FILL)).alias(n))
            continue
        if isinstance(t, T.NumericType):
            out.append(F.coalesce(c(n), F.lit(NUMERIC_FILL).cast(t)).alias(n))
        elif isinstance(t, T.BooleanType):
            out.append(F.coalesce(c(n), F.lit(BOOLEAN_FILL)).alias(n))
        else:
            raise ValueError(f"Unknown dtype: {t} for column: {n}")
        if n not in no_flag:
            flags.append(c(n).isNotNull().alias(n + VALID_SUFFIX))
    return df.select(*out, *flags)

"""Schema and projection operators (inventory B1-B3, B6-B11, D1, G3).

These act on the schema on the driver (a list of fields) and emit one
``select``; no data moves except in ``drop_superfluous``, which runs one
partial aggregate.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import c

# Numeric widening chain: a type converts safely to itself and any later type.
NUMERIC_CHAIN = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(),
                 T.DoubleType()]
# Candidate order for the common supertype; the first safe candidate wins.
PRECEDENCE = [T.BooleanType(), *NUMERIC_CHAIN, T.DateType(), T.TimestampType(), T.StringType()]


def _safe_targets(dt: T.DataType) -> list[T.DataType]:
    if dt in NUMERIC_CHAIN:
        return NUMERIC_CHAIN[NUMERIC_CHAIN.index(dt):] + [T.StringType()]
    if isinstance(dt, T.TimestampNTZType):
        return [T.TimestampType(), T.StringType()]
    return [dt, T.StringType()]


def common_supertype(types: Sequence[T.DataType]) -> T.DataType:
    """B1: first type in ``PRECEDENCE`` that every input converts to safely, else string.

    Deliberately not Spark's own coercion: Boolean with Integer gives String,
    Long with Float gives Float.
    """
    for cand in PRECEDENCE:
        if all(cand in _safe_targets(t) for t in types):
            return cand
    return T.StringType()


def union_supertyped(dfs: Sequence[DataFrame]) -> DataFrame:
    """B1 + G3: cast every frame to the per-column common supertype and union by name."""
    names = dfs[0].columns
    target = {n: common_supertype([d.schema[n].dataType for d in dfs]) for n in names}
    cast = [d.select(*[c(n).cast(target[n]).alias(n) for n in names]) for d in dfs]
    return functools.reduce(lambda a, b: a.unionByName(b), cast)


def drop_columns(df: DataFrame, names: Iterable[str], strict: bool = True) -> DataFrame:
    """B2: drop columns; ``strict`` raises when one is missing."""
    names = list(dict.fromkeys(names))
    if strict:
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*[n for n in names if n in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename in one projection, so swaps (a->b, b->a) work."""
    missing = [k for k in mapping if k not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[c(n).alias(mapping.get(n, n)) for n in df.columns])


_KINDS = {
    "numeric": lambda t: isinstance(t, T.NumericType),
    "boolean": lambda t: isinstance(t, T.BooleanType),
    "string": lambda t: isinstance(t, T.StringType),
    "temporal": lambda t: isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)),
}


def columns_where(df: DataFrame, kind: str | None = None, startswith: str | None = None,
                  endswith: str | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Sorted column names by type kind and name predicates."""
    exclude = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if kind and not _KINDS[kind](f.dataType):
            continue
        if startswith and not f.name.startswith(startswith):
            continue
        if endswith and not f.name.endswith(endswith):
            continue
        out.append(f.name)
    return sorted(out)


def superfluous_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct value (null counting as a value).

    One aggregate with min, max and a null count per column: a column has <= 1
    distinct value iff it is all null, or has no null and min == max.
    """
    cols = list(cols or df.columns)
    aggs = []
    for i, n in enumerate(cols):
        aggs += [F.min(c(n)).alias(f"mn{i}"), F.max(c(n)).alias(f"mx{i}"),
                 F.count(c(n)).alias(f"nn{i}")]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs).first()
    out = []
    for i, n in enumerate(cols):
        non_null, rows = row[f"nn{i}"], row["__rows"]
        if non_null == 0 or (non_null == rows and row[f"mn{i}"] == row[f"mx{i}"]):
            out.append(n)
    return out


def drop_superfluous(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with at most one distinct value."""
    return df.drop(*superfluous_columns(df, cols))


def sort_columns(df: DataFrame) -> DataFrame:
    """Columns in name order."""
    return df.select(*[c(n) for n in sorted(df.columns)])


def with_literal(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column."""
    return df.withColumn(name, F.lit(value))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Raise if a required column is missing; returns the frame unchanged."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named columns (dotted names are literal names)."""
    return df.select(*[c(n) for n in names])


# Contract of the prepared packet table.
SPECIAL_COLUMNS = ["attack_label", "attack_type", "session_id", "timestamp"]

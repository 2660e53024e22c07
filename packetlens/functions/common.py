"""Small column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = str | Column


def c(name: ColumnLike) -> Column:
    """Column by name; names with dots or slashes are back-quoted, not traversed."""
    if isinstance(name, Column):
        return name
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[ColumnLike]) -> list[Column]:
    return [c(n) for n in names]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key equals a null key; the right side's key columns are dropped."""
    keys = list(keys)
    names = {k: f"__jk{i}" for i, k in enumerate(keys)}
    right = right.select(*[c(n).alias(names.get(n, n)) for n in right.columns])
    cond = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[v]) for k, v in names.items()])
    return left.join(right, cond, how).drop(*names.values())


def flag(value: ColumnLike | None) -> Column:
    """Numeric TCP flag as boolean: exactly 1 is true, null/anything else false."""
    if value is None:
        return F.lit(False)
    return F.coalesce(c(value) == 1, F.lit(False))


def safe_div(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num / den with ``empty`` where den is 0 or null (ANSI division would raise)."""
    return F.when(den.isNull() | (den == 0), F.lit(empty)).otherwise(num / den)
